"""Whole plans: the queries, the test views they run on, and the command line."""
