"""Curation of media and text collections as Spark queries."""
