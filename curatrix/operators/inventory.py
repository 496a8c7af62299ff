"""The inventory: what a listing changes in the stored rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import traversal

VERSION = ("size", "mtime_ns")


def current(row_config: Column, error: Column, same: Column, config: str) -> Column:
    """Whether a stored row can be used again; rows with an error are always tried anew."""
    return F.coalesce(same & error.isNull() & (row_config == config), F.lit(False))


def difference(listing: DataFrame, stored: DataFrame, config: str) -> DataFrame:
    """(path, change): new, changed, retry, unchanged or vanished, in one pass over both.

    ``listing`` has path, size and mtime_ns; ``stored`` also config and error.
    """
    a, b = listing.select("path", *VERSION).alias("a"), stored.select("path", *VERSION, "config", "error").alias("b")
    joined = a.join(b, F.col("a.path") == F.col("b.path"), "full")
    same = (F.col("a.size") == F.col("b.size")) & (F.col("a.mtime_ns") == F.col("b.mtime_ns"))
    change = (
        F.when(F.col("a.path").isNull(), "vanished").when(F.col("b.path").isNull(), "new")
        .when(~same | (F.col("b.config") != config), "changed").when(F.col("b.error").isNotNull(), "retry").otherwise("unchanged")
    )
    return joined.select(F.coalesce("a.path", "b.path").alias("path"), change.alias("change"))


def vanished(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored paths that the listing no longer has."""
    return stored.select("path").join(listing.select("path"), "path", "left_anti")


def pending(listing: DataFrame, stored: DataFrame, config: str, limit: int | None = None) -> DataFrame:
    """The listed rows to process; a limit counts these alone, and takes the first as the folders are walked."""
    same = [listing[c] == stored[c] for c in ("path", *VERSION)]
    valid = stored["error"].isNull() & (stored["config"] == config)
    rows = listing.join(stored, same[0] & same[1] & same[2] & valid, "left_anti")
    return rows.orderBy(traversal(F.col("path")), "path").limit(limit) if limit else rows


def upsert(stored: DataFrame, fresh: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """``stored`` with ``fresh`` rows in place of those of equal path, without vanished ones."""
    kept = stored.join(fresh.select("path"), "path", "left_anti").unionByName(fresh)
    return kept if listing is None else kept.join(listing.select("path"), "path", "left_semi")


def stale(listing: DataFrame, stored: DataFrame, config: str) -> DataFrame:
    """The listed paths without a row of this version and configuration."""
    row = stored.select("path", *VERSION, F.col("config").alias("row_config"))
    return listing.select("path", *VERSION).join(row.where(F.col("row_config") == config), ["path", *VERSION], "left_anti").select("path")


def require_scanned(listing: DataFrame, stored: DataFrame, config: str) -> None:
    n = stale(listing, stored, config).count()
    if n:
        raise ValueError(f"{n} files have not been scanned with these settings")


def counters(diff: DataFrame, errors: DataFrame) -> DataFrame:
    """(outcome, n): processed, cached, errors, total."""
    e = errors.select("path").distinct().withColumn("failed", F.lit(True))
    listed = diff.where(F.col("change") != "vanished").join(e, "path", "left")
    work = F.col("change") != "unchanged"
    one = listed.agg(
        F.count_if(work).alias("processed"), F.count_if(~work).alias("cached"), F.count_if(work & F.coalesce("failed", F.lit(False))).alias("errors"), F.count(F.lit(1)).alias("total")
    )
    return one.select(F.explode(F.create_map(*[x for c in ("processed", "cached", "errors", "total") for x in (F.lit(c), F.col(c))])).alias("outcome", "n"))


def same_snapshot(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_before, only_after, equal): set comparison of (path, size, mtime_ns)."""
    x, y = (d.select("path", *VERSION).distinct() for d in (a, b))
    marked = x.withColumn("side", F.lit(1)).unionByName(y.withColumn("side", F.lit(2)))
    per = marked.groupBy("path", *VERSION).agg(F.sum("side").alias("sides"))
    return per.agg(F.count_if(F.col("sides") == 1).alias("only_before"), F.count_if(F.col("sides") == 2).alias("only_after")).select(
        "*", ((F.col("only_before") == 0) & (F.col("only_after") == 0)).alias("equal")
    )


def coverage(photos: DataFrame, threshold: float) -> DataFrame:
    """(supported_images, read_errors, identity_matches) of scanned rows."""
    match = F.col("error").isNull() & (F.col("face_count") > 0) & (F.col("similarity") >= threshold)
    return photos.agg(
        F.count(F.lit(1)).alias("supported_images"), F.count_if(F.col("error").isNotNull()).alias("read_errors"), F.count_if(F.coalesce(match, F.lit(False))).alias("identity_matches")
    )
