"""Snapshots that arrive as files, merged into a stored inventory batch by batch.

The inventory needs deletions and changes in place, which a stream of new files
does not tell; what streams is the listings. Every row carries its snapshot's
number and how many rows the snapshot has, ``of``. A snapshot may arrive over
several triggers and in any order: rows are kept until it is complete, and it is
merged only if it is newer than the last one merged.
"""

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curatrix.operators import inventory
from curatrix.sources.sinks import write_json
from curatrix.sources.tables import BatchedTable, VersionedTable

SCHEMA = "snapshot bigint, of bigint, path string, size bigint, mtime_ns bigint"
STORED = "path string, size bigint, mtime_ns bigint, config string, error string"
_ARRIVED = f"place string, {SCHEMA}"


def merge(stored: DataFrame, listing: DataFrame, config: str) -> DataFrame:
    """``stored`` after a scan in which every pending row was read."""
    fresh = inventory.pending(listing, stored, config).withColumns({"config": F.lit(config), "error": F.lit(None).cast("string")})
    return inventory.upsert(stored, fresh, listing)


def follow(spark: SparkSession, listings: str, folder: str, checkpoint: str, config: str) -> StreamingQuery:
    """Process what has arrived under ``listings``, then stop; a rerun goes on from there.

    A batch that is repeated after a failure brings rows that are there already
    and a snapshot that is not newer, so it changes nothing.
    """
    table = VersionedTable(spark, Path(folder) / "inventory", STORED)
    arrived = BatchedTable(spark, Path(folder) / "arrived", _ARRIVED, "place")
    mark = Path(folder) / "merged.json"

    def batch(rows: DataFrame, _: int) -> None:
        done = json.loads(mark.read_text())["snapshot"] if mark.exists() else None
        if done is not None:
            rows = rows.where(F.col("snapshot") > done)
        arrived.add(rows.withColumn("place", F.concat_ws(":", "snapshot", "path")).select("place", *rows.columns))
        whole = arrived.read().groupBy("snapshot").agg(F.count("path").alias("n"), F.max("of").alias("of")).where("n = of")
        latest = whole.agg(F.max("snapshot")).first()[0]
        if latest is None:
            return
        listing = arrived.read().where(F.col("snapshot") == latest).select("path", "size", "mtime_ns")
        table.replace(merge(table.read(), listing, config))
        write_json(mark, {"snapshot": latest})
        arrived.keep(arrived.read().where(F.col("snapshot") > latest).select("place"))

    stream = spark.readStream.schema(SCHEMA).parquet(listings)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
