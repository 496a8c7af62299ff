"""Stored tables as directories of immutable versions with an atomic pointer, and cuts of lineage."""

import atexit
import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.sources.sinks import write_json


_written: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame, instead: DataFrame | None = None) -> DataFrame:
    """``df`` written to the checkpoint folder that the cluster names, and read back: its lineage ends there.

    It is computed once, and a lost executor costs a reread. ``instead`` is an
    earlier cut that nothing needs any more; its files go. The others go when the
    driver's interpreter ends. Only a session of a single local JVM that names no
    folder falls back to a temporary one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="curatrix-"))
        folder = context.getCheckpointDir()
    path = f"{folder.rstrip('/')}/curatrix/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    if instead is not None:
        _removed([x for x in _written if x[1] == getattr(instead, "_cut", None)])
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def _removed(which: list[tuple[SparkSession, str]]) -> None:
    for spark, path in which:
        _written.remove((spark, path))
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended before its interpreter
            return


atexit.register(lambda: _removed(list(_written)))


class VersionedTable:
    """A Parquet table that is replaced whole: readers keep the version they opened.

    A failed write leaves the pointer, and so the table, as it was.
    """

    def __init__(self, spark: SparkSession, folder: str | Path, schema: str):
        self.spark, self.folder, self.schema = spark, Path(folder), schema

    def read(self) -> DataFrame:
        pointer = self.folder / "current.json"
        if not pointer.exists():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(str(self.folder / json.loads(pointer.read_text())["version"]))

    def replace(self, rows: DataFrame) -> DataFrame:
        self.folder.mkdir(parents=True, exist_ok=True, mode=0o700)
        version = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(str(self.folder / version))
        write_json(self.folder / "current.json", {"version": version})
        return self.read()


class BatchedTable:
    """A Parquet table that grows by batches, each written once under its own name.

    Readers see the batches that the list names; a batch that was not finished
    is in no list. ``compact`` draws them together, where keys repeat the last
    batch counts.
    """

    def __init__(self, spark: SparkSession, folder: str | Path, schema: str, key: str):
        self.spark, self.folder, self.schema, self.key = spark, Path(folder), schema, key

    def _batches(self) -> list[str]:
        listed = self.folder / "batches.json"
        return json.loads(listed.read_text()) if listed.exists() else []

    def read(self) -> DataFrame:
        """One row for each key, that of the last batch that has it."""
        batches = self._batches()
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[str(self.folder / b) for b in batches])
        if len(batches) == 1:  # a batch has each key once
            return rows
        columns = rows.columns
        number = F.element_at(F.split("_metadata.file_path", "/"), -2)
        last = F.max_by(F.struct(*columns), F.struct(F.array_position(F.array(*map(F.lit, batches)), number), F.struct(*columns)))
        return rows.groupBy(F.col(self.key).alias("k")).agg(last.alias("row")).select("row.*")

    def add(self, rows: DataFrame) -> None:
        """Write a batch; it counts from the moment that the list names it."""
        self.folder.mkdir(parents=True, exist_ok=True, mode=0o700)
        batch = f"b-{uuid.uuid4().hex}"
        rows.dropDuplicates([self.key]).write.parquet(str(self.folder / batch))
        write_json(self.folder / "batches.json", [*self._batches(), batch])

    def keep(self, keys: DataFrame) -> None:
        """Only the rows of these keys, as one batch."""
        self._whole(self.read().join(keys, self.key, "left_semi"))

    def compact(self, most: int = 32) -> None:
        """One batch in place of more than ``most``."""
        if len(self._batches()) > most:
            self._whole(self.read())

    def _whole(self, rows: DataFrame) -> None:
        """``rows`` as the only batch; the old files stay for readers that have them open."""
        batch = f"b-{uuid.uuid4().hex}"
        rows.write.parquet(str(self.folder / batch))
        write_json(self.folder / "batches.json", [batch])
