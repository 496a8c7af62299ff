"""A folder tree as a table: path, size, mtime_ns.

Unlike the built-in file sources it keeps names that start with a dot or an
underscore, leaves out symbolic links, gives times in nanoseconds and ends the
query when a folder cannot be read.
"""

import os
from collections.abc import Iterator

from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from curatrix.functions.text import EXTENSIONS, traversal

SCHEMA = "path string, size bigint, mtime_ns bigint"


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__((path, deep))
        self.path, self.deep = path, deep


def supported_name(name: str) -> bool:
    return name.rpartition(".")[2].lower() in EXTENSIONS and "." in name


def listed(folder: str, deep: bool = True) -> Iterator[tuple[str, int, int]]:
    """Files in order of name, then the folders below, in order of name; links are left out."""
    with os.scandir(folder) as entries:
        found = sorted((e for e in entries if not e.is_symlink()), key=lambda e: e.name)
    for e in found:
        if e.is_file(follow_symlinks=False) and supported_name(e.name):
            stat = e.stat(follow_symlinks=False)
            yield e.path, stat.st_size, stat.st_mtime_ns
    if deep:
        for e in found:
            if e.is_dir(follow_symlinks=False):
                yield from listed(e.path)


class LibraryReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[_Folder]:
        """One for the files at the top, one for each folder there."""
        if not os.path.isdir(self.root):
            raise ValueError(f"{self.root} is not a folder")
        below = sorted(e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False))
        return [_Folder(self.root, False), *(_Folder(p, True) for p in below)]

    def read(self, partition: _Folder) -> Iterator[tuple[str, int, int]]:
        yield from listed(partition.path, partition.deep)


class LibrarySource(DataSource):
    """``spark.read.format("library").load(folder)``, once it is registered."""

    @classmethod
    def name(cls) -> str:
        return "library"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LibraryReader:
        return LibraryReader(str(self.options["path"]))


def read_library(spark, root: str):
    """The files below a folder, as it is walked; a folder named by a link is the one linked to."""
    spark.dataSource.register(LibrarySource)
    return spark.read.format("library").load(os.path.realpath(root)).orderBy(traversal(F.col("path")))
