"""Tables that change: upserts, snapshot differences, versions published by one atomic rename."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def newest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row of each key that is largest by some columns, taken in their order; nulls are least.

    An aggregate, so a key's rows are combined where they are and a key with a third of all rows is a row a task.
    """
    kept = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*by)).alias("_row"))
    return kept.select("_row.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`new`, and the rows of `old` whose keys it lacks."""
    return old.join(new, keys, "left_anti").unionByName(new)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, status) of two (key, hash) tables: added, changed, deleted or same."""
    both = old.select("key", F.col("hash").alias("was")).join(new.select("key", F.col("hash").alias("now")), "key", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "same").otherwise("changed")
    return both.select("key", status.alias("status"))


class Conflict(Exception):
    """Another writer published this version first."""


class Versions:
    """Named tables in folders of their own; a version is seen once its marker names its folder.

    Writers never share a folder, and creating a marker fails if it is there, so of two writers that publish the same version
    one gets Conflict, and what it wrote is never read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._no_overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE

    def last(self) -> int:
        """The published version, 0 before the first."""
        folder = self._path(f"{self.root}/published")
        if not self._fs.exists(folder):
            return 0
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit()), default=0)

    def _folder(self, version: int) -> str:
        stream = self._fs.open(self._path(f"{self.root}/published/{version}"))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, tables: dict[str, DataFrame], after: int | None = None) -> int:
        """Write all tables, then make them the version that readers see: that after `after`, the one they were made from."""
        version = (self.last() if after is None else after) + 1
        folder = f"v={version}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{self.root}/{folder}/{name}")
        # written aside and renamed, so that a marker is whole once it is seen
        aside = self._path(f"{self.root}/published/.{folder}")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(folder.encode()))
        stream.close()
        marker = self._path(f"{self.root}/published/{version}")
        try:
            self._files.rename(self._fs.makeQualified(aside), self._fs.makeQualified(marker), self._no_overwrite)
        except Py4JJavaError as error:
            self._fs.delete(aside, False)
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            raise Conflict(f"version {version} of {self.root}") from error
        if self._folder(version) != folder:  # not every file system renames atomically
            raise Conflict(f"version {version} of {self.root}")
        return version

    def set_meta(self, key: str, value: str) -> None:
        """Keep a short text under a key. The last writer's stays."""
        stream = self._fs.create(self._path(f"{self.root}/meta/{quote(key, safe='')}"), True)
        stream.write(bytearray(value.encode()))
        stream.close()

    def get_meta(self, key: str) -> str | None:
        path = self._path(f"{self.root}/meta/{quote(key, safe='')}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self._folder(version or self.last())}/{name}")
