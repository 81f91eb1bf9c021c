"""A repository's source files as a data source, after register(spark):

    spark.read.format("loomgraph_files").option("languages", "py,go").option("prefix", "pkg/").load(root)

Files of other endings aren't opened, and folders that no wanted path lies in aren't listed. The planner goes down until there are enough
folders; tasks walk these and open their files. What a scan leaves out is left out here, too.

These are options and not filters that are taken over from the plan: Spark 4.1 keeps one reader a loaded frame, so a frame that a
plan has twice, under different filters, would be read with the filters of one of them.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..staging import ship
from .files import FILES_PER_TASK, FOLDERS_PER_TASK, WALKED, entries, walk

_SCHEMA = pa.schema([("path", pa.string()), ("language", pa.string()), ("mtime", pa.timestamp("us", "UTC")), ("source", pa.string())])
#: Bytes of texts that are handed over at once.
BATCH = 4 << 20


@dataclass(frozen=True)
class Wanted:
    """Which files to read; None is any ending."""

    languages: frozenset[str] | None = None
    prefix: str = ""

    def file(self, path: str) -> bool:
        return (self.languages is None or path.rpartition(".")[2] in self.languages) and path.startswith(self.prefix)

    def folder(self, path: str) -> bool:
        """Whether a wanted path can lie in a folder."""
        inside = f"{path}/"
        return inside.startswith(self.prefix) or self.prefix.startswith(inside)


@dataclass
class Share(InputPartition):
    """Files, and folders with all that is below them."""

    files: list
    folders: list


class SourceFilesReader(DataSourceReader):
    def __init__(self, root: str, wanted: Wanted = Wanted()):
        self.root, self.wanted = root, wanted

    def partitions(self) -> list[Share]:
        files, todo = [], [""]
        while todo and len(todo) < WALKED:
            level = [entries(self.root, folder) for folder in todo if os.path.isdir(os.path.join(self.root, folder))]
            files += sorted(f for found, _ in level for f in found if self.wanted.file(f[0]))
            todo = sorted(p for _, folders in level for p in folders if self.wanted.folder(p))
        shares = [Share(files[i : i + FILES_PER_TASK], []) for i in range(0, len(files), FILES_PER_TASK)]
        shares += [Share([], todo[i : i + FOLDERS_PER_TASK]) for i in range(0, len(todo), FOLDERS_PER_TASK)]
        return shares or [Share([], [])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        below = (f for folder in partition.folders for f in walk(self.root, folder) if self.wanted.file(f[0]))
        for path, mtime in itertools.chain(partition.files, below):
            try:
                with open(os.path.join(self.root, path), "rb") as f:
                    source = f.read().decode("utf-8", errors="replace")
            except FileNotFoundError:  # gone since the listing
                continue
            rows.append({"path": path, "language": path.rpartition(".")[2], "mtime": mtime, "source": source})
            size += len(source)
            if size >= BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


class SourceFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomgraph_files"

    def schema(self) -> str:
        return "path string, language string, mtime timestamp, source string"

    def reader(self, schema) -> SourceFilesReader:
        if not self.options.get("path"):
            raise ValueError("load() needs the repository's folder")
        asked = self.options.get("languages")
        languages = None if asked is None else frozenset(e.strip() for e in asked.split(","))
        return SourceFilesReader(self.options["path"], Wanted(languages, self.options.get("prefix", "")))


def register(spark: SparkSession) -> None:
    """Make format("loomgraph_files") known to a session."""
    ship(spark)
    spark.dataSource.register(SourceFiles)
