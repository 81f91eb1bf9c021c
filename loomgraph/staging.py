"""What reaches the executors: intermediate tables in the folder that all share, and this package itself."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: By application, the temporary folder of a local session that names no shared one.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under the cluster's shared one; a temporary one only where none is named, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _LOCAL.get(app) or _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="loomgraph-"))
    return f"{base.rstrip('/')}/loomgraph-{uuid.uuid4().hex}"


#: Rows of a small table that are worth a file.
ROWS_PER_FILE = 50_000
#: Bytes of rows to a byte of a file: names and paths that repeat take next to nothing in a file, and Spark would broadcast by that size.
INFLATED = 50
#: Bytes of a Parquet row group: a writer holds one in memory, and an executor has several writers.
ROW_GROUP = 32 << 20


def stage(df: DataFrame, *, path: str | None = None, rows: int | None = None, by: str | None = None) -> DataFrame:
    """Write to the shared folder and read again: computed once, lineage cut, and lost executors don't matter.

    `rows` is a bound on a table of short rows: it is written as a file for each ROWS_PER_FILE, however many
    partitions a shuffle has left it in. `by` names a column whose values are folders, which readers that filter by it skip.
    """
    spark = df.sparkSession
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) < INFLATED:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", str(float(INFLATED)))
    path = path or shared_dir(spark)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    for held in _SCRATCH.get(spark.sparkContext.applicationId, ()):
        held.append(path)
    writer = df.write.mode("errorifexists").option("compression", "zstd").option("parquet.block.size", ROW_GROUP)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task sorts or groups at once.
ROWS_PER_TASK = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal a table of about so many rows by keys, so that a task's memory doesn't grow with the table: in partitions of ROWS_PER_TASK, if
    there are more of them than cores. Spark puts small partitions of its own shuffles together by their compressed bytes, down to about one a
    core, and names and paths take next to nothing there. A window or aggregation by the keys then shuffles no further.
    """
    parts, spark = -(-rows // ROWS_PER_TASK), df.sparkSession
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys) if parts > few else df


#: Bytes of a staged table of texts that is broadcast whatever Spark thinks of its files.
SENT = 64 << 20


def sent(texts: DataFrame) -> DataFrame:
    """A staged table of short texts, to be broadcast if its rows take no more than SENT: what meets it is then not shuffled."""
    size = texts.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts.columns), F.lit(64).cast("long")))).first()[0] or 0
    return F.broadcast(texts) if size <= SENT else texts


#: By application, the folders that each open scratch() has seen staged.
_SCRATCH: dict[str, list[list[str]]] = {}


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged inside, at the end: for a job whose result has been written elsewhere by then."""
    held: list[str] = []
    open_ones = _SCRATCH.setdefault(spark.sparkContext.applicationId, [])
    open_ones.append(held)
    try:
        yield
    finally:
        open_ones.remove(held)
        for folder in held:
            discard(spark, folder)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a staged table that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, so that it need not be installed there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="loomgraph-code-"), "loomgraph.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
