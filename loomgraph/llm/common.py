"""What several corpus operators share: reading, staging in the shared folder, skew-safe joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import ROW_GROUP, ROWS_PER_FILE, shared_dir, ship, stage

__all__ = ["LOWER", "ROW_GROUP", "UPPER", "WORD", "ascii_lower", "free_name", "hash_sample", "join_on_hot_key", "python_workers", "shared_dir", "stage", "table"]

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as keep it apart from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def python_workers(spark: SparkSession) -> None:
    """Python workers that know this package, and batches of a few MB from here on: texts are long, and a batch is held
    by the scan and on both sides of a worker.
    """
    ship(spark)
    limits = (("spark.sql.execution.arrow.maxRecordsPerBatch", 2048), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20), ("spark.sql.parquet.columnarReaderBatchSize", 512))
    for key, most in limits:
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def hash_sample(df: DataFrame, key: str, size: int) -> DataFrame:
    """At most `size` rows, those with the least hash of `key`; the same ones wherever they are.

    Only rows below a threshold that leaves about twice as many are sorted, so neither the driver nor one task is
    sent `size` rows by every task.
    """
    share = min(1.0, 2 * size / max(1, df.count()))
    place = F.shiftrightunsigned(F.xxhash64(key), 11).cast("double") / F.lit(float(1 << 53))
    return df.where(place < share).orderBy(place, *df.columns).limit(size)


def join_on_hot_key(left: DataFrame, right: DataFrame, key: str, copies: str, *, hot: int = 1000, short: bool = True) -> DataFrame:
    """Inner join of a staged `left` with `right`, which has one row per `key` and its number of
    left rows in `copies`. Keys with over 1/hot of all left rows are at most `hot` and so are
    broadcast; the others are small and meet in a shuffle. `short` rows (some numbers, no texts or lists) leave in
    partitions of some ROWS_PER_FILE rows at least; others stay in the tasks that Spark chose by their bytes.
    """
    total = left.count()
    limit = max(1, total // hot)
    heavy = F.broadcast(right.where(F.col(copies) > limit))
    light = right.where(F.col(copies) <= limit)
    joined = left.join(heavy, key).unionByName(left.join(light, key))
    return joined.coalesce(max(1, -(-total // ROWS_PER_FILE))) if short else joined
