"""From raw documents to shards: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontam, mixing, quality, sharding, simhash
from loomgraph.llm.common import shared_dir, table
from loomgraph.staging import scratch


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the labels of those that are here, doesn't reject; without labels all stay. Null texts are scored as empty ones."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id. Documents without words are copies of each other."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a benchmark's windows cover less than a twentieth of; without items all stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share of the mix says: not at all, or several times. An empty table stays empty."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each in a shard that a committed version lists; columns called like the store's own are kept."""
    return sharding.shard(docs)


STAGES = [
    ("quality", reject_poor),
    ("near_duplicates", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = shared_dir(spark)
    for name, function in STAGES:
        with scratch(spark):  # what a stage has staged is of no use once its rows are written
            function(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs


#: The classifier and the fingerprints are beyond SQL.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
