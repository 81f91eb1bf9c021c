"""The driver's tables, and the graphs that the named queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def state(df: DataFrame) -> tuple[tuple[str, int, int], ...]:
    """(path, size, time of change) of the files that a table reads: another value once they have been replaced."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    out = []
    for file in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((file, status.getLen(), status.getModificationTime()))
    return tuple(out)


def succession(lineitem: DataFrame) -> DataFrame:
    """Parts that follow each other in an order: distinct (src, dst). The sort key is total."""
    rows = lineitem.count()
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    pairs = spread(lineitem, rows, "l_orderkey").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return spread(pairs.where("dst is not null"), rows, "src", "dst").distinct()


#: The same as SQL: pg over all lines, pgr over returned ones.
PG = """pg AS (
  SELECT DISTINCT src, dst FROM (
    SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS dst FROM lineitem)
  WHERE dst IS NOT NULL
)"""
PGR = PG.replace("pg AS", "pgr AS").replace("FROM lineitem", "FROM lineitem WHERE l_returnflag = 'R'")
DEGREES = """deg AS (
  SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*)::BIGINT AS degree
  FROM (SELECT src AS id, 0 AS i, 1 AS o FROM pg UNION ALL SELECT dst, 1, 0 FROM pg) GROUP BY id
)"""


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return succession(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))


def returned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return succession(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
