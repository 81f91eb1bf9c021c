"""Shuffles of large tables have more partitions, so that a task holds no more of them."""

from pyspark.sql import functions as F

from loomgraph import staging
from loomgraph.operators import dataflow, graph, history
from loomgraph.sources import tables


def widest(df):
    """Rows of the largest partition."""
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def lineitem(spark, orders):
    return spark.range(orders * 4).select(
        F.floor(F.col("id") / 4).alias("l_orderkey"), F.pmod(F.xxhash64("id"), F.lit(997)).alias("l_partkey"), (F.col("id") % 4).alias("l_linenumber"), F.pmod(F.xxhash64(-F.col("id")), F.lit(40)).alias("l_suppkey"), F.lit(1).alias("l_quantity"),
    )


def test_successions_and_degrees(spark, monkeypatch):
    lines = lineitem(spark, 1000)
    plain = tables.succession(lines)
    monkeypatch.setattr(staging, "ROWS_PER_TASK", 200)
    dealt = tables.succession(lines)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))
    assert widest(plain) > 400 > widest(dealt)
    assert sorted(map(tuple, graph.degrees(dealt).collect())) == sorted(map(tuple, graph.degrees(plain).collect()))


def test_degrees_make_their_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src long, dst long").mapInArrow(counted, "src long, dst long")
    assert sorted(map(tuple, graph.degrees(edges).collect())) == [(1, 0, 2, 2), (2, 1, 1, 2), (3, 2, 0, 2)]
    assert seen.value == 3


def test_pairs_of_commits(spark, monkeypatch):
    commits = lineitem(spark, 1000).select(F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("path")).unionByName(spark.range(30).select(F.lit(-1).alias("commit"), F.col("id").alias("path")))
    plain = sorted(map(tuple, history.coupling(commits).collect()))
    for wide in (history.WIDE, 8):
        monkeypatch.setattr(history, "WIDE", wide)
        monkeypatch.setattr(staging, "ROWS_PER_TASK", 300)
        each = commits.distinct()
        assert widest(history._pairs(each)) < 700
        assert sorted(map(tuple, history.coupling(commits).collect())) == plain


def test_assignments_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks get no more of them than ROWS_PER_TASK or so, also where Spark would put its own shuffle's partitions together."""
    one = lambda k, name, reads: f"named_struct('name', '{name}', 'line', {k}, 'names', array({reads}), 'expr', '{name}{k}')"
    functions = spark.range(1000).selectExpr(
        "concat('f', id) as fn", "'p' as path", "concat('n', id) as name", "1 as line", "array('a') as params",
        f"array({one(1, 'x', chr(39) + 'a' + chr(39))}, {one(2, 'y', chr(39) + 'x' + chr(39))}, {one(3, 'x', chr(39) + 'y' + chr(39))}) as assigns", "array() as call_sites",
    )
    flow = lambda: vars(f := dataflow.Flow.__new__(dataflow.Flow)).update(functions=functions, assigns=dataflow.assignments(functions), _made={}, match="call") or f
    plain = sorted(map(str, flow().variables().collect()))
    monkeypatch.setattr(staging, "ROWS_PER_TASK", 150)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        dealt = flow().variables()
        assert widest(dealt) < 300
        assert sorted(map(str, dealt.collect())) == plain and len(plain) == 3000
        assert widest(dataflow.def_use(dataflow.assignments(functions), 3000)) < 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
