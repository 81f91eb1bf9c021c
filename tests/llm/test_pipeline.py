"""The pipeline on a fixture: each stage against what it must keep, and all of it on the driver's smallest tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import mixing

from .test_models import junk
from .test_native import DOCS, ODD


@pytest.fixture
def tables(spark, tmp_path):
    draw = random.Random(12)
    fresh = lambda n: " ".join(f"w{draw.randrange(10**6)}" if draw.random() < 0.5 else draw.choice(["the", "house", "of", "green"]) for _ in range(n))
    item = fresh(40)
    good = [(i, fresh(80), "en", f"s{i % 3}", 1) for i in range(120)]
    poor = [(200 + i, junk(draw), "en", "s0", 1) for i in range(60)]
    copies = [(300 + i, good[i][1], "en", "s1", 1) for i in range(10)] + [(320 + i, good[i][1] + " and so", "en", "s2", 1) for i in range(10)]
    dirty = [(400 + i, fresh(60) + " " + item + " " + fresh(60), "en", "s2", 1) for i in range(5)]
    docs = spark.createDataFrame(good + poor + copies + dirty, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(120)] + [(200 + i, 0, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    functions = dict(corpus_pipeline.STAGES)
    kept = functions["quality"](spark, docs, tables)
    clean = [i for i in [*range(120), *range(300, 310), *range(320, 330), *range(400, 405)]]
    assert kept.columns == docs.columns and ids(kept) == clean
    one = functions["near_duplicates"](spark, kept, tables)
    assert one.columns == docs.columns and ids(one) == [*range(120), *range(400, 405)]
    safe = functions["decontamination"](spark, one, tables)
    assert safe.columns == docs.columns and ids(safe) == [*range(120)]
    mixed = functions["mixing"](spark, safe, tables)
    assert mixed.columns == docs.columns
    plan = {r["doc_id"]: r["copies"] for r in mixing.plan(safe).collect()}
    assert ids(mixed) == sorted(i for i, n in plan.items() for _ in range(n))
    shards = functions["sharding"](spark, mixed, tables)
    assert ids(shards) == ids(mixed) and ids(corpus_pipeline.run(spark, tables)) == ids(mixed)


def test_odd_rows_pass_every_stage(spark, tables):
    clashes = ("size", "source_size", "target", "copies", "score", "_text", "_id", "_hash", "_source", "_row", "_arrival", "node", "rows")
    docs = spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit(c) for c in clashes})
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, tables)
        assert out.columns == docs.columns or (name == "sharding" and out.columns[: len(docs.columns)] == docs.columns), name
        assert {tuple(r) for r in out.select(*clashes).collect()} == {clashes}, name
        assert out.count() >= 1 and function(spark, docs.limit(0), tables).count() == 0, name


