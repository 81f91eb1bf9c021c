"""Names found through the index against a look at every name."""

import random

import pytest
from conftest import values
from pyspark.sql import functions as F

from loomgraph.engine import Engine
from loomgraph.operators import names

KIND = "name string, path string, line int, id string"


def index_of(spark, all_names):
    rows = [(n, f"p{i % 7}", i, f"i{i}") for i, n in enumerate(all_names)]
    symbols = spark.createDataFrame(rows, KIND)
    return names.NameIndex(symbols, symbols.select("name", "path", "line", F.lit(0).alias("col"))), rows


def some_names():
    draw = random.Random(5)
    made = ["".join(draw.choice("abAB_1é") for _ in range(draw.randint(0, 9))) for _ in range(400)]
    return made + ["ÄÖÜ_straße", "İstanbul", "x" * 2000 + "Tail", None, "aba", "ABA", "😀face"]


@pytest.fixture(scope="module")
def index(spark):
    return index_of(spark, some_names())


@pytest.mark.parametrize("query", ["a", "AB", "aba", "b_1a", "é", "straß", "äöü", "TAIL", "x" * 50, "😀f", "zz", "abzb", "i̇st", "x" * 2100])
def test_containing_against_every_name(index, query):
    found, rows = index
    want = sorted(r for r in rows if r[0] is not None and query.lower() in r[0].lower())
    assert sorted(values(found.containing(query), "name", "path", "line", "id")) == want


def test_many_questions_at_once(spark, index):
    found, rows = index
    asked = ["a", "AB", "aba", "abab", "nowhere", "", None, "Tail", "é1", "aba"]
    got = values(found.names_with_each(spark.createDataFrame([(q,) for q in asked], "query string")))
    lows = {r[0].lower() for r in rows if r[0] is not None}
    assert sorted(got) == sorted((q, low) for q in {a for a in asked if a} for low in lows if q.lower() in low)


def test_names_and_uses(index):
    found, rows = index
    for name in ("aba", "İstanbul", "gone", "'quoted"):
        assert sorted(values(found.named(name), "id")) == sorted((r[3],) for r in rows if r[0] is not None and r[0].lower() == name.lower())
        assert sorted(values(found.uses(name), "path", "line")) == sorted((r[1], r[2]) for r in rows if r[0] == name)


def test_no_names(spark):
    found, _ = index_of(spark, [None])
    assert found.containing("a").count() == found.named("a").count() == found.uses("a").count() == 0
    assert found.names_with_each(spark.createDataFrame([("a",)], "query string")).count() == 0


def files_read(df):
    """Files that a plan of scans and filters opens, after the folders that are skipped."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numFiles").get().value() for i in range(leaves.size()))


def test_a_name_reads_one_folder(index):
    found, _ = index
    assert 0 < files_read(found.named("aba")) < len(found.symbols.inputFiles()) / 8
    assert 0 < files_read(found.uses("aba")) < len(found.occurrences.inputFiles()) / 8
    assert 0 < files_read(names.of_keys(found.counts, "gram", ["aba", "ba_"])) < len(found.counts.inputFiles()) / 8


def test_the_engine_answers_alike_with_and_without(spark, repo):
    root = repo({"a.py": "def Alpha_one(): pass\n\ndef beta():\n    Alpha_one()\n", "b.py": "from a import Alpha_one\n\nclass alpha_ONE: pass\n", "test_a.py": "def test_beta():\n    beta()\n"})
    e = Engine(spark, root)

    def answers():
        asked = spark.createDataFrame([("ALPHA",), ("et",)], "query string")
        return [
            values(e.search_symbols(query="lpha_O")), values(e.search_symbols(query="b")), values(e.search_symbols(query="")), values(e.find_references("Alpha_one")), values(e.resolve_symbol("alpha_one")),
            values(e.search_graph(query="ALPHA")), values(e.get_callers("Alpha_one").orderBy("path", "line")), values(e.find_tests("a.py", "beta")), e.search_names(asked).count() if e._indexed else None,
        ]

    plain = answers()
    e.index_names()
    indexed = answers()
    assert indexed[:-1] == plain[:-1] and indexed[-1] == 4
    repo({"c.py": "def alphabet():\n    Alpha_one()\n"})
    e.refresh()
    assert [r[4] for r in values(e.search_symbols(query="ALPHAB"))] == ["alphabet"]
    assert ("c.py", 2, 4) in values(e.find_references("Alpha_one"))
