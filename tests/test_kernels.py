"""Kernels on small tables, by exact rows."""

import pytest
from conftest import values
from pyspark.sql import functions as F

from loomgraph.operators import flow, graph, history, store, text


@pytest.fixture
def edges(spark):
    def make(*pairs):
        return spark.createDataFrame(list(pairs), "src string, dst string")

    return make


def test_degrees_count_self_loops_twice(edges):
    assert sorted(values(graph.degrees(edges(("a", "b"), ("a", "a"))), "id", "in_degree", "out_degree", "degree")) == [("a", 1, 2, 3), ("b", 1, 0, 1)]


def test_bfs_takes_the_least_depth_and_ends_on_cycles(spark, edges):
    e = edges(("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d"))
    seed = spark.createDataFrame([("a",)], "id string")
    assert sorted(values(graph.bfs(e, seed))) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert sorted(values(graph.bfs(e, seed, 1))) == [("a", 0), ("b", 1), ("c", 1)]
    assert values(graph.bfs(e, seed.where("false"))) == []


def test_bfs_of_a_long_chain(spark, edges):
    chain = edges(*[(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)])
    found = dict(values(graph.bfs(chain, spark.createDataFrame([("n00",)], "id string"))))
    assert found == {f"n{i:02d}": i for i in range(21)}


def test_change_impact(spark):
    calls = spark.createDataFrame([("checkout", "add", 1.0), ("api", "checkout", 1.0), ("far", "api", 1.0), ("loose", "add", 0.5)], "src string, dst string, weight double")
    seed = spark.createDataFrame([("add",)], "id string")
    assert sorted(values(graph.change_impact(calls, seed, 2))) == [("api", 2, "HIGH"), ("checkout", 1, "CRITICAL"), ("loose", 1, "CRITICAL")]
    assert sorted(values(graph.change_impact(calls, seed, 1, min_weight=1.0))) == [("checkout", 1, "CRITICAL")]


def test_pagerank_against_plain_python(spark, edges):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("a", "c")]
    nodes = ["a", "b", "c", "d", "lone"]
    got = dict(values(graph.pagerank(edges(*pairs), spark.createDataFrame([(n,) for n in nodes], "id string"))))
    rank = dict.fromkeys(nodes, 1 / 5)
    out = {n: [d for s, d in pairs if s == n] for n in nodes}
    for _ in range(25):
        loose = sum(rank[n] for n in nodes if not out[n])
        rank = {n: 0.15 / 5 + 0.85 * loose / 5 + 0.85 * sum(rank[m] / len(out[m]) for m in nodes if n in out[m]) for n in nodes}
    assert got == pytest.approx(rank, abs=1e-12) and sum(got.values()) == pytest.approx(1)


def test_resolution_prefers_confirmed_targets(spark):
    calls = spark.createDataFrame([("m", "save", "db"), ("o", "save", ""), ("o", "gone", "")], "caller string, name string, imported string")
    symbols = spark.createDataFrame([("save", "db::save", "db"), ("save", "utils::save", "utils")], "name string, id string, file string")
    got = sorted(values(graph.resolve_callees(calls, symbols, F.col("imported") == F.col("file"))))
    assert got == [("m", "db::save", 1.0), ("o", "?::gone", 0.5), ("o", "db::save", 0.5), ("o", "utils::save", 0.5)]


def test_search_page(spark, edges):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("lone",)], "id string")
    e = edges(("a", "b"), ("a", "c"), ("b", "c"))
    assert values(graph.search_page(nodes, e, limit=2), "id", "degree", "total") == [("a", 2, 4), ("b", 2, 4)]
    assert values(graph.search_page(nodes, e, limit=2, offset=2), "id", "total") == [("c", 4), ("lone", 4)]
    assert values(graph.search_page(nodes, e, max_degree=0), "id", "total") == [("lone", 1)]
    assert values(graph.search_page(nodes, e, linked_to=nodes.where("id = 'b'")), "id") == [("a",)]


@pytest.fixture
def commits(spark):
    rows = [(c, p, a, 1) for c, ps in enumerate(["ab", "ab", "ab", "a", "ac"]) for p, a in zip(ps, (2, 3))]
    return spark.createDataFrame(rows, "commit int, path string, additions int, deletions int")


def test_churn(spark, commits):
    assert values(history.churn(commits)) == [("a", 5, 10, 5), ("b", 3, 9, 3), ("c", 1, 3, 1)]
    assert values(history.churn(commits, spark.createDataFrame([("b",)], "path string"))) == [("b", 3, 9, 3)]


def test_coupling(commits):
    assert values(history.coupling(commits, min_commits=2)) == [("a", "b", 3, 0.6)]
    assert values(history.coupling(commits, path="b", min_commits=1)) == [("a", "b", 3, 0.6)]
    assert values(history.coupling(commits, path="c", min_commits=1)) == [("a", "c", 1, 0.2)]
    assert values(history.coupling(commits, min_commits=1, most_paths=1)) == []


def test_snapshot_diff_and_upsert(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "key int, hash string")
    new = spark.createDataFrame([(2, "y"), (3, "w"), (4, "v")], "key int, hash string")
    assert sorted(values(store.snapshot_diff(old, new))) == [(1, "deleted"), (2, "same"), (3, "changed"), (4, "added")]
    assert sorted(values(store.upsert(old, new, ["key"]))) == [(1, "x"), (2, "y"), (3, "w"), (4, "v")]
    rows = spark.createDataFrame([(1, 5), (1, 7), (2, 1)], "k int, v int")
    assert sorted(values(store.newest(rows, ["k"], ["v"]))) == [(1, 7), (2, 1)]


def test_versions(spark, tmp_path):
    versions = store.Versions(spark, str(tmp_path / "s"))
    assert versions.last() == 0
    assert versions.publish({"t": spark.range(3)}) == 1 and versions.publish({"t": spark.range(5)}) == 2
    assert versions.read("t").count() == 5 and versions.read("t", 1).count() == 3


def test_dead_names(spark):
    symbols = spark.createDataFrame([("f", "a.py", 1), ("g", "a.py", 5), ("h", "a.py", 9), ("i", "b.py", 1)], "name string, path string, line int")
    uses = spark.createDataFrame([("f", "a.py", 1), ("g", "a.py", 5), ("g", "b.py", 3), ("i", "a.py", 2)], "name string, path string, line int")
    assert sorted(values(text.dead(symbols, uses), "name")) == [("f",), ("h",)]


def test_clones_and_occurrences(spark):
    texts = spark.createDataFrame([(1, "x1 = 5\nfoo"), (2, "yy = 77\nbar"), (3, "x1 + 5\nfoo foo")], "id int, text string")
    assert values(text.clone_groups(texts, text.normalised(F.col("text"))), "n", "first_id") == [(2, 1)]
    assert sorted(values(text.occurrences(texts, "foo"))) == [(1, 2, 1), (3, 2, 2)]


def test_taint_in_order(spark):
    rows = spark.createDataFrame([(1, 1, "source"), (1, 2, "sink"), (1, 3, "clean"), (1, 4, "sink"), (2, 1, "sink")], "u int, t int, k string")
    got = flow.taint_in_order(rows, by="u", order=["t"], at="t", source=F.col("k") == "source", sanitizer=F.col("k") == "clean", sink=F.col("k") == "sink")
    assert sorted(values(got, "u", "t", "verdict")) == [(1, 2, "UNSAFE"), (1, 4, "SAFE"), (2, 1, "CLEAN")]


def test_reach_later(spark):
    rows = spark.createDataFrame([(1, s) for s in range(6)], "c int, s int")
    got = flow.reach_later(rows.where("s = 1"), rows.where("s > 2"), by="c", step="s", most=3)
    assert sorted(values(got)) == [(1, 1, 3, 2), (1, 1, 4, 3)]
