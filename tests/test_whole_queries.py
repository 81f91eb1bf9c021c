"""Named queries on small tables against brute force: every row that they ask for, none cut."""

import random

import pytest
from conftest import values

from loomgraph.plans.catalogue import QUERIES


@pytest.fixture
def tables(spark, tmp_path):
    """Write {table: (rows, schema)} as Parquet; the folder."""

    def write(**made):
        for name, (rows, schema) in made.items():
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def test_resolve_weighted_takes_all_orders(spark, tables):
    draw = random.Random(21)
    parts = [(i, f"n{draw.randrange(12)}", f"b{draw.randrange(4)}", draw.randrange(1, 51)) for i in range(40)]
    orders = [(k, draw.randrange(8)) for k in range(1, 61)]
    lines = [(draw.randrange(1, 61), draw.randrange(40)) for _ in range(150)]
    d = tables(part=(parts, "p_partkey long, p_name string, p_brand string, p_size int"), orders=(orders, "o_orderkey long, o_custkey long"), lineitem=(lines, "l_orderkey long, l_partkey long"))
    part, customer = {p[0]: p for p in parts}, dict(orders)
    calls = {(customer[o], part[p][1], part[p][2]) for o, p in lines}
    want = set()
    for caller, name in {c[:2] for c in calls}:
        brands = {b for c, n, b in calls if (c, n) == (caller, name)}
        found = [p for p in parts if p[1] == name and p[3] > 30]
        sure = [p for p in found if p[2] in brands]
        want |= {(caller, str(p[0]), 1.0 if sure else 0.5) for p in sure or found} or {(caller, f"?::{name}", 0.5)}
    assert {w for _, _, w in want} == {0.5, 1.0} and any(t.startswith("?") for _, t, _ in want)
    assert sorted(values(QUERIES["resolve_weighted"](spark, d))) == sorted(want)


@pytest.fixture
def texts(tables):
    whole = " ".join(f"w{i}" for i in range(20))
    opening = " ".join(f"w{i}" for i in range(13))
    docs = [(1, f"so {whole} and on", "en"), (2, f"only {opening} and no more", "en"), (3, f"{whole}", "de"), (4, f"a short  item here\n{whole}x", "en"), (5, "a short  item", "en"), (6, "a short  items", "fr"), (7, None, "en"), (None, f"x {whole}", "en")]
    items = [(10, whole), (11, "a short  item"), (12, opening), (13, None), (14, "w5 w6")]
    return docs, items, tables(documents=(docs, "doc_id long, text string, lang string"), benchmark=(items, "item_id long, text string"))


def test_items_are_held_whole_or_not_at_all(spark, texts):
    docs, items, d = texts
    want = {(i, k) for i, item in items for k, text, _ in docs if item and text and f" {item} " in f" {text} "}
    assert {(10, 1), (11, 4), (11, 5), (12, 2), (14, 3)} <= want and not {(10, 2), (10, 4), (11, 6)} & want
    assert set(values(QUERIES["tests_edges"](spark, d))) == want
    best = {}
    for i, k in want:
        lang = next(x for n, _, x in docs if n == k)
        best.setdefault(i, []).append((-(3 + 2 * (lang == "en") + (k is not None and k % 2 == 0)), k is not None, k or 0))
    got = {i: (k, s) for i, k, s in values(QUERIES["test_discovery"](spark, d))}
    assert {i: (k if known else None, -s) for i, (s, known, k) in ((i, min(b)) for i, b in best.items())} == got


def test_change_impact_goes_three_hops(spark, tables):
    parts = [(i, "a" if i < 2 else f"n{i}", 5) for i in range(60)]
    follows = [(i + 2, i) for i in range(0, 58)] + [(9, 0), (30, 9)]  # src, dst: a line of an order each
    lines = [(o, 1 + n, p, 1, 1.0) for o, pair in enumerate(follows) for n, p in enumerate(pair)]
    labels = [(i, i % 2) for i in range(0, 60, 3)]
    d = tables(part=(parts, "p_partkey long, p_name string, p_size int"), lineitem=(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"), labels=(labels, "doc_id long, quality int"))
    hops, level = {0: 0, 1: 0}, {0, 1}
    for hop in (1, 2, 3):
        level = {s for s, t in follows if t in level} - hops.keys()
        hops |= dict.fromkeys(level, hop)
    want = {(i, h, ("CRITICAL", "HIGH", "MEDIUM")[h - 1]) for i, h in hops.items() if h}
    assert set(values(QUERIES["change_impact"](spark, d))) == want and {h for _, h, _ in want} == {1, 2, 3}
    assert set(values(QUERIES["change_impact_tests"](spark, d))) == {(i, h, dict(labels)[i]) for i, h, _ in want if i in dict(labels)}


def test_pagerank_dangling_runs_all_iterations(spark, tables):
    n = 12  # a chain, so mass still moves after ten steps
    lines = [(o, 1 + k, o + k, 1, 1.0, "R") for o in range(n - 1) for k in (0, 1)] + [(99, 1, 3, 1, 1.0, "N"), (99, 2, 0, 1, 1.0, "N")]
    d = tables(part=([(i,) for i in range(n + 1)], "p_partkey long"), lineitem=(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string"))
    rank = dict.fromkeys(range(n + 1), 1 / (n + 1))
    for _ in range(25):
        loose = rank[n - 1] + rank[n]
        rank = {i: (0.15 + 0.85 * loose) / (n + 1) + (0.85 * rank[i - 1] if 0 < i < n else 0) for i in rank}
    assert dict(values(QUERIES["pagerank_dangling"](spark, d))) == pytest.approx(rank, abs=1e-6)
