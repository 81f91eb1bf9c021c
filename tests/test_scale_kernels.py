"""Kernels where they split hot keys, and stores with several writers, against plain Python."""

import itertools
import os
import random

import pytest
from conftest import values
from pyspark.sql import functions as F

from loomgraph.engine import Engine
from loomgraph.operators import graph, history, store


def ranks(edges, nodes, rounds=25):
    out = {}
    for s, t in edges:
        out.setdefault(s, []).append(t)
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        loose = sum(rank[n] for n in nodes if n not in out)
        new = {n: (0.15 + 0.85 * loose) / len(nodes) for n in nodes}
        for s, targets in out.items():
            for t in targets:
                if t in new:
                    new[t] += 0.85 * rank[s] / len(targets)
        rank = new
    return rank


@pytest.mark.parametrize("hub", [4, 1000])
@pytest.mark.parametrize("loose", [True, False])
def test_pagerank_with_hubs(spark, monkeypatch, hub, loose):
    monkeypatch.setattr(graph, "HUB", hub)
    draw = random.Random(hub)
    nodes = list(range(30))
    edges = sorted({(0, t) for t in nodes} | {(draw.randrange(30), draw.randrange(30)) for _ in range(60)} | (set() if loose else {(n, (n + 1) % 30) for n in nodes}))
    got = dict(values(graph.pagerank(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(n,) for n in nodes], "id long"))))
    assert got == pytest.approx(ranks(edges, nodes), abs=1e-12)


def test_pagerank_without_edges_or_nodes(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert values(graph.pagerank(none, spark.createDataFrame([], "id long"))) == []
    assert dict(values(graph.pagerank(none, spark.range(4)))) == pytest.approx(dict.fromkeys(range(4), 0.25))


@pytest.mark.parametrize("wide", [2, 3, 1000])
def test_coupling_of_wide_commits(spark, monkeypatch, wide):
    monkeypatch.setattr(history, "WIDE", wide)
    draw = random.Random(4)
    commits = [(c, f"p{draw.randrange(9)}") for c in range(12) for _ in range(draw.choice([1, 2, 9]))]
    paths = {c: {p for d, p in commits if d == c} for c in range(12)}
    n = {p: sum(p in own for own in paths.values()) for p in {p for _, p in commits}}
    want = []
    for a, b in itertools.combinations(sorted(n), 2):
        both = sum({a, b} <= own for own in paths.values())
        if both >= 3:
            want.append((a, b, both, round(both / max(n[a], n[b]), 4)))
    frame = spark.createDataFrame(commits, "commit long, path string")
    assert sorted(values(history.coupling(frame))) == want
    assert sorted(values(history.coupling(frame, path="p3"))) == [w for w in want if "p3" in w[:2]]


def test_names_are_numbered_in_order(spark):
    names = [f"n{i * 37 % 101:03d}" for i in range(101)] + ["", "Ünï"]
    got = values(graph.numbered(spark.createDataFrame([(n,) for n in names], "name string").repartition(5)), "name", "no")
    assert sorted(got, key=lambda r: r[1]) == [(n, i) for i, n in enumerate(sorted(names, key=str.encode))]


def test_resolution_by_links(spark):
    draw = random.Random(6)
    calls = sorted({(f"c{draw.randrange(6)}", f"n{draw.randrange(5)}", f"k{draw.randrange(4)}") for _ in range(30)})
    symbols = sorted({(f"n{draw.randrange(4)}", f"i{draw.randrange(20)}", f"k{draw.randrange(4)}") for _ in range(14)})
    linked = sorted({(f"k{draw.randrange(4)}", f"k{draw.randrange(4)}") for _ in range(4)})
    want = {}
    for caller, name in {c[:2] for c in calls}:
        keys = {k for c, n, k in calls if (c, n) == (caller, name)}
        near = keys | {o for k, o in linked if k in keys}
        sure = {i for n, i, k in symbols if n == name and k in near}
        for target in sure or {i for n, i, _ in symbols if n == name} or {f"?::{name}"}:
            want[caller, target] = max(want.get((caller, target), 0), 1.0 if sure else 0.5)
    frames = (spark.createDataFrame(rows, kind) for rows, kind in ((calls, "caller string, name string, key string"), (symbols, "name string, id string, key string")))
    got = graph.resolve_callees_by(*frames, "key", spark.createDataFrame(linked, "a string, b string"))
    assert {(c, t): w for c, t, w in values(got)} == want


def test_the_newest_row_of_each_key(spark):
    rows = [(1, 1, None, "a"), (1, 2, 1, "b"), (1, 2, 3, "c"), (2, None, 9, "d"), (None, 1, 1, "e"), (None, 1, 2, "f")]
    got = store.newest(spark.createDataFrame(rows, "k int, x int, y int, v string"), ["k"], ["x", "y"])
    assert sorted(values(got), key=str) == sorted([rows[2], rows[3], rows[5]], key=str)


def test_of_two_writers_one_conflicts_and_nothing_is_mixed(spark, tmp_path):
    one, two = (store.Versions(spark, str(tmp_path / "s")) for _ in range(2))
    frame = lambda v: spark.createDataFrame([(v,)], "v int")
    base = one.last()
    assert one.publish({"a": frame(1), "b": frame(1)}, base) == 1
    with pytest.raises(store.Conflict):
        two.publish({"a": frame(2), "b": frame(2)}, base)
    assert values(two.read("a")) == values(two.read("b")) == [(1,)] and two.last() == 1
    assert two.publish({"a": frame(3), "b": frame(3)}) == 2 and values(one.read("a", 1)) == [(1,)] and values(one.read("a")) == [(3,)]
    one.set_meta("a/b", "x")
    assert two.get_meta("a/b") == "x" and two.get_meta("gone") is None


def test_two_engines_on_one_store(spark, repo, tmp_path_factory):
    root, folder = repo({"a.py": "def f(): pass\n"}), str(tmp_path_factory.mktemp("store"))
    first = Engine(spark, root, folder)
    assert first.last_indexed_at().endswith("+00:00")
    second = Engine(spark, root, folder)
    repo({"b.py": "def g(): pass\n"})
    assert first.refresh()["added"] == 1
    with pytest.raises(store.Conflict):
        second.refresh()
    assert sorted(values(Engine(spark, root, folder).symbols, "name")) == [("f",), ("g",)]


def test_a_full_refresh_sees_what_kept_its_time(spark, repo):
    root = repo({"a.py": "def f(): pass\n", "b.py": "def same(): pass\n"})
    e, when = Engine(spark, root), os.stat(os.path.join(root, "a.py")).st_mtime_ns
    repo({"a.py": "def g(): pass\n"})
    os.utime(os.path.join(root, "a.py"), ns=(when, when))
    assert e.refresh() == {"added": 0, "changed": 0, "deleted": 0, "same": 2}
    assert e.refresh(full=True) == {"added": 0, "changed": 1, "deleted": 0, "same": 1}
    assert sorted(values(e.symbols, "name")) == [("g",), ("same",)]
    e.set_meta("k", "v")
    assert e.get_meta("k") == "v" and e.get_meta("no", "else") == "else"


@pytest.mark.parametrize("walked", [1, 3, 1000])
def test_large_trees_are_walked_by_tasks(spark, repo, monkeypatch, walked):
    from loomgraph.sources import files as source_files

    monkeypatch.setattr(source_files, "WALKED", walked)
    monkeypatch.setattr(source_files, "FOLDERS_PER_TASK", 2)
    root = repo({f"d{i}/e{i % 3}/f{i}.py": f"def f{i}(): pass\n" for i in range(12)} | {"top.py": "", "d0/node_modules/x.js": "", "d1/x.egg-info/y.py": "", "d2/.hidden.py": "", "d3/noending": ""})
    os.symlink(os.path.join(root, "d4"), os.path.join(root, "d5", "linked"))
    os.symlink(os.path.join(root, "top.py"), os.path.join(root, "link.py"))
    want = sorted([f"d{i}/e{i % 3}/f{i}.py" for i in range(12)] + ["top.py", "d2/.hidden.py"])
    assert [p for p, _ in source_files.listing(root)] == want == sorted(p for p, in values(source_files.listed(spark, root), "path"))
    assert sorted(values(Engine(spark, root).symbols, "name")) == sorted((f"f{i}",) for i in range(12))


def test_reports_and_text_forms(spark):
    from loomgraph import render

    files = {
        "calc.py": 'def add(a, b):\n    """Adds."""\n    return a + b\n',
        "checkout.py": "from calc import add\n\ndef order(x):\n    return add(x, 1)\n",
        "api.py": "from checkout import order\n\nclass Api:\n    def handle(self, x):\n        return order(x)\n",
        "test_calc.py": "from calc import add\n\ndef test_add():\n    assert add(1, 2)\n",
        "bad.py": "def broken(:\n",
    }
    e = Engine.over(spark.createDataFrame(list(files.items()), "path string, source string"))
    report = e.change_impact_report("add")
    assert report["changed_symbols"] == [{"qualified_name": "calc.py::add", "name": "add", "file": "calc.py"}]
    assert report["impact"] == {
        "CRITICAL": [{"qualified_name": "checkout.py::order", "name": "order", "file": "checkout.py", "line": 3, "hop": 1}],
        "HIGH": [{"qualified_name": "api.py::Api.handle", "name": "handle", "file": "api.py", "line": 4, "hop": 2}],
    }
    assert [t["name"] for t in report["affected_tests"]] == ["test_add"] and e.change_impact_report("gone") == {"changed_symbols": [], "impact": {}, "affected_tests": []}
    page = e.search_graph_report(limit=1, offset=1, kind="function")
    assert (page["total"], page["has_more"], len(page["results"])) == (4, True, 1)
    assert e.search_graph_report(limit=5, offset=50, kind="function") == {"total": 4, "limit": 5, "offset": 50, "has_more": False, "results": []}
    assert e.search_graph_report(kind="none")["total"] == 0
    assert e.resolve_report("add")["matches"][0] == {"qualified_name": "calc.py::add", "name": "add", "kind": "function", "file": "calc.py", "line": 1, "is_test": False}
    assert render.call_graph(e.get_call_graph("checkout.py", "order"), "order") == "Call graph for 'order':\n\n  order calls:\n    → add\n\n  order is called by:\n    ← api.py:1\n    ← api.py:5\n    ← checkout.py:3"
    assert render.imports(e.get_imports("api.py"), "api.py") == "Imports in api.py:\n  1: from checkout import order" and render.imports(e.get_imports("calc.py"), "calc.py") == "No imports found in calc.py"
    assert render.search(e.search_symbols(query="handle")) == "Search results:\n  api.py: method handle (in Api) → line 4\n\nFound 1 symbol"
    assert render.search(e.search_symbols(query="add", type="function"), compact=True).splitlines()[0] == "calc.py:fn add:1 # Adds."
    assert render.search(e.search_symbols(query="zz"), query="zz", has_doc=None, min_complexity=2) == 'No symbols found matching query="zz", min_complexity=2.'
    assert render.tests(e.find_tests("calc.py", "add"), "calc.py", "add") == "Tests for add() in calc.py:\n  test_calc.py: test_add() → line 3  (references symbol, name match, file match)\n\nFound 1 test"
    assert "  checkout.py: order() → line 3" in render.blast_radius(e.get_blast_radius("calc.py", "add"), "add", lines=True)
    assert e.get_ast("api.py", "handle", 0, in_file=True) == "(FunctionDef [4:4-5:23] ...)"
    assert e.get_ast("bad.py").startswith("(file (name [1:0] 'def')") and e.get_ast("api.py", "gone") == ""


def test_the_first_clone_group_is_the_first_in_the_files(spark):
    body = "    x = {0} + 1\n    if x:\n        return x\n    return {1}\n"
    plain, other = body.format("p", "x"), body.format("p", "x * x")
    e = Engine.over(spark.createDataFrame([("a.py", f"def z1(p):\n{other}\ndef y1(p):\n{plain}"), ("b.py", f"def y2(p):\n{plain}\ndef z2(p):\n{other}")], "path string, source string"))
    assert values(e.detect_clones(min_lines=4), "path", "name") == [("a.py", "z1"), ("b.py", "z2"), ("a.py", "y1"), ("b.py", "y2")]


def test_names_and_weights_of_hidden_symbols(spark):
    """A function that is defined twice has the calls of the last one only."""
    e = Engine.over(spark.createDataFrame([("a.py", "def f():\n    one()\n\ndef f():\n    two()\n")], "path string, source string"))
    assert values(e.calls) == [("a.py::f", "?::two", 0.5)] and e.symbols.where(F.col("name") == "f").count() == 2


@pytest.mark.parametrize("most", [5, 10**6])
def test_flow_of_a_hot_user(spark, monkeypatch, most):
    """A user with most of the events, by ranges and by one window, against plain Python."""
    from datetime import datetime, timedelta

    from loomgraph.operators import flow

    monkeypatch.setattr(flow, "MOST", most)
    draw = random.Random(11)
    kinds = ["signup", "view", "purchase", None]
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=draw.randrange(400)), draw.choice([1, 1, 1, 2, 3, None]), draw.choice(kinds)) for i in range(160)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").repartition(4)
    chain, verdicts = [], []
    for user in (1, 2, 3, None):
        own = sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0]))
        for n, r in enumerate(own):
            last = own[n - 1] if n else None
            after = own[n + 1][3] if n + 1 < len(own) else None
            chain.append((r[0], user, r[3], last[3] if last else None, after, (r[1] - last[1]) // timedelta(microseconds=1) if last else None))
            if r[3] == "purchase":
                source, clean = (max((o[1] for o in own[:n] if o[3] == k), default=None) for k in ("signup", "view"))
                verdicts.append((r[0], "CLEAN" if source is None else "SAFE" if clean and clean > source else "UNSAFE"))
    assert sorted(values(flow.event_chain(events)), key=str) == sorted(chain, key=str)
    kind = F.col("event_type")
    got = flow.taint_in_order(events, by="user_id", order=["ts", "event_id"], at="ts", source=kind == "signup", sanitizer=kind == "view", sink=kind == "purchase")
    assert got.columns == [*events.columns, "verdict"] and sorted(values(got, "event_id", "verdict")) == sorted(verdicts)
    assert values(flow.event_chain(events.limit(0))) == []


def test_what_is_staged_in_scratch_is_deleted(spark):
    from loomgraph.staging import scratch, shared_dir, stage

    before, inner, outer = stage(spark.range(3)), [], []
    with scratch(spark):
        outer.append(stage(spark.range(4)).inputFiles()[0])
        with scratch(spark):
            inner.append(stage(spark.range(5)).inputFiles()[0])
        assert not os.path.exists(inner[0].removeprefix("file://")) and os.path.exists(outer[0].removeprefix("file://"))
        kept = shared_dir(spark)
        stage(spark.range(6)).write.parquet(kept)
    assert not os.path.exists(outer[0].removeprefix("file://")) and before.count() == 3 and spark.read.parquet(kept).count() == 6


def test_ranks_by_name_are_those_of_all_pairs(spark):
    draw = random.Random(3)
    targets = [(f"n{i % 7}", f"{i}::n{i % 7}") for i in range(40)]
    calls = sorted({(t, f"n{draw.randrange(10)}") for _, t in targets[:30] for _ in range(3)})
    edges = [(s, t) for s, name in calls for own, t in targets if own == name]
    got = dict(values(graph.pagerank_by_name(spark.createDataFrame(calls, "src string, name string"), spark.createDataFrame(targets, "name string, dst string"))))
    assert got == pytest.approx(ranks(edges, [t for _, t in targets]), abs=1e-12)


def test_a_graph_of_names_is_not_written_pair_by_pair(spark, monkeypatch):
    """60 files with one function that calls its name: 3,600 pairs, of which no table that is staged has a row each."""
    from loomgraph import engine

    e = Engine.over(spark.createDataFrame([(f"m_{i}.py", "def again():\n    again()\n") for i in range(60)], "path string, source string"))
    rows, stage = [], engine.stage

    def counted(df, **options):
        out = stage(df, **options)
        rows.append(out.count())
        return out

    monkeypatch.setattr(engine, "stage", counted)
    monkeypatch.setattr(graph, "stage", counted)
    assert e.name_calls.count() == 3600
    assert len(values(e.rank_symbols())) == 20
    assert e.get_blast_radius("m_0.py", "again").count() == 118
    assert max(rows) <= 60


def test_resolved_pairs_are_not_shuffled(spark):
    """Rows are as many as callers times symbols of a name, and leave the join as they are; where a row can come twice, it comes once."""
    calls = [(f"c{i}", "f", "k" if i < 3 else "x") for i in range(20)]
    symbols = [("f", i, "k" if i < 4 else "y") for i in range(20)]
    found = graph.resolve_callees_by(spark.createDataFrame(calls, "caller string, name string, key string"), spark.createDataFrame(symbols, "name string, id long, key string"), "key")
    assert sorted(values(found)) == sorted((c, str(i), 1.0 if k == "k" else 0.5) for c, _, k in calls for _, i, own in symbols if k != "k" or own == "k")
    top = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in top.split("Join")[0]
    twice = [("g", 1, "z"), ("f", 1, "k")]
    found = graph.resolve_callees_by(spark.createDataFrame([("c", "f", "k"), ("c", "g", "x")], "caller string, name string, key string"), spark.createDataFrame(twice, "name string, id long, key string"), "key")
    assert values(found) == [("c", "1", 1.0)]


def test_staged_tables_are_broadcast_by_their_rows_not_their_files(spark):
    """300,000 rows of names take some MB as a file, and tens in a driver that would broadcast them."""
    from loomgraph.staging import stage

    name = F.concat(F.lit("pkg/of/some/length/m_"), (F.col("id") / 16).cast("long").cast("string"), F.lit(".py::function_"), F.col("id").cast("string"))
    names = stage(spark.range(300_000).select(name.alias("name"), F.col("id").alias("k")))
    paths = stage(spark.range(300_000).select(F.col("id").alias("k"), name.alias("path")))
    assert "Broadcast" not in names.join(paths, "k")._jdf.queryExecution().sparkPlan().toString()


def test_edges_are_not_written_pair_by_pair(spark, monkeypatch):
    """60 callers of a name that 60 other files have, and 60 tests of it: 7,200 edges, of which no table that is staged has a row each."""
    from loomgraph import engine

    files = [(f"m_{i}.py", "def f():\n    pass\n") for i in range(60)] + [(f"c_{i}.py", f"def c{i}():\n    f()\n") for i in range(60)] + [(f"tests/test_{i}.py", "def test_f():\n    pass\n") for i in range(60)]
    e = Engine.over(spark.createDataFrame(files, "path string, source string"))
    rows, stage = [], engine.stage

    def counted(df, **options):
        out = stage(df, **options)
        rows.append(out.count())
        return out

    monkeypatch.setattr(engine, "stage", counted)
    monkeypatch.setattr(graph, "stage", counted)
    assert e.edges.count() == e.index_status()["edges"] == 7200
    assert sorted(values(e.degrees())) == sorted(values(graph.degrees(e.edges)))
    assert values(e.get_change_impact("f").groupBy("hop", "is_test").count().orderBy("hop")) == [(0, True, 60), (1, False, 60)]
    assert max(rows) <= 600


@pytest.mark.parametrize("sent", [1 << 20, -1])
def test_resolved_pairs_are_made_from_blocks_of_targets(spark, monkeypatch, sent):
    """Calls are made once, rows come from arrays of targets, broadcast or not, and null callers, names and keys are what SQL has for them."""
    import duckdb

    monkeypatch.setattr(graph, "BLOCK", 3, raising=False)
    monkeypatch.setattr(graph, "SENT", sent, raising=False)
    calls = [(c, n, k) for c in (None, 1, 2, 3) for n, k in (("f", "k"), ("f", "k"), ("f", "x"), ("g", "x"), ("g", None), ("h", "k"), (None, "k"))] + [(4, "f", "z"), (4, "f", "y"), (5, "f", "k"), (5, "f", "y")]
    symbols = [("f", i, "k" if i < 8 else "y") for i in range(20)] + [("g", 20 + i, None if i % 2 else "y") for i in range(9)] + [("h", None, "k"), (None, 40, "k")]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kind = "caller long, name string, key string"
    found = graph.resolve_callees_by(spark.createDataFrame(calls, kind).mapInArrow(counted, kind), spark.createDataFrame(symbols, "name string, id long, key string"), "key")
    got = sorted(values(found), key=str)
    assert seen.value == len(calls)
    con = duckdb.connect()
    con.execute("CREATE TABLE calls (caller BIGINT, name VARCHAR, key VARCHAR); CREATE TABLE symbols (name VARCHAR, id BIGINT, key VARCHAR)")
    con.executemany("INSERT INTO calls VALUES (?, ?, ?)", calls)
    con.executemany("INSERT INTO symbols VALUES (?, ?, ?)", symbols)
    want = con.sql(
        """WITH pairs AS (SELECT caller, c.name, id, CASE WHEN id IS NOT NULL AND c.key = s.key THEN 1.0 ELSE 0.5 END::DOUBLE AS weight FROM calls c LEFT JOIN symbols s ON s.name = c.name
        ), best AS (SELECT *, max(weight) OVER (PARTITION BY caller, name) AS best FROM pairs)
        SELECT caller, coalesce(id::VARCHAR, '?::' || name) AS target, max(weight) AS weight FROM best WHERE weight = best GROUP BY ALL"""
    ).fetchall()
    assert got == sorted(want, key=str) and {w for _, _, w in got} == {0.5, 1.0}
    assert "Generate" in found._jdf.queryExecution().optimizedPlan().toString()
