"""Edges that are replaced where a change matters, against edges of a new engine."""

import random

from conftest import values

from loomgraph import engine as engine_module
from loomgraph import staging
from loomgraph.engine import Engine
from loomgraph.operators import build, store
from loomgraph.sources import files as source_files


def module(draw, k, n):
    """A module that imports some others, defines a few names that they share, and calls some, defined anywhere or nowhere."""
    imports = "".join(f"from m{j} import *\n" for j in sorted(draw.sample(range(n), draw.randint(0, 2))))
    names = draw.sample([f"f{i}" for i in range(8)], draw.randint(0, 3))
    functions = "".join(f"def {name}(a):\n" + "".join(f"    f{draw.randrange(10)}(a)\n" for _ in range(draw.randint(1, 3))) + "\n" for name in names)
    klass = f"class K{k % 3}:\n    def f{draw.randrange(8)}(self):\n        f{draw.randrange(8)}(1)\n" if draw.random() < 0.5 else ""
    return imports + functions + klass


def test_patched_edges_are_those_of_a_new_build(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(engine_module, "PATCHES", 3)
    draw, n = random.Random(8), 8
    for k in range(n):
        (tmp_path / f"m{k}.py").write_text(module(draw, k, n))
    (tmp_path / "test_all.py").write_text("".join(f"def test_f{i}():\n    f{i}(1)\n\n" for i in range(8)))
    e = Engine(spark, str(tmp_path))
    assert e.edges.count()
    tables = []
    for step in range(5):
        for k in draw.sample(range(n + 1), 2):
            file = tmp_path / f"m{k}.py"
            if file.exists() and draw.random() < 0.4:
                file.unlink()
            else:
                file.write_text(module(draw, k, n) + "# " + "x" * step)
        e.refresh(full=True)
        assert sorted(values(e.edges)) == sorted(values(Engine(spark, str(tmp_path)).edges)), step
        tables.append(len(e._edge_tables))
    assert max(tables) == 3 and 1 in tables


def test_a_change_leaves_the_parts_that_it_does_not_concern(spark, repo, tmp_path):
    """One file of sixty is changed: the others' edges are read from where they were, and only its callers are looked at."""
    texts = {f"a{i}.py": f"def g{i}():\n    h{i}()\n\ndef h{i}():\n    pass\n" for i in range(60)}
    root = repo(texts | {"user.py": "def use():\n    g7()\n"})
    e = Engine(spark, root)
    e.edges.count()
    whole, _ = e._edge_tables[0]
    (tmp_path / "a7.py").write_text("def g7b():\n    h7()\n\ndef h7():\n    pass\n")
    e.refresh(full=True)
    (old, gone), (fresh, none) = e._edge_tables
    assert 1 <= len(gone) <= 2 and not none and old is whole  # the parts of a7.py and user.py
    assert fresh.count() < whole.count() / 4
    plan = e.edges._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert ("user.py::use", "?::g7") in values(e.calls, "src", "dst") and ("a7.py::g7b", "a7.py::h7") in values(e.calls, "src", "dst")


def test_tasks_list_the_files_of_a_folder_in_batches(spark, tmp_path, monkeypatch):
    """The driver sees folders alone, and a task holds few of a folder's files."""
    for i in range(25):
        (tmp_path / f"f{i}.py").write_text("x = 1\n")
    (tmp_path / "pkg" / "__pycache__").mkdir(parents=True)
    (tmp_path / "pkg" / "__pycache__" / "g.py").write_text("x = 1\n")
    (tmp_path / "pkg" / "g.py").write_text("x = 1\n")
    (tmp_path / "pkg" / "g.txt").write_text("x\n")
    opened, real = [], source_files.entries
    monkeypatch.setattr(source_files, "entries", lambda *given: opened.append(given) or real(*given))
    monkeypatch.setattr(source_files, "FILES_AT_ONCE", 4)
    found = source_files.listed(spark, str(tmp_path))
    assert not opened
    monkeypatch.undo()
    assert sorted(map(tuple, found.select("path").collect())) == sorted((p,) for p, _ in source_files.listing(str(tmp_path)))
    assert found.count() == 26


def test_a_refresh_does_not_shuffle_what_files_say(spark, repo, tmp_path, monkeypatch):
    """Whatever Spark takes for small: the paths of what has changed are sent to the parsed rows and to the symbols, not these dealt anew."""
    root = repo({f"a{i}.py": f"def g{i}():\n    h{i}()\n\ndef h{i}():\n    pass\n" for i in range(12)})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = Engine(spark, root)
        e.edges.count()
        staged, stage = [], engine_module.stage
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(engine_module, "stage", lambda df, **options: staged.append((df.columns, plan(df))) or stage(df, **options))
        (tmp_path / "a7.py").write_text("def g7b():\n    h7()\n\ndef h7():\n    pass\n")
        (tmp_path / "a8.py").unlink()
        assert e.refresh(full=False) == {"added": 0, "changed": 1, "deleted": 1, "same": 10}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    (parsed,) = [said for columns, said in staged if "occurrences" in columns and "Join" in said]
    assert "BroadcastHashJoin" in parsed and "SortMergeJoin" not in parsed
    assert e.symbols.where("name = 'g7b'").count() == 1 and e.symbols.where("path = 'a8.py'").isEmpty()


def test_changed_files_are_read_by_as_many_tasks_as_all_files(spark, repo, monkeypatch):
    """A staged list of paths is one small file; its files are not parsed in one task."""
    monkeypatch.setattr(source_files, "FILES_PER_TASK", 4)
    root = repo({f"a{i}.py": f"def g{i}():\n    pass\n" for i in range(40)})
    found = source_files.read(spark, root, staging.stage(source_files.listed(spark, root).coalesce(1)))
    assert found.rdd.getNumPartitions() == 10 and found.count() == 40


def test_the_last_symbol_of_a_name_is_known_without_a_shuffle(spark):
    """Those that a window over all symbols would find, also where a table of texts has a path twice."""
    texts = [
        ("a.py", "def f():\n    a()\n\ndef f():\n    b()\n\nclass A:\n    def f(self):\n        c()\n    def g(self):\n        d()\n    def f(self):\n        e()\n"),
        ("b.py", "def f():\n    b()\n"),
        ("c.js", "function f() { a(); }\nfunction f() { b(); }\nclass A { f() { c(); } }\nfunction g() { d(); }\n"),
        ("e.py", ""),
    ]
    again = [("b.py", "def f():\n    z()\n\ndef f():\n    y()\n")]
    for rows in (texts, texts + again):
        e = Engine.over(spark.createDataFrame(rows, "path string, source string"))
        last = build.latest_symbols(e.symbols)
        want = store.newest(e.symbols, ["id"], ["line", "ordinal"])
        columns = ("id", "line", "ordinal", "calls")
        assert sorted(map(str, last.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
        assert last.count() < e.symbols.count() and last.select("id").distinct().count() == last.count()
        assert "Exchange" not in last._jdf.queryExecution().executedPlan().toString()
        assert e.edges.count() == e.edges.distinct().count()
