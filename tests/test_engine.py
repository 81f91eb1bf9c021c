"""Questions about small repositories, end to end."""

import os
import subprocess

import pytest
from conftest import values

from loomgraph.engine import Engine, PathError, checked
from loomgraph.sources import files as source_files
from loomgraph.sources import gitlog

GRAPH = {
    "calc.py": "class Calc:\n    def add(self, a, b):\n        return a + b\n    def sub(self, a, b):\n        if a:\n            return a - b\n\ndef helper():\n    return Calc().add(1, 2)\n",
    "main.py": "from calc import Calc\n\ndef main():\n    c = Calc()\n    return c.add(1, 2)\n",
    "tests/test_calc.py": "from calc import Calc\n\ndef test_add():\n    assert Calc().add(1, 2) == 3\n",
    "pkg/__init__.py": "def boot():\n    pass\n",
    "node_modules/x.js": "function no() {}\n",
    "old.egg-info/y.py": "def no(): pass\n",
    "notes.txt": "no source",
}


@pytest.fixture
def engine(spark, repo):
    def make(files, **options):
        return Engine(spark, repo(files), **options)

    return make


def test_scan_leaves_out_folders_and_links(repo):
    root = repo(GRAPH)
    os.symlink(os.path.join(root, "calc.py"), os.path.join(root, "link.py"))
    os.symlink(os.path.join(root, "pkg"), os.path.join(root, "linked"))
    assert [p for p, _ in source_files.listing(root)] == ["calc.py", "main.py", "pkg/__init__.py", "tests/test_calc.py"]


def test_structure(engine):
    e = engine(GRAPH)
    assert values(e.get_file_skeleton("calc.py"), "kind", "parent", "name", "line") == [("class", None, "Calc", 1), ("method", "Calc", "add", 2), ("method", "Calc", "sub", 4), ("function", None, "helper", 8)]
    assert values(e.get_symbol("calc.py", "helper"), "line", "source") == [(8, "def helper():\n    return Calc().add(1, 2)")]
    assert values(e.get_symbols([{"file_path": "main.py", "symbol_name": "main"}, {"file_path": "main.py", "symbol_name": "gone"}]), "request", "name", "line") == [(0, "main", 3), (1, "gone", None)]
    assert values(e.get_skeletons(["main.py", "gone.py"]), "ordinal", "path", "name") == [(0, "main.py", "main"), (1, "gone.py", None)]
    assert values(e.find_references("add"), "path", "line") == [("calc.py", 2), ("calc.py", 9), ("main.py", 5), ("tests/test_calc.py", 4)]
    assert values(e.get_call_graph("main.py", "main"), "role", "name", "line") == [("callee", "Calc", None), ("callee", "add", None), ("caller", "main", 3)]
    assert values(e.get_imports("main.py"), "line", "text") == [(1, "from calc import Calc")]
    total = e.get_complexity("calc.py", "sub").collect()[0]
    assert (total["total"], [tuple(b) for b in total["breakdown"]]) == (2, [("if", 1)])
    assert values(e.get_variables("main.py", "main"), "name", "kind") == [("c", "local")]
    assert values(e.search_symbols(query="AD", type="method"), "name") == [("add",)]
    assert values(e.search_symbols(min_complexity=2), "name") == [("sub",)]
    assert e.get_ast("main.py", "main", 1).startswith("(Module (FunctionDef [1:0-")


def test_edges(engine):
    e = engine(GRAPH)
    edges = set(values(e.edges, "src", "dst", "type"))
    assert ("calc.py::Calc", "calc.py::Calc.add", "CONTAINS") in edges
    assert ("main.py::main", "calc.py::Calc.add", "CALLS") in edges
    assert ("main.py::__file__", "calc.py::__file__", "IMPORTS") in edges
    assert ("tests/test_calc.py::test_add", "calc.py::Calc.add", "TESTS") in edges
    assert len(edges) == e.edges.count()


def test_imports_decide_between_equal_names(engine):
    e = engine(
        {
            "utils.py": "def save(): pass\n",
            "db.py": "def save(): pass\n",
            "main.py": "from db import save\n\ndef process():\n    save()\n    nowhere()\n",
            "other.py": "def process():\n    save()\n",
        }
    )
    assert sorted(values(e.calls)) == [
        ("main.py::process", "?::nowhere", 0.5), ("main.py::process", "db.py::save", 1.0), ("other.py::process", "db.py::save", 0.5), ("other.py::process", "utils.py::save", 0.5),
    ]


def test_impact_radius_and_ranks(engine):
    e = engine(
        {
            "calc.py": "def add(a, b):\n    return a + b\n",
            "checkout.py": "from calc import add\n\ndef process_order(x):\n    return add(x, 1)\n",
            "api.py": "from checkout import process_order\n\ndef handle_request(x):\n    return process_order(x)\n",
            "test_calc.py": "from calc import add\n\ndef test_add():\n    assert add(1, 2)\n",
        }
    )
    impact = {r["id"]: (r["hop"], r["risk"], r["is_test"]) for r in e.get_change_impact("add").collect()}
    assert impact == {"checkout.py::process_order": (1, "CRITICAL", False), "api.py::handle_request": (2, "HIGH", False), "test_calc.py::test_add": (1, "CRITICAL", True)}
    assert "api.py::handle_request" not in [r["id"] for r in e.get_change_impact("add", depth=1).collect()]
    assert values(e.get_blast_radius("calc.py", "add"), "role", "name", "depth") == [("caller", "process_order", 1), ("caller", "test_add", 1), ("caller", "handle_request", 2)]
    assert values(e.rank_symbols(1), "path", "name") == [("calc.py", "add")]
    assert values(e.find_hot_paths(1), "id", "callers", "score") == [("calc.py::add", 2, 2)]
    assert values(e.get_dependency_graph("api.py"), "src", "dst") == [("api.py", "checkout.py")]
    assert values(e.resolve_symbol("ADD"), "rank", "id") == [(1, "calc.py::add")]
    assert values(e.search_graph(relationship="CALLS", limit=1), "id", "total") == [("checkout.py::process_order", 3)]
    assert e.get_repository_map()["languages"] == {"py": 4}
    assert values(e.find_tests("calc.py", "add"), "name", "score") == [("test_add", 6)]


def test_dead_code_clones_and_docs(engine):
    body = "    x = {0} + 1\n    if x:\n        return x\n    y = x * 2\n    return y\n"
    e = engine({"a.py": "def used(p):\n" + body.format("p") + "\ndef unused(q):\n" + body.format("q").replace("x", "z") + "\nused(1)\n", "b.py": "def _private(): pass\n"})
    assert values(e.find_dead_code(), "path", "name") == [("a.py", "unused"), ("b.py", "_private")]
    assert values(e.detect_clones(), "name") == [("used",), ("unused",)]
    assert values(e.detect_clones("b.py")) == []
    assert values(e.suggest_docs(), "name") == [("used",), ("unused",)]


def test_dataflow(engine):
    e = engine(
        {
            "app.py": "def process():\n    raw = request.get('q')\n    safe = sanitize(raw)\n    query = f'select {safe}'\n    db.execute(query)\n",
            "unsafe.py": "def handle():\n    raw = request.get('q')\n    db.execute(raw)\n",
            "far.py": "def handler():\n    raw = request.get('q')\n    store(raw)\n\ndef store(value):\n    db.execute(value)\n",
            "plain.py": "def add(a, b):\n    c = a + b\n    return c\n",
        }
    )
    flow = e.analyze_dataflow("app.py", "process")
    assert flow["flow_chains"] == [["query", "safe", "raw"]] and [s["kind"] for s in flow["sinks"]] == ["database"]
    assert [(p["verdict"], p["sanitizer"]) for p in e.analyze_dataflow("app.py", "process", "taint")["paths"]] == [("SAFE", "sanitize")]
    assert [(p["verdict"], p["risk"]) for p in e.analyze_dataflow("unsafe.py", "handle", "taint")["paths"]] == [("UNSAFE", "SQL injection")]
    cross = e.analyze_dataflow("far.py", "handler", "cross_taint")
    assert [(p["verdict"], p["functions"]) for p in cross["paths"]] == [("UNSAFE", ["handler", "store"])] and cross["depth_reached"] == 2
    assert e.analyze_dataflow("plain.py", "add", "taint") == {"paths": []} and "error" in e.analyze_dataflow("plain.py", "gone")
    assert sorted(values(e.taint_paths(), "name", "verdict")) == [("handle", "UNSAFE"), ("process", "SAFE")]


def test_refresh_equals_a_new_build(spark, repo, tmp_path_factory):
    root, folder = repo(GRAPH), str(tmp_path_factory.mktemp("store"))
    e = Engine(spark, root, folder)
    assert e.refresh() == {"added": 0, "changed": 0, "deleted": 0, "same": 4}
    repo({"calc.py": "class Calc:\n    def add(self, a, b):\n        return b\n", "new.py": "from calc import Calc\n\ndef fresh():\n    return Calc().add(0, 0)\n"})
    os.remove(os.path.join(root, "pkg/__init__.py"))
    assert e.refresh() == {"added": 1, "changed": 1, "deleted": 1, "same": 2}
    again = Engine(spark, root)
    assert sorted(values(e.edges)) == sorted(values(again.edges)) and e.index_status() == again.index_status()
    assert Engine(spark, root, folder).index_status() == again.index_status()


def test_sql(engine):
    assert values(engine(GRAPH).sql("select count(*) from symbols where kind = :kind", kind="method")) == [(2,)]


@pytest.mark.parametrize("path", ["../../../etc/passwd", "src/../../etc/shadow", "/etc/passwd", "..\\x"])
def test_paths_stay_inside(path):
    with pytest.raises(PathError):
        checked(path)


def test_paths_inside_pass():
    assert checked("calculator.py") == "calculator.py" and checked("a/../b.py") == "a/../b.py" and checked("") == ""


def git(root, *args):
    subprocess.run(["git", "-C", root, "-c", "user.name=Ann", "-c", "user.email=a@x", *args], check=True, capture_output=True)


def test_history(engine, spark, repo):
    root = repo({"calc.py": "a = 1\n", "main.py": "b = 1\n"})
    git(root, "init", "-q")
    for n in range(4):
        repo({"calc.py": f"a = {n}\n\tx = 2\n"} | ({"main.py": f"b = {n}\n"} if n < 3 else {}))
        git(root, "add", "-A")
        git(root, "commit", "-qm", f"c{n}")
    e = Engine(spark, root)
    assert values(e.git_history("churn"), "path", "commits") == [("calc.py", 4), ("main.py", 3)]
    assert values(e.git_history("coupling", min_commits=2), "a", "b", "co_commits", "ratio") == [("calc.py", "main.py", 3, 0.75)]
    assert values(e.git_history("coupling", file_path="main.py", min_commits=2), "ratio") == [(0.75,)]
    assert values(e.git_history("blame", file_path="calc.py"), "author", "lines") == [("Ann", 2)]
    repo({"calc.py": "a = 9\n\ndef f():\n    pass\n"})
    assert gitlog.changed_paths(root, "working") == ["calc.py"] and gitlog.changed_paths(root, "--output=x") == []


def test_git_errors_are_raised_not_empty_answers(spark, repo):
    root = repo({"calc.py": "a = 1\n"})
    git(root, "init", "-q")
    assert values(gitlog.commits(spark, root)) == [] == values(gitlog.blame(spark, root, "calc.py"))  # no commit yet
    git(root, "add", "-A")
    git(root, "commit", "-qm", "c")
    assert values(gitlog.blame(spark, root, "unknown.py")) == []
    with pytest.raises(gitlog.GitError, match="nosuch"):
        gitlog.changed_paths(root, "nosuch")
    for name in os.listdir(os.path.join(root, ".git", "objects")):  # a broken repository
        if len(name) == 2:
            for file in os.listdir(os.path.join(root, ".git", "objects", name)):
                os.remove(os.path.join(root, ".git", "objects", name, file))
    with pytest.raises(gitlog.GitError):
        gitlog.commits(spark, root)


def test_an_added_language_is_read_by_the_workers_and_a_failing_one_contained(spark, repo):
    from loomgraph.parse import Parsed, Symbol, register_language, unregister_language

    def lines(source):
        return Parsed([Symbol(line.split()[1], "function", None, n, n, source=line) for n, line in enumerate(source.splitlines(), 1) if line.startswith("let ")])

    def fail(source):
        return {}[source]  # KeyError

    register_language("letl", "letl", lines)
    register_language("badl", "badl", fail)
    try:
        e = Engine(spark, repo({"a.letl": "let x\nno\nlet y\n", "b.badl": "?", "c.py": "def f(): pass\n"}))
        assert sorted(values(e.symbols, "path", "name", "line")) == [("a.letl", "x", 1), ("a.letl", "y", 3), ("c.py", "f", 1)]
        assert sorted(values(e.files, "path", "has_errors")) == [("a.letl", False), ("b.badl", True), ("c.py", False)]
    finally:
        unregister_language("letl")
        unregister_language("badl")
    assert values(Engine(spark, e.root).files, "path") == [("c.py",)]


def test_a_file_that_cannot_be_read_fails_the_job_and_one_that_has_gone_does_not(spark, repo):
    root = repo({"a.py": "def f(): pass\n"})
    os.mkdir(os.path.join(root, "b.py"))  # reading it is an OSError, even for root
    when = source_files.listing(root)[0][1]
    paths = lambda *names: spark.createDataFrame([(n, when) for n in names], "path string, mtime timestamp")
    assert values(source_files.read(spark, root, paths("a.py", "gone.py")), "path") == [("a.py",)]
    with pytest.raises(Exception, match="b.py"):
        source_files.read(spark, root, paths("a.py", "b.py")).collect()


def test_history_without_a_repository(spark, tmp_path):
    assert values(gitlog.commits(spark, str(tmp_path / "gone"))) == []
