"""Text forms, the stream of changed paths, the entry points."""

import os

from conftest import values

from loomgraph import render
from loomgraph.engine import Engine
from loomgraph.operators.store import Versions
from loomgraph.streaming.refresh import apply_paths, refresh_stream

FILES = {"calc.py": 'class Calc:\n    """Adds."""\n    def add(self, a, b):\n        return a + b\n\ndef lonely():\n    pass\n', "main.py": "from calc import Calc\n\ndef run():\n    return Calc().add(1, 2)\nrun()\n"}


def test_text_forms(spark, repo):
    e = Engine(spark, repo(FILES))
    assert render.skeleton(e.get_file_skeleton("calc.py")) == 'class Calc → line 1\n  "Adds."\n  def add(self, a, b) (in Calc) → line 3\ndef lonely() → line 6'
    assert render.skeleton(e.get_file_skeleton("calc.py"), compact=True) == "cls Calc:1 # Adds.\n.add(self,a,b):3\nfn lonely():6"
    assert render.skeletons(e.get_skeletons(["main.py", "gone.py"])) == "=== main.py ===\ndef run() → line 3\n\n=== gone.py ===\nFile not found or empty: gone.py"
    assert render.symbol(e.get_symbol("calc.py", "lonely")) == "# calc.py:6\ndef lonely():\n    pass"
    assert render.symbols(e.get_symbols([{"file_path": "calc.py", "symbol_name": "no"}])) == "Symbol 'no' not found in calc.py"
    assert render.references(e.find_references("add"), "add") == "References to 'add':\n  calc.py:3\n  main.py:4"
    assert render.complexity(e.get_complexity("calc.py", "add")) == "Complexity of add() in calc.py: 1"
    assert render.dead_code(e.find_dead_code()) == "calc.py\n  function lonely() → line 6\n\n1 dead symbol in 1 file"
    assert render.blast_radius(e.get_blast_radius("calc.py", "add"), "add") == "Blast radius of 'add':\nDirect callers:\n  main.py: run()\n1 affected function in 1 file"
    assert render.clones(e.detect_clones()) == "No clones found."
    assert render.hot_paths(e.find_hot_paths()).startswith("1. calc.py: add() → line 3  (score=1, complexity=1, calls=1)")
    graph = render.dependency_graph(e.get_dependency_graph())
    assert graph == {"format": "mermaid", "content": 'graph LR\n  n0["calc.py"]\n  n1["main.py"]\n  n1 --> n0', "nodes": 2, "edges": 1}
    assert render.dependency_graph(e.get_dependency_graph("gone.py"))["edges"] == 0
    assert render.suggested_docs(e.suggest_docs("calc.py", "add")) == "calc.py: add(self, a, b) → line 3\n  called by: main.py::run\n  variables: a, b" or "called by: main.py::run" in render.suggested_docs(e.suggest_docs("calc.py", "add"))


def test_stream_of_changed_paths(spark, repo, tmp_path_factory):
    root, work = repo(FILES), tmp_path_factory.mktemp("stream")
    events, folder = str(work / "events"), str(work / "store")
    write = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string").coalesce(1).write.mode("append").json(events)
    run = lambda: refresh_stream(spark.readStream.schema("path string").json(events), root, folder, str(work / "checkpoint")).awaitTermination()
    write("calc.py", "main.py", "../outside.py", "notes.txt", "gone.py")
    run()
    versions = Versions(spark, folder)
    assert sorted(values(versions.read("parsed"), "path")) == [("calc.py",), ("main.py",)]
    repo({"calc.py": "def other():\n    pass\n"})
    os.remove(os.path.join(root, "main.py"))
    write("calc.py", "main.py")
    run()
    assert versions.last() == 2 and values(versions.read("parsed").selectExpr("path", "symbols.name")) == [("calc.py", ["other"])]
    assert versions.read("parsed", 1).count() == 2
    repo({"calc.py": "def other():\n    pass\n"})  # written again with what it holds
    write("calc.py", "main.py", "gone.py", "node_modules/x.py")
    run()
    assert versions.last() == 2
    apply_paths(versions, root, spark.createDataFrame([("calc.py",), (None,), ("calc.py",), ("calc.py/below.py",)], "path string"))  # a replay
    assert versions.last() == 2
    repo({"lib/new.py": "def new():\n    pass\n"})
    write("lib/new.py")
    run()
    assert versions.last() == 3 and sorted(values(versions.read("parsed"), "path")) == [("calc.py",), ("lib/new.py",)]


def test_entry_points(spark):
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert oracles.keys() <= queries.keys() and len(queries) >= 44
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and rows[0]["degree"] >= rows[-1]["degree"]


def test_the_library_stands_without_the_corpus_folder(tmp_path):
    """A copy without the optional folder and the pipeline imports and keeps its other queries."""
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(top, "loomgraph"), tmp_path / "loomgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(top, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 44 and not any(n.startswith('op') or n == 'pipeline' for n in q), list(q); assert e.oracle_sql().keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""})
