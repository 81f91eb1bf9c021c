"""Source files as a data source against a scan, and what options keep from being opened."""

import pytest
from conftest import values
from pyspark.sql import functions as F

from loomgraph.sources import datasource, files

FILES = {
    "a.py": "x = 1\n", "pkg/b.go": "package pkg\n", "pkg/deep/c.py": "é\n", "pkg/deep/er/d.rs": "", "pkgs/e.py": "y\n", "lib/f.py": "z\n",
    "node_modules/g.js": "no\n", "pkg/notes.txt": "no\n", "_hidden/__init__.py": "h\n",
}


@pytest.fixture
def frame(spark, repo):
    datasource.register(spark)
    root = repo(FILES)
    return root, spark.read.format("loomgraph_files").load(root)


def test_all_files_are_those_of_a_scan(frame):
    root, df = frame
    assert sorted(values(df, "path")) == [(p,) for p, _ in files.listing(root)]
    assert sorted(values(df, "path", "language", "source")) == sorted((p, p.rpartition(".")[2], FILES[p]) for p, _ in files.listing(root))


@pytest.mark.parametrize("options", [{"languages": "py"}, {"languages": "go, rs,zz"}, {"prefix": "pkg/"}, {"prefix": "pkg/deep/c"}, {"prefix": "pkg", "languages": "py"}, {"languages": ""}, {"prefix": "gone/"}])
def test_options_leave_what_they_say(spark, frame, options):
    root, _ = frame
    endings = [e.strip() for e in options["languages"].split(",")] if "languages" in options else None
    want = [p for p, _ in files.listing(root) if p.startswith(options.get("prefix", "")) and (endings is None or p.rpartition(".")[2] in endings)]
    assert sorted(values(spark.read.format("loomgraph_files").options(**options).load(root), "path")) == [(p,) for p in want]


def test_frames_with_filters_and_options_in_one_plan(spark, frame):
    root, df = frame
    go = spark.read.format("loomgraph_files").option("languages", "go").load(root)
    both = df.where("language = 'py' and path like 'pkg/%'").unionByName(df.where("language = 'rs'")).unionByName(go)
    assert sorted(values(both, "path")) == [("pkg/b.go",), ("pkg/deep/c.py",), ("pkg/deep/er/d.rs",)]


def test_what_options_leave_out_is_not_listed(frame):
    root, _ = frame
    reader = datasource.SourceFilesReader(root, datasource.Wanted(frozenset(["py"]), "pkg/deep/"))
    assert [p for share in reader.partitions() for p, _ in share.files] == ["pkg/deep/c.py"]
    assert [reader.wanted.folder(f) for f in ("pkg", "pkg/deep", "pkg/deep/er", "pkgs", "lib")] == [True, True, True, False, False]


def test_folders_are_walked_by_tasks(frame, monkeypatch):
    root, _ = frame
    monkeypatch.setattr(datasource, "WALKED", 2)
    monkeypatch.setattr(datasource, "FOLDERS_PER_TASK", 1)
    reader = datasource.SourceFilesReader(root)
    shares = reader.partitions()
    assert len(shares) >= 4
    assert sorted(p for s in shares for b in reader.read(s) for p in b.column("path").to_pylist()) == [p for p, _ in files.listing(root)]


def test_a_missing_folder_is_named(spark):
    datasource.register(spark)
    with pytest.raises(Exception, match="folder"):
        spark.read.format("loomgraph_files").load().count()
    assert spark.range(1).select(F.lit(1)).count() == 1
