"""Source repositories as tables: a listing, then one Arrow-batched stage that reads and parses each file once.

Spark's own file sources leave out names that begin with `_` or `.` (`__init__.py` among them) and follow links, so
paths are listed here, the upper folders by the driver and large trees by tasks, and the tasks open the files. Repositories must be on
a file system that driver and executors share.
"""

from __future__ import annotations

import gc
import hashlib
import os
import stat
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone
from itertools import accumulate, chain, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lists import LANGUAGES, SKIPPED_FOLDERS, TEST_FOLDERS
from ..parse import added_languages, know_languages
from ..staging import ship, stage

FILES_PER_TASK = 64
#: Folders from which on tasks look for those below, folders that a task walks, and files that it holds at once.
WALKED, FOLDERS_PER_TASK, FILES_AT_ONCE = 1024, 16, 4096


def skipped(part: str) -> bool:
    return part in SKIPPED_FOLDERS or part.endswith(".egg-info")


def own(root: str, folder: str) -> Iterator[tuple[str, datetime]]:
    """(path from the root, time of change) of the source files in a folder, and not below."""
    with os.scandir(os.path.join(root, folder)) as found:
        for e in found:
            if not skipped(e.name) and "." in e.name and e.name.rpartition(".")[2] in LANGUAGES and e.is_file(follow_symlinks=False):
                try:
                    changed = e.stat(follow_symlinks=False).st_mtime
                except FileNotFoundError:  # gone since it was listed
                    continue
                yield f"{folder}/{e.name}" if folder else e.name, datetime.fromtimestamp(changed, timezone.utc)


def entries(root: str, folder: str) -> tuple[list[tuple[str, datetime]], list[str]]:
    """(path from the root, time of change) of a folder's source files, and its folders; no links are followed."""
    files, folders = [], []
    with os.scandir(os.path.join(root, folder)) as found:
        for e in found:
            path = f"{folder}/{e.name}" if folder else e.name
            if skipped(e.name):
                continue
            if e.is_dir(follow_symlinks=False):
                folders.append(path)
            elif e.is_file(follow_symlinks=False) and "." in e.name and e.name.rpartition(".")[2] in LANGUAGES:
                files.append((path, datetime.fromtimestamp(e.stat(follow_symlinks=False).st_mtime, timezone.utc)))
    return files, folders


def walk(root: str, folder: str = "") -> Iterator[tuple[str, datetime]]:
    """entries() of a folder and all below it. A folder that goes meanwhile is left out, one that can't be read is an error."""
    todo = [folder]
    while todo:
        try:
            files, folders = entries(root, todo.pop())
        except FileNotFoundError:
            continue
        yield from files
        todo += folders


def listing(root: str) -> list[tuple[str, datetime]]:
    """(path from the root, time of change) of the source files, in order."""
    return sorted(walk(root))


def subfolders(root: str, folder: str) -> list[str]:
    """The folders in one that a scan goes into."""
    with os.scandir(os.path.join(root, folder)) as found:
        return [f"{folder}/{e.name}" if folder else e.name for e in found if not skipped(e.name) and e.is_dir(follow_symlinks=False)]


def listed(spark: SparkSession, root: str) -> DataFrame:
    """The same as a table (path, mtime): the driver goes down through the folders until there are WALKED or none; tasks list the files of
    those above, walk those below, and hold FILES_AT_ONCE, however many a folder has.
    """
    above, todo = [], [""]
    while todo and len(todo) < WALKED:
        there = [folder for folder in todo if os.path.isdir(os.path.join(root, folder))]
        above += there
        todo = [f for folder in there for f in subfolders(root, folder)]
    kind = "path string, mtime timestamp"
    ship(spark)
    added = added_languages()

    def of_one(folder: str) -> Iterator[tuple[str, datetime]]:
        try:
            yield from own(root, folder)
        except FileNotFoundError:  # gone since the driver saw it
            return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know_languages(added)
        schema = pa.schema([("path", pa.string()), ("mtime", pa.timestamp("us", "UTC"))])
        for batch in batches:
            for folder, whole in zip(batch.column("folder").to_pylist(), batch.column("whole").to_pylist()):
                found = walk(root, folder) if whole else of_one(folder)
                while rows := list(islice(found, FILES_AT_ONCE)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    asked = [(f, False) for f in above] + [(f, True) for f in todo]
    parts = max(1, -(-len(asked) // FOLDERS_PER_TASK))
    return spark.createDataFrame(asked, "folder string, whole boolean").repartition(parts).mapInArrow(run, kind)


def inside(path: str) -> bool:
    """Whether a scan of the root would take a file of this path."""
    parts = path.split("/")
    return not os.path.isabs(path) and ".." not in parts and not any(map(skipped, parts)) and "." in parts[-1] and parts[-1].rpartition(".")[2] in LANGUAGES


def present(paths: DataFrame, root: str) -> DataFrame:
    """(path, mtime) of the distinct paths that a scan would take; mtime is null where no such file is there. Tasks look, not the driver."""
    ship(paths.sparkSession)
    added = added_languages()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know_languages(added)
        schema = pa.schema([("path", pa.string()), ("mtime", pa.timestamp("us", "UTC"))])
        for batch in batches:
            taken, times = [p for p in batch.column("path").to_pylist() if inside(p)], []
            for path in taken:
                full = os.path.join(root, path)
                try:
                    found = os.lstat(full)
                except (FileNotFoundError, NotADirectoryError):
                    found = None
                times.append(datetime.fromtimestamp(found.st_mtime, timezone.utc) if found and stat.S_ISREG(found.st_mode) else None)
            yield pa.RecordBatch.from_arrays([pa.array(taken, pa.string()), pa.array(times, pa.timestamp("us", "UTC"))], schema=schema)

    return paths.select("path").where("path is not null").distinct().mapInArrow(run, "path string, mtime timestamp")


def is_test_path(path: str) -> bool:
    *folders, name = path.split("/")
    return (
        any(f in TEST_FOLDERS for f in folders)
        or name in TEST_FOLDERS
        or name.startswith("test_")
        or any(mark in name for mark in ("_test.", ".test.", ".spec."))
        or (name[:1].isupper() and "Test" in name)
    )


_SYMBOL = pa.struct(
    [
        ("name", pa.string()), ("kind", pa.string()), ("parent", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("params", pa.string()), ("doc", pa.string()),
        ("source", pa.string()), ("norm", pa.string()), ("breakdown", pa.map_(pa.string(), pa.int32())), ("calls", pa.list_(pa.string())),
        ("variables", pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32()), ("type", pa.string()), ("kind", pa.string())]))),
        ("assigns", pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32()), ("names", pa.list_(pa.string())), ("expr", pa.string())]))),
        ("call_sites", pa.list_(pa.struct([("expr", pa.string()), ("line", pa.int32())]))),
    ]
)
_PARSED = pa.schema(
    [
        ("path", pa.string()), ("language", pa.string()), ("sha256", pa.string()), ("mtime", pa.timestamp("us", "UTC")), ("is_test", pa.bool_()), ("has_errors", pa.bool_()), ("n_lines", pa.int32()),
        ("source", pa.string()), ("symbols", pa.list_(_SYMBOL)), ("imports", pa.list_(pa.struct([("line", pa.int32()), ("text", pa.string())]))),
        ("occurrences", pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32()), ("col", pa.int32())]))),
    ]
)
PARSED_KIND = (
    "path string, language string, sha256 string, mtime timestamp, is_test boolean, has_errors boolean, n_lines int, source string, "
    "symbols array<struct<name: string, kind: string, parent: string, line: int, end_line: int, params: string, doc: string, source: string, norm: string, breakdown: map<string, int>, "
    "calls: array<string>, variables: array<struct<name: string, line: int, type: string, kind: string>>, "
    "assigns: array<struct<name: string, line: int, names: array<string>, expr: string>>, call_sites: array<struct<expr: string, line: int>>>>, "
    "imports array<struct<line: int, text: string>>, occurrences array<struct<name: string, line: int, col: int>>"
)


def parsed_row(path: str, raw: bytes, mtime: datetime | None) -> tuple:
    """A file and all that its text says, in the order of _PARSED; what is nested is in the order of its fields."""
    from ..parse import normalised, parse_source

    source = raw.decode("utf-8", errors="replace")
    ending = path.rpartition(".")[2]
    language = LANGUAGES[ending]
    p = parse_source(source, ending)
    norm = lambda s: s.norm if s.norm is not None else normalised(s.source, language) if language in _lexed() else None
    symbols = [
        (
            s.name, s.kind, s.parent, s.line, s.end_line, s.params, s.doc, s.source, norm(s) if s.callable else None,
            list(s.breakdown.items()), s.calls, s.variables, s.assigns, s.call_sites,
        )
        for s in p.symbols
    ]
    n_lines = source.count("\n") + bool(source and not source.endswith("\n"))
    return path, ending, hashlib.sha256(raw).hexdigest(), mtime, is_test_path(path), p.has_errors, n_lines, source, symbols, p.imports, p.occurrences


def _column(values: Sequence, kind: pa.DataType) -> pa.Array:
    """Values as an array of a kind, field by field, so that no row is looked up by names. Nested values are there, if empty."""
    if pa.types.is_struct(kind):
        fields = list(kind)
        columns = zip(*values) if values else [()] * len(fields)
        return pa.StructArray.from_arrays([_column(c, f.type) for c, f in zip(columns, fields)], fields=fields)
    if not pa.types.is_nested(kind):
        return pa.array(values, kind)
    offsets = pa.array(accumulate(map(len, values), initial=0), pa.int32())
    inner = list(chain.from_iterable(values))
    if pa.types.is_map(kind):
        keys, items = zip(*inner) if inner else ((), ())
        return pa.MapArray.from_arrays(offsets, _column(keys, kind.key_type), _column(items, kind.item_type), kind)
    return pa.ListArray.from_arrays(offsets, _column(inner, kind.value_type), kind)


def record_batch(rows: list[tuple], schema: pa.Schema = _PARSED) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([_column(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """A batch for each FILES_PER_TASK files, so a task holds no more of what its files say, however many it has.

    What a file says is made of lists and tuples that point at nothing above them, so cycles are not looked for until a batch is made.
    """
    while True:
        gc.disable()
        try:
            held = list(islice(rows, FILES_PER_TASK))
            batch = record_batch(held) if held else None
        finally:
            gc.enable()
        if batch is None:
            return
        del held
        yield batch


def _lexed() -> frozenset[str]:
    from ..parse.lexer import STYLES

    return frozenset(STYLES)


def read(spark: SparkSession, root: str, paths: DataFrame | None = None) -> DataFrame:
    """A row per source file under root with everything parsed; `paths` (path, mtime), staged, in place of a listing.

    A file that has gone since the listing is left out; one that can't be read fails the job.
    """
    ship(spark)
    added = added_languages()
    if paths is None:
        paths = stage(listed(spark, root))
    # a staged list has few small files, which Spark would put into one task
    paths = paths.repartition(max(1, -(-paths.count() // FILES_PER_TASK)), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know_languages(added)
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, mtime in zip(batch.column("path").to_pylist(), batch.column("mtime").to_pylist()):
                    try:
                        with open(os.path.join(root, path), "rb") as f:
                            raw = f.read()
                    except FileNotFoundError:  # gone since the listing
                        continue
                    yield parsed_row(path, raw, mtime)

        yield from _batches(rows())

    return paths.mapInArrow(run, PARSED_KIND)


def parse(texts: DataFrame) -> DataFrame:
    """The same rows for files that are a table already: texts has path and source, and paths are as from a root."""
    ship(texts.sparkSession)
    added = added_languages()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know_languages(added)
        # a text at a time: a batch of Spark's may have ten thousand
        yield from _batches(parsed_row(path.as_py(), source.as_py().encode(), None) for batch in batches for path, source in zip(batch.column("path"), batch.column("source")))

    return texts.where("source is not null").select("path", "source").mapInArrow(run, PARSED_KIND)


# The tables of a repository, all from one staged table of parsed files


def qualified(path: Column, parent: Column, name: Column) -> Column:
    return F.concat(path, F.lit("::"), F.coalesce(F.concat(parent, F.lit(".")), F.lit("")), name)


def files(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "language", "sha256", "mtime", "is_test", "has_errors", "n_lines", F.size("symbols").alias("n_symbols"))


def _repeated(symbols: str) -> Column:
    """The places of a file's symbols that have another of their name and parent further down."""
    named = F.array_sort(F.transform(symbols, lambda s, i: F.struct(F.concat(F.coalesce(F.concat(s["parent"], F.lit(".")), F.lit("")), s["name"]).alias("key"), s["line"].alias("line"), i.alias("at"))))
    return F.filter(F.zip_with(named, F.slice(named, 2, F.size(symbols)), lambda a, b: F.when(a["key"] == b["key"], a["at"])), lambda at: at.isNotNull())


def symbols(parsed: DataFrame, once: bool = True) -> DataFrame:
    """A row per symbol; `ordinal` is its place in the file, `id` its qualified name, and `is_last` whether no further one in the file has
    that. Not `once`: paths may repeat.
    """
    marked = parsed.withColumn("_repeated", _repeated("symbols"))
    each = marked.select("path", "language", F.col("is_test").alias("in_test"), "_repeated", F.posexplode("symbols").alias("ordinal", "s"))
    flat = each.select("path", "language", "in_test", "ordinal", "s.*", (~F.array_contains("_repeated", F.col("ordinal"))).alias("is_last"))
    test = F.col("in_test") | F.col("name").startswith("test_") | F.col("name").startswith("Test")
    complexity = F.when(F.col("kind").isin("function", "method"), 1 + F.aggregate(F.map_values("breakdown"), F.lit(0), lambda a, x: a + x))
    out = flat.withColumns(
        {
            "id": qualified(F.col("path"), F.col("parent"), F.col("name")),
            "parent_id": F.concat("path", F.lit("::"), "parent"),
            "is_test": test,
            "is_entry_point": F.col("name").isin("main", "__main__") & F.col("parent").isNull(),
            "complexity": complexity,
            "line_count": F.col("end_line") - F.col("line") + 1,
        }
    ).drop("in_test")
    if once:
        return out
    lowest = Window.partitionBy("id").orderBy(F.col("line").desc(), F.col("ordinal").desc())
    return out.withColumn("is_last", F.row_number().over(lowest) == 1)


def occurrences(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.inline("occurrences"))


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.inline("imports"))
