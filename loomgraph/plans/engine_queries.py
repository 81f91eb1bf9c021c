"""Questions about the repository that is made from the parts which go through the engine's folder, refresh, graph of names and map."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..sources import datasource
from ..staging import shared_dir
from . import language_queries
from .code_queries import _ALL, _FN, _SEVENTH, _SYMBOLS, _TEXTS, _seventh, engine, sources
from .registry import Registry

_REGISTRY = Registry(lambda f: partial(_asked, f))
_FOLDERS = Registry()
query, in_folder = _REGISTRY.query, _FOLDERS.query


def _asked(f, spark: SparkSession, d: str) -> DataFrame:
    return f(engine(spark, d))


def written(texts: DataFrame, root: str) -> None:
    """Write (path, source) as files under a folder that all executors share; a task that runs again writes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            for path, source in zip(batch.column("path").to_pylist(), batch.column("source").to_pylist()):
                full = os.path.join(root, path)
                if (folder := os.path.dirname(full)) not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                with open(full, "w", encoding="utf-8") as out:
                    out.write(source)
            yield pa.RecordBatch.from_arrays([batch.column("path")], names=["path"])

    texts.select("path", "source").mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


def removed(paths: DataFrame, root: str) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                if os.path.exists(os.path.join(root, path)):
                    os.remove(os.path.join(root, path))
            yield batch

    paths.select("path").mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


def _folder(spark: SparkSession) -> str:
    return shared_dir(spark).removeprefix("file://").removeprefix("file:")


@in_folder(f"WITH {_FN}, {_TEXTS} SELECT path, 'py' AS language, sha256(source) AS sha256, is_test, n_lines::INTEGER AS n_lines, n_symbols::INTEGER AS n_symbols FROM all_files")
def code_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every file is there again under folders that a scan leaves out, and under endings that it doesn't know."""
    root, texts = _folder(spark), sources(spark, d)
    skipped = [F.concat(F.lit(f"{folder}/"), "path") for folder in ("node_modules", "pkg/__pycache__", ".venv/lib", "x.egg-info")]
    beside = F.array("path", *skipped, F.concat("path", F.lit(".txt")), F.replace("path", F.lit(".py"), F.lit("")))
    # a text is made once, and the task that has it writes all its files
    texts = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    written(texts.select(F.explode(beside).alias("path"), "source"), root)
    return Engine(spark, root).files.select("path", "language", "sha256", "is_test", "n_lines", "n_symbols")


#: What the second state of the folder differs by: a third of the modules get a function, a fifth are deleted.
_ADDED, _GONE = "m % 3 = 0 AND m % 5 <> 1", "m % 5 = 1"


def _changed(spark: SparkSession, d: str) -> tuple[Engine, dict[str, int]]:
    """An engine that has been asked for its edges, and then for what has changed."""
    root, texts = _folder(spark), sources(spark, d)
    written(texts, root)
    e = Engine(spark, root)
    e.edges.count()
    m = F.regexp_extract("path", "^pkg/m_([0-9]+)[.]py$", 1)
    modules = texts.where(m != "").withColumn("m", m.cast("long"))
    written(modules.where(_ADDED).select("path", F.concat("source", F.lit("\ndef added_"), "m", F.lit("(a):\n    ext_0(a)\n")).alias("source")), root)
    removed(modules.where(_GONE), root)
    return e, e.refresh()


_EXTRA = "chr(10) || 'def added_' || m || '(a):' || chr(10) || '    ext_0(a)' || chr(10)"


@in_folder(
    f"""WITH {_FN}, {_TEXTS}, marked AS (SELECT all_files.*, m, coalesce({_ADDED}, FALSE) AS more, coalesce({_GONE}, FALSE) AS gone FROM all_files LEFT JOIN klass USING (path)
    ), n AS (SELECT 0::BIGINT AS added, count(*) FILTER (WHERE more) AS changed, count(*) FILTER (WHERE gone) AS deleted, count(*) FILTER (WHERE NOT more AND NOT gone) AS same FROM marked)
    SELECT path, sha256(source || CASE WHEN more THEN {_EXTRA} ELSE '' END) AS sha256, (n_symbols + more::INTEGER)::INTEGER AS n_symbols, added, changed, deleted, same FROM marked, n WHERE NOT gone"""
)
def code_refresh(spark: SparkSession, d: str) -> DataFrame:
    e, counts = _changed(spark, d)
    return e.files.select("path", "sha256", "n_symbols", *[F.lit(counts[c]).cast("long").alias(c) for c in ("added", "changed", "deleted", "same")])


_LINKS = "'.py' AS other FROM imp UNION SELECT DISTINCT path, 'pkg/m_' || m || '.py' FROM t"
#: The edges of what is left.
_AFTER = _ALL.replace("AS line FROM sized\n)", f"AS line FROM sized WHERE NOT {_GONE}\n)").replace(_LINKS, _LINKS.replace("FROM imp", f"FROM imp WHERE NOT {_GONE} AND cm % 5 <> 1").replace("FROM t", f"FROM t WHERE NOT {_GONE}"))


@in_folder(f"WITH {_AFTER} SELECT * FROM edges UNION ALL SELECT path || '::added_' || m, '?::ext_0', 'CALLS', 0.5 FROM klass WHERE {_ADDED}")
def code_refresh_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of which those that the change doesn't concern are the old ones."""
    return _changed(spark, d)[0].edges


@in_folder(
    f"""WITH {language_queries._FN}, files AS (SELECT path, e AS language, CASE e WHEN 'rs' THEN size_line + 3 WHEN 'go' THEN size_line + 2 ELSE end_line END AS n_lines FROM klass)
    SELECT path, language, n_lines::INTEGER AS n_lines FROM files WHERE language IN ('go', 'rs', 'rb') AND NOT starts_with(path, 'rb/') UNION ALL SELECT path, language, n_lines::INTEGER FROM files WHERE starts_with(path, 'java/java_')"""
)
def code_data_source(spark: SparkSession, d: str) -> DataFrame:
    """Languages and folders that the data source is asked for; it opens no other files."""
    root = _folder(spark)
    written(language_queries.language_sources(spark, d), root)
    datasource.register(spark)
    files = lambda **options: spark.read.format("loomgraph_files").options(**options).load(root)
    asked = files(languages="go,rs,rb").where(~F.col("path").startswith("rb/")).unionByName(files(prefix="java/java_"))
    return asked.select("path", "language", F.length(F.regexp_replace("source", "[^\n]", "")).alias("n_lines"))


#: names links functions and what they call by file and name alone.
_NAMES = f"""{_FN}, {_SYMBOLS}, named_calls AS (
  SELECT path || '::' || f AS src, callee AS name FROM fn WHERE calls = 1 UNION SELECT path || '::' || f, 'ext_' || (s % 5) FROM fn UNION SELECT path || '::' || f, unnest(['input', 'execute']) FROM fn WHERE outside
  UNION SELECT path || '::' || f, 'sanitize' FROM fn WHERE safe UNION SELECT path || '::test_' || f, f FROM t
), names AS (SELECT DISTINCT src, coalesce(path || '::' || name, '?::' || name) AS dst FROM named_calls LEFT JOIN symbols USING (name)
), known AS (SELECT * FROM names WHERE NOT starts_with(dst, '?::'))"""


@query(f"WITH {_NAMES} SELECT src, dst FROM names")
def code_name_graph(e: Engine) -> DataFrame:
    return e.name_calls


#: More than any shortest way here; the engine goes on until nothing new is reached.
_FAR = 200


@query(
    f"""WITH RECURSIVE {_NAMES}, up AS (SELECT 'pkg/m_0.py::' || {_SEVENTH} AS id, 0 AS depth UNION SELECT src, depth + 1 FROM up JOIN known ON dst = id WHERE depth < {_FAR}
    ), down AS (SELECT 'pkg/m_0.py::' || {_SEVENTH} AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM down JOIN known ON src = id WHERE depth < {_FAR}
    ), reached AS (SELECT 'caller' AS role, id, min(depth)::INTEGER AS depth FROM up GROUP BY id UNION ALL SELECT 'dependency', id, min(depth)::INTEGER FROM down GROUP BY id
    ), places AS (SELECT path, name, path || '::' || name AS id, min(line)::INTEGER AS line FROM symbols GROUP BY path, name)
    SELECT role, path, name, depth, line FROM reached JOIN places USING (id) WHERE depth > 0"""
)
def code_blast_radius(e: Engine) -> DataFrame:
    return e.get_blast_radius("pkg/m_0.py", _seventh(e))


@query(
    f"""WITH {_ALL}, hot AS (SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id) AS place FROM last JOIN deg USING (id) WHERE NOT is_test QUALIFY place <= 5
    ), folders AS (SELECT 'pkg/' AS folder, count(*) AS n FROM klass UNION ALL SELECT 'tests/', count(DISTINCT path) FROM t)
    SELECT 'languages' AS section, 1 AS place, 'py' AS item, sum(n)::BIGINT AS n FROM folders UNION ALL SELECT 'major_paths', row_number() OVER (ORDER BY n DESC, folder), folder, NULL FROM folders WHERE n > 0
    UNION ALL SELECT 'hotspots', place, id, degree FROM hot UNION ALL SELECT 'start_here', place, id, NULL FROM hot UNION ALL SELECT 'test_roots', 1, folder, NULL FROM folders WHERE folder = 'tests/' AND n > 0
    UNION ALL SELECT 'stats', row_number() OVER (ORDER BY what), what, n FROM (SELECT 'files' AS what, sum(n)::BIGINT AS n FROM folders UNION ALL SELECT 'symbols', count(*) FROM last UNION ALL SELECT 'edges', count(*) FROM edges)"""
)
def code_map(e: Engine) -> DataFrame:
    """The report as rows: section, place in it, item and its number."""
    said = e.get_repository_map()
    rows = [("languages", i + 1, k, n) for i, (k, n) in enumerate(said["languages"].items())]
    rows += [(s, i + 1, item, None) for s in ("major_paths", "entry_points", "start_here", "test_roots") for i, item in enumerate(said[s])]
    rows += [("hotspots", i + 1, h["symbol"], h["degree"]) for i, h in enumerate(said["hotspots"])]
    rows += [("stats", i + 1, what, said["stats"][what]) for i, what in enumerate(("edges", "files", "symbols"))]
    return e.spark.createDataFrame(rows, "section string, place long, item string, n long")


@query(
    f"""WITH RECURSIVE {_NAMES}, nodes AS (SELECT DISTINCT path || '::' || name AS id FROM symbols
    ), links AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM known
    ), n AS (SELECT count(*)::DOUBLE AS n FROM nodes
    ), dangling AS (SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM links)
    ), steps AS (
      SELECT 0 AS step, id, 1.0::DOUBLE / n AS score FROM nodes, n
      UNION ALL
      SELECT any_value(step) + 1, x.id, 0.15::DOUBLE / any_value(n) + 0.85::DOUBLE * any_value(mass) / any_value(n) + 0.85::DOUBLE * coalesce(sum(gain), 0)
      FROM nodes x, n, (SELECT max(step) AS step, coalesce(sum(score) FILTER (WHERE id IN (SELECT id FROM dangling)), 0) AS mass FROM steps) m
      LEFT JOIN (SELECT dst, sum(score * share) AS gain FROM steps JOIN links ON links.src = steps.id GROUP BY dst) g ON g.dst = x.id
      WHERE step < 25 GROUP BY x.id
    ) SELECT split_part(id, '::', 1) AS path, split_part(id, '::', 2) AS name, round(score, 6) AS score FROM steps WHERE step = 25 ORDER BY round(score, 6) DESC, path, name LIMIT 20"""
)
def code_rank(e: Engine) -> DataFrame:
    return e.rank_symbols()


QUERIES = _REGISTRY.queries | _FOLDERS.queries
ORACLES = _REGISTRY.oracles | _FOLDERS.oracles
