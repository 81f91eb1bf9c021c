"""Text kernels on documents, pages and parts, beside SQL. No \\b, \\w or \\s: both engines must read the patterns alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import text
from ..sources.tables import table
from ..staging import stage
from .registry import Registry

_REGISTRY = Registry()
query, QUERIES, ORACLES = _REGISTRY.query, _REGISTRY.queries, _REGISTRY.oracles


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")


@query(r"""SELECT DISTINCT page_id AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages""")
def import_edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst")).distinct()


@query(r"""SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading, len(regexp_extract_all(html, '<a href="'))::BIGINT AS links, strlen(html)::BIGINT AS n_bytes FROM pages""")
def skeleton_headings(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return pages.select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"), F.regexp_count("html", F.lit('<a href="')).cast("long").alias("links"), F.octet_length("html").cast("long").alias("n_bytes"))


@query(
    """WITH want AS (SELECT * FROM (VALUES (1::BIGINT, 1), (2, 2), (3, 3), (999999999, 1)) t(id, line))
    SELECT id, line, string_split(text, chr(10))[line] AS source FROM want LEFT JOIN documents ON doc_id = id"""
)
def symbol_source(spark: SparkSession, d: str) -> DataFrame:
    """A list of requests, misses kept."""
    want = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (999999999, 1)], "id long, line int")
    docs = _docs(spark, d).select("id", "text")
    # the requests are a short list of the caller's
    return docs.join(F.broadcast(want), "id", "right").select("id", "line", F.get(F.split("text", "\n"), F.col("line") - 1).alias("source"))


@query(
    r"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
    SELECT id, line::INTEGER AS line, len(list_filter(string_split_regex(t, '[^A-Za-z0-9_]+'), lambda x: x = 'that'))::BIGINT AS n FROM l WHERE n > 0"""
)
def references_token(spark: SparkSession, d: str) -> DataFrame:
    return text.occurrences(_docs(spark, d).select("id", "text"), "that")


_BRANCHES = {"of": 1, "the": 2, "der": 1, "que": 1, "les": 3}
_SPLIT = "string_split_regex(text, '[^A-Za-z]+')"
_COUNTS = ", ".join(f"len(list_filter(parts, lambda x: x = '{t}'))::BIGINT AS n_{t}" for t in _BRANCHES)


@query(f"SELECT id, {', '.join('n_' + t for t in _BRANCHES)}, (1 + {' + '.join(f'n_{t} * {w}' for t, w in _BRANCHES.items())})::BIGINT AS total FROM (SELECT doc_id AS id, {_COUNTS} FROM (SELECT doc_id, {_SPLIT} AS parts FROM documents))")
def complexity_branches(spark: SparkSession, d: str) -> DataFrame:
    total, counts = text.branch_counts(F.col("words"), _BRANCHES)
    docs = _docs(spark, d).select("id", F.split("text", "[^A-Za-z]+").alias("words"))
    return docs.select("id", *[c.alias(f"n_{t}") for t, c in counts.items()], total.alias("total"))


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) >= 2")
def clone_exact(spark: SparkSession, d: str) -> DataFrame:
    return text.clone_groups(_docs(spark, d), F.col("text"))


_NORMAL = r"regexp_replace(regexp_replace(text, '[A-Za-z_][A-Za-z0-9_]*', '_ID_', 'g'), '(^|[^A-Za-z0-9_])[0-9]+', '\1_NUM_', 'g')"


@query(f"SELECT sha256({_NORMAL}) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) >= 2")
def clone_normalized(spark: SparkSession, d: str) -> DataFrame:
    return text.clone_groups(_docs(spark, d), text.normalised(F.col("text")))


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) >= 2 AND bool_or(lang = 'de')")
def clone_of_file(spark: SparkSession, d: str) -> DataFrame:
    return text.clone_groups(_docs(spark, d), F.col("text"), having=F.bool_or(F.col("lang") == "de"))


@query(
    """SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)"""
)
def dead_symbols(spark: SparkSession, d: str) -> DataFrame:
    uses = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey", "p_name").join(uses, "p_partkey", "left_anti")


@query(
    """SELECT p_partkey, p_name, p_brand FROM part p WHERE NOT EXISTS (
      SELECT 1 FROM part u WHERE u.p_size > 45 AND u.p_name = p.p_name AND NOT (u.p_brand = p.p_brand AND u.p_size = p.p_size))"""
)
def dead_with_residual(spark: SparkSession, d: str) -> DataFrame:
    """A name counts as used by large parts, except at the part's own brand and size."""
    part = table(spark, d, "part")
    symbols = part.select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("path"), F.col("p_size").alias("line"))
    uses = symbols.where("line > 45").select("name", "path", "line")
    return text.dead(symbols, uses).select("p_partkey", F.col("name").alias("p_name"), F.col("path").alias("p_brand"))


def _holders(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, id, lang) of documents that contain an item's words, all of them in a row."""
    docs = _docs(spark, d)
    items = stage(table(spark, d, "benchmark").select("item_id", F.col("text").alias("item")))
    found = stage(text.holders(docs.select("id", "text"), items))
    return found.join(docs.select(F.col("id").alias("_id"), "lang"), F.col("id").eqNullSafe(F.col("_id"))).select("item_id", "id", "lang").distinct()


_HOLD = """holders AS (SELECT DISTINCT item_id, doc_id AS id, lang FROM benchmark b JOIN documents d ON contains(' ' || d.text || ' ', ' ' || b.text || ' '))"""


@query(f"WITH {_HOLD} SELECT item_id, id FROM holders")
def tests_edges(spark: SparkSession, d: str) -> DataFrame:
    return _holders(spark, d).select("item_id", "id")


@query(
    f"""WITH {_HOLD}, scored AS (SELECT item_id, id, (3 + CASE WHEN lang = 'en' THEN 2 ELSE 0 END + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END)::INTEGER AS score FROM holders)
    SELECT item_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS r FROM scored) WHERE r = 1"""
)
def test_discovery(spark: SparkSession, d: str) -> DataFrame:
    score = F.lit(3) + F.when(F.col("lang") == "en", 2).otherwise(0) + F.when(F.col("id") % 2 == 0, 1).otherwise(0)
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "id")
    return _holders(spark, d).select("item_id", "id", score.alias("score")).withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


@query(
    """SELECT d.doc_id, d.source, s.langs FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id
    JOIN (SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source) s ON s.source = d.source"""
)
def suggest_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a label, with what their source is written in as context."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    context = docs.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))
    return docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").join(context, "source").select("doc_id", "source", "langs")
