"""Relational kernels: stores, search, history, flow over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import flow, history, store
from ..sources.tables import table
from .registry import Registry

_REGISTRY = Registry()
query, QUERIES, ORACLES = _REGISTRY.query, _REGISTRY.queries, _REGISTRY.oracles


@query("SELECT lang, count(*) AS files, sum(length(text))::BIGINT AS chars, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines FROM documents GROUP BY lang")
def file_scan_stats(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length(text)).alias("chars"), F.sum(lines).alias("lines"))


@query(
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"""
)
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return store.newest(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    """WITH old AS (SELECT doc_id AS key, sha256(text) AS hash FROM documents WHERE doc_id % 5 <> 0),
    new AS (SELECT doc_id AS key, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 7 <> 0)
    SELECT coalesce(old.key, new.key) AS key, CASE WHEN old.hash IS NULL THEN 'added' WHEN new.hash IS NULL THEN 'deleted' WHEN old.hash = new.hash THEN 'same' ELSE 'changed' END AS status
    FROM old FULL JOIN new ON old.key = new.key"""
)
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two states of the documents, between which some went, some came and some changed."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    old = docs.where("key % 5 <> 0").select("key", F.sha2("text", 256).alias("hash"))
    new = docs.where("key % 7 <> 0").select("key", F.sha2(F.when(F.col("key") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return store.snapshot_diff(old, new)


@query(
    """SELECT p_partkey, p_name, p_type, p_size FROM part
    WHERE contains(lower(p_name), 'a') AND p_type = (SELECT min(p_type) FROM part) AND p_size >= 20 AND contains(lower(p_brand), '1')"""
)
def search_filter(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    kind = part.agg(F.min("p_type")).first()[0]
    return part.where(F.lower("p_name").contains("a") & (F.col("p_type") == kind) & (F.col("p_size") >= 20) & F.lower("p_brand").contains("1")).select("p_partkey", "p_name", "p_type", "p_size")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def repo_map_languages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source || '/' AS path, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, path LIMIT 5")
def repo_map_paths(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.concat("source", F.lit("/")).alias("path"), "n").orderBy(F.col("n").desc(), "path").limit(5)


@query(
    """SELECT event_id, user_id, event_type, lag(event_type) OVER w AS depends_on, lead(event_type) OVER w AS flows_to,
    epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap_us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def flow_chain_events(spark: SparkSession, d: str) -> DataFrame:
    return flow.event_chain(table(spark, d, "events"))


@query(
    """WITH s AS (SELECT event_id, user_id, event_type,
      max(CASE WHEN event_type = 'signup' THEN ts END) OVER w AS source_ts, max(CASE WHEN event_type = 'view' THEN ts END) OVER w AS clean_ts
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id, user_id, CASE WHEN source_ts IS NULL THEN 'CLEAN' WHEN clean_ts > source_ts THEN 'SAFE' ELSE 'UNSAFE' END AS verdict FROM s WHERE event_type = 'purchase'"""
)
def taint_sessions(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return flow.taint_in_order(events, by="user_id", order=["ts", "event_id"], at="ts", source=F.col("event_type") == "signup", sanitizer=F.col("event_type") == "view", sink=F.col("event_type") == "purchase").select(
        "event_id", "user_id", "verdict"
    )


@query(
    """SELECT u.conv_id, u.turn AS source_turn, a.turn AS sink_turn, a.turn - u.turn AS hops FROM conversations u JOIN conversations a USING (conv_id)
    WHERE u.role = 'user' AND contains(u.text, 'the') AND a.role = 'assistant' AND a.turn > u.turn AND a.turn <= u.turn + 3"""
)
def taint_cross(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    return flow.reach_later(turns.where((F.col("role") == "user") & F.col("text").contains("the")), turns.where("role = 'assistant'"), by="conv_id", step="turn", most=3).withColumnRenamed("source_step", "source_turn").withColumnRenamed("sink_step", "sink_turn")


@query(
    """SELECT source AS author, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines FROM documents GROUP BY source"""
)
def blame_summary(spark: SparkSession, d: str) -> DataFrame:
    blame = table(spark, d, "documents").select(F.col("source").alias("author"), F.explode(F.split("text", "\n")))
    return history.blame_summary(blame)


def _commits(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path"), "l_suppkey", F.col("l_quantity").alias("additions"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0).alias("deletions"), "l_shipdate",
    )


@query(
    """SELECT l_partkey AS path, count(DISTINCT l_orderkey) AS commits, sum(l_quantity)::BIGINT AS additions, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::BIGINT AS deletions
    FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY l_partkey ORDER BY commits DESC, path LIMIT 20"""
)
def churn_top(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("path"))
    return history.churn(_commits(spark, d), kept, since=F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp"))


_COUPLING = """WITH e AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS p FROM lineitem), n AS (SELECT p, count(*) AS n FROM e GROUP BY p),
pairs AS (SELECT x.p AS a, y.p AS b, count(*) AS co FROM e x JOIN e y USING (c) WHERE x.p < y.p GROUP BY ALL)
SELECT a, b, co AS co_commits, round(co / greatest(na.n, nb.n)::DOUBLE, 4) AS ratio FROM pairs JOIN n na ON na.p = a JOIN n nb ON nb.p = b WHERE co >= 3"""


def _supplied(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("path"))


@query(_COUPLING)
def change_coupling(spark: SparkSession, d: str) -> DataFrame:
    return history.coupling(_supplied(spark, d))


@query(_COUPLING + " AND (a = 7 OR b = 7)")
def change_coupling_one(spark: SparkSession, d: str) -> DataFrame:
    return history.coupling(_supplied(spark, d), path=7)


@query(
    r"""SELECT event_type, key AS name, count(*) AS n, min(v)::BIGINT AS least, max(v)::BIGINT AS most
    FROM (SELECT event_type, key, json_extract_string(props, '$."' || key || '"')::BIGINT AS v FROM (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events)) GROUP BY ALL"""
)
def variables_usage(spark: SparkSession, d: str) -> DataFrame:
    """Every key of the properties, each with its own values."""
    keyed = table(spark, d, "events").select("event_type", F.explode(F.from_json("props", "map<string, string>")).alias("name", "value")).withColumn("v", F.col("value").cast("long"))
    return keyed.groupBy("event_type", "name").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
