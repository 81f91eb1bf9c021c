"""Graph kernels on the part-succession graph, beside SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..sources.tables import DEGREES, PG, PGR, part_graph, parts, returned_graph, table
from ..staging import stage
from .registry import Registry

_REGISTRY = Registry()
query, QUERIES, ORACLES = _REGISTRY.query, _REGISTRY.queries, _REGISTRY.oracles


@query(f"WITH {PG}, {DEGREES} SELECT p_name AS name, id, in_degree, out_degree, degree FROM deg JOIN part ON p_partkey = id ORDER BY degree DESC, id LIMIT 10")
def repo_map_hotspots(spark: SparkSession, d: str) -> DataFrame:
    degrees = graph.degrees(part_graph(spark, d))
    return degrees.join(parts(spark, d).select("id", F.col("p_name").alias("name")), "id").select("name", "id", "in_degree", "out_degree", "degree").orderBy(F.col("degree").desc(), "id").limit(10)


@query(
    f"""WITH {PG}, {DEGREES}, hot AS (SELECT id, 2 AS tier, row_number() OVER (ORDER BY degree DESC, id) AS place FROM deg ORDER BY degree DESC, id LIMIT 5),
    entries AS (SELECT p_partkey AS id, 1 AS tier, row_number() OVER (ORDER BY p_partkey) AS place FROM part WHERE p_size = 1 ORDER BY p_partkey LIMIT 5)
    SELECT id, min(tier * 100 + place)::BIGINT AS place FROM (SELECT * FROM hot UNION ALL SELECT * FROM entries) GROUP BY id"""
)
def repo_map_start_here(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    hot = graph.degrees(part_graph(spark, d)).orderBy(F.col("degree").desc(), "id").limit(5)
    hot = hot.select("id", (200 + F.row_number().over(Window.orderBy(F.col("degree").desc(), "id"))).alias("place"))
    entries = parts(spark, d).where("p_size = 1").orderBy("id").limit(5).select("id", (100 + F.row_number().over(Window.orderBy("id"))).alias("place"))
    return hot.union(entries).groupBy("id").agg(F.min("place").cast("long").alias("place"))


@query(f"WITH {PG} SELECT 'callee' AS role, dst AS id FROM pg WHERE src = 7 UNION ALL SELECT 'caller', src FROM pg WHERE dst = 7")
def call_graph_in_out(spark: SparkSession, d: str) -> DataFrame:
    edges = part_graph(spark, d).where("src = 7 or dst = 7")
    out = edges.where("src = 7").select(F.lit("callee").alias("role"), F.col("dst").alias("id"))
    return out.union(edges.where("dst = 7").select(F.lit("caller"), F.col("src")))


def _reach(edge: str, seeds: str, depth: int) -> str:
    a, b = ("src", "dst") if edge == "out" else ("dst", "src")
    return f"""WITH RECURSIVE {PG}, reach AS (
      {seeds}
      UNION SELECT pg.{b} AS id, reach.depth + 1 AS depth FROM reach JOIN pg ON pg.{a} = reach.id WHERE reach.depth < {depth}
    )"""


#: More than any shortest way here; the queries themselves go on until nothing new is reached.
_FAR = 50


@query(_reach("in", "SELECT 7::BIGINT AS id, 0 AS depth", _FAR) + " SELECT id, min(depth) AS depth FROM reach GROUP BY id")
def blast_radius_callers(spark: SparkSession, d: str) -> DataFrame:
    return graph.bfs(graph.reverse(stage(part_graph(spark, d))), spark.range(7, 8))


@query(_reach("out", "SELECT 7::BIGINT AS id, 0 AS depth", _FAR) + " SELECT id, min(depth) AS depth FROM reach GROUP BY id")
def blast_radius_deps(spark: SparkSession, d: str) -> DataFrame:
    return graph.bfs(stage(part_graph(spark, d)), spark.range(7, 8))


_CHANGED = "SELECT p_partkey AS id, 0 AS depth FROM part WHERE p_name = (SELECT min(p_name) FROM part) AND p_size <= 10"
_IMPACT = _reach("in", _CHANGED, 3) + ", hops AS (SELECT id, min(depth) AS hop FROM reach GROUP BY id)"


def _changed(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d)
    first = p.agg(F.min("p_name").alias("p_name"))
    return p.where("p_size <= 10").join(F.broadcast(first), "p_name").select("id")


@query(_IMPACT + " SELECT id, hop, CASE hop WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM hops WHERE hop > 0")
def change_impact(spark: SparkSession, d: str) -> DataFrame:
    return graph.change_impact(stage(part_graph(spark, d)), _changed(spark, d))


@query(_IMPACT + " SELECT id, hop, quality FROM hops JOIN labels ON doc_id = id WHERE hop > 0")
def change_impact_tests(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    return graph.change_impact(stage(part_graph(spark, d)), _changed(spark, d)).join(labels, "id").select("id", "hop", "quality")


def _pagerank(edges: str, rounds: int) -> str:
    """One step a recursion: gains by part, then base and dangling mass for every part."""
    return f"""WITH RECURSIVE {PG if edges == "pg" else PGR}, links AS (
      SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM {edges}
    ), n AS (SELECT count(*)::DOUBLE AS n FROM part
    ), dangling AS (SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT src FROM links)
    ), steps AS (
      SELECT 0 AS step, p_partkey AS id, 1.0::DOUBLE / n AS score FROM part, n
      UNION ALL
      SELECT any_value(step) + 1, p_partkey, 0.15::DOUBLE / any_value(n) + 0.85::DOUBLE * any_value(mass) / any_value(n) + 0.85::DOUBLE * coalesce(sum(gain), 0)
      FROM (SELECT p_partkey FROM part), n, (SELECT max(step) AS step, coalesce(sum(score) FILTER (WHERE id IN (SELECT id FROM dangling)), 0) AS mass FROM steps) m
      LEFT JOIN (SELECT dst, sum(score * share) AS gain FROM steps JOIN links ON links.src = steps.id GROUP BY dst) g ON g.dst = p_partkey
      WHERE step < {rounds} GROUP BY p_partkey
    ) SELECT id, round(score, 6) AS score FROM steps WHERE step = {rounds}"""


@query(_pagerank("pg", 25))
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(stage(part_graph(spark, d)), parts(spark, d).select("id")).select("id", F.round("score", 6).alias("score"))


@query(_pagerank("pgr", 25))
def pagerank_dangling(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(stage(returned_graph(spark, d)), parts(spark, d).select("id")).select("id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {PG}, {DEGREES}, ranked AS (
      SELECT p_partkey AS id, p_name AS name, coalesce(in_degree, 0)::BIGINT AS in_degree,
             row_number() OVER (ORDER BY (p_brand LIKE '%2%') DESC, (p_size > 25) DESC, coalesce(in_degree, 0) DESC, p_partkey DESC) AS rank
      FROM part LEFT JOIN deg ON id = p_partkey WHERE lower(p_name) = (SELECT lower(min(p_name)) FROM part)
    ) SELECT id, name, in_degree, rank::INTEGER AS rank FROM ranked WHERE rank <= 10"""
)
def resolve_ranked(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d)
    name = p.agg(F.min("p_name")).first()[0]
    rows = p.where(F.lower("p_name") == name.lower()).join(graph.degrees(part_graph(spark, d)).select("id", "in_degree"), "id", "left")
    rows = rows.select("id", F.col("p_name").alias("name"), F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"), "p_brand", "p_size")
    found = graph.resolve_ranked(rows, name, hints=[F.col("p_brand").contains("2"), F.col("p_size") > 25, F.col("in_degree")])
    return found.select("id", "name", "in_degree", "rank")


@query(
    f"""WITH {PG}, {DEGREES}, found AS (
      SELECT p_partkey AS id, p_name AS name, coalesce(in_degree, 0)::BIGINT AS in_degree, coalesce(out_degree, 0)::BIGINT AS out_degree, coalesce(degree, 0)::BIGINT AS degree
      FROM part LEFT JOIN deg ON id = p_partkey
      WHERE p_size >= 20 AND p_partkey IN (SELECT src FROM pg WHERE dst IN (SELECT p_partkey FROM part WHERE p_size < 5)) AND coalesce(degree, 0) BETWEEN 10 AND 100
    ) SELECT *, count(*) OVER () AS total FROM found ORDER BY degree DESC, id LIMIT 10 OFFSET 10"""
)
def search_graph_page(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d).select("id", F.col("p_name").alias("name"), "p_size")
    page = graph.search_page(p, stage(part_graph(spark, d)), where=F.col("p_size") >= 20, min_degree=10, max_degree=100, linked_to=p.where("p_size < 5"), offset=10)
    return page.select("id", "name", "in_degree", "out_degree", "degree", "total")


@query(f"WITH {PGR} SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT src FROM pgr UNION SELECT dst FROM pgr)")
def isolated_nodes(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("id").join(graph.degrees(returned_graph(spark, d)), "id", "left_anti")


@query(
    f"""WITH {PG} SELECT p_partkey AS id, p_size::BIGINT AS complexity, count(DISTINCT src) AS callers, (p_size * count(DISTINCT src))::BIGINT AS score
    FROM part JOIN pg ON dst = p_partkey GROUP BY p_partkey, p_size ORDER BY score DESC, id LIMIT 10"""
)
def hot_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.hot_paths(parts(spark, d).select("id", F.col("p_size").alias("complexity")), part_graph(spark, d))


@query(
    r"""WITH e AS (SELECT DISTINCT url AS src, target AS dst FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)),
    names AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS no FROM (SELECT src AS name FROM e UNION SELECT dst FROM e))
    SELECT src, s.no AS src_no, dst, t.no AS dst_no FROM e JOIN names s ON s.name = src JOIN names t ON t.name = dst"""
)
def dependency_graph(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "pages").select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst"))
    return graph.dependency_graph(links)


@query(
    """SELECT 'region' || r_regionkey AS parent, 'nation' || n_nationkey AS child FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION SELECT 'nation' || n_nationkey, 'customer' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey
    UNION SELECT 'nation' || n_nationkey, 'supplier' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey"""
)
def contains_edges(spark: SparkSession, d: str) -> DataFrame:
    tag = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    return graph.contains_edges(
        [
            nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(tag("region", "r_regionkey").alias("parent"), tag("nation", "n_nationkey").alias("child")),
            table(spark, d, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(tag("nation", "n_nationkey").alias("parent"), tag("customer", "c_custkey").alias("child")),
            table(spark, d, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(tag("nation", "n_nationkey").alias("parent"), tag("supplier", "s_suppkey").alias("child")),
        ]
    )


_CALLS = """calls AS (
  SELECT DISTINCT o_custkey AS caller, p_name AS name, p_brand AS brand FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
)"""


@query(
    f"""WITH {_CALLS}, pairs AS (
      SELECT caller, name, p_partkey AS id, CASE WHEN p_partkey IS NOT NULL AND brand = p_brand THEN 1.0 ELSE 0.5 END::DOUBLE AS weight
      FROM calls LEFT JOIN part ON p_name = name AND p_size > 30
    ), best AS (SELECT *, max(weight) OVER (PARTITION BY caller, name) AS best FROM pairs)
    SELECT caller, coalesce(id::VARCHAR, '?::' || name) AS target, max(weight) AS weight FROM best WHERE weight = best GROUP BY ALL"""
)
def resolve_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Customers' orders, all of them, call parts by name; a candidate of the same brand is confirmed."""
    part = table(spark, d, "part")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    calls = table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("p_partkey") == F.col("l_partkey"))
    calls = calls.select(F.col("o_custkey").alias("caller"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    symbols = part.where("p_size > 30").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    return graph.resolve_callees_by(calls, symbols, "brand")


@query(
    """SELECT l_partkey AS caller, CASE WHEN s_suppkey IS NULL THEN '?::' || l_suppkey ELSE s_suppkey::VARCHAR END AS target, count(*) AS n
    FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON s_suppkey = l_suppkey GROUP BY ALL"""
)
def unresolved_refs(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey")
    calls = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    joined = calls.join(known, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    target = F.when(F.col("s_suppkey").isNull(), F.concat(F.lit("?::"), F.col("l_suppkey").cast("string"))).otherwise(F.col("s_suppkey").cast("string"))
    return joined.select(F.col("l_partkey").alias("caller"), target.alias("target"), "n")
