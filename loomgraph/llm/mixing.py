"""Mix sources to target weights: repetition rates per source, floor(rate) copies and a seeded Bernoulli one.

DataFrame functions only. Word counts are summed per source (map-side combined, so a source that
holds a third of the corpus is still one partial row per task); targets are found over the short
table of sources; each document then draws its own number of copies from a hash of its id, so
reruns and retried tasks agree.

Rows that share a doc_id with others, and rows without one beside others without one, draw by the hash of their text, too,
and equal rows draw together: n of them take floor(n * rate) copies and at most one more, dealt out evenly. So a source comes
near its target whatever its ids are. Equal rows are combined where they are, and dealt out again in parts of at most CHUNK.

Defined cases: a null text has size 0; null sources form one source, last in order; a source of
size 0 has target 0 and is taken 0 times; very long texts are read whole; own columns called size, source_size, target or
copies give way to the plan's, but `mix` keeps all of a row's columns; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage

#: A table of at most so many sources is broadcast; a longer one is joined by salted keys.
BROADCAST_SOURCES = 100_000
SALTS = 32
#: Equal rows that a task deals out from one.
CHUNK = 1000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source: source_size, weight, target. Weights repeat over the sources in code-point
    order. Raising one water level for all, sources fill up to cap * size in order of cap / weight;
    so a source is full iff the level that is left for it and all later ones reaches its cap.
    """
    sized = docs.select("source", n_words(F.col("text")).alias("size"))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*map(F.lit, weights))
    weighed = sums.select(
        "source",
        "source_size",
        F.element_at(kinds, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double").alias("weight"),
    ).withColumn("full", cap * F.col("source_size"))
    fill = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before, later = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    total = share * F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(later)
    levels = weighed.withColumn("level", level).withColumn("open", F.col("full") / F.col("weight") > F.col("level"))
    water = F.max(F.when(F.col("open"), F.col("level"))).over(every)
    return levels.select("source", "source_size", "weight", F.when(F.col("open"), water * F.col("weight")).otherwise(F.col("full")).alias("target"))


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 32 bits of a hash of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _name(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with the _key that they draw by, the number _n of rows that draw together, and a row's _place among these."""
    again = stage(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select(F.col("doc_id").alias("_again")))
    alone = lambda df: df.withColumns({"_key": _name(F.col("doc_id")), "_n": F.lit(1).cast("long"), "_place": F.lit(0).cast("long")})
    if again.isEmpty():
        return alone(docs)
    shared = docs["doc_id"].eqNullSafe(again["_again"])
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    key = F.concat(_name(F.col("doc_id")), F.lit(":"), F.coalesce(F.md5("text"), F.lit("null")))
    if rest:
        key = F.concat(key, F.lit(":"), F.xxhash64(F.to_json(F.struct(*rest))).cast("string"))
    marked = docs.join(again, shared, "left_semi").select(F.struct(*docs.columns).alias("_all"), key.alias("_key"), "source")
    groups = stage(marked.groupBy("_key", "source").agg(F.first("_all").alias("_all"), F.count(F.lit(1)).alias("_n")))
    parts = groups.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(CHUNK).cast("long"))))
    if groups.agg(F.max("_n")).first()[0] > CHUNK:
        parts = parts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = parts.withColumn("_place", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + CHUNK, F.col("_n")) - 1)))
    columns = [F.col(f"_all.{c}").alias(c) for c in docs.columns]
    return alone(docs.join(again, shared, "left_anti")).unionByName(dealt.select(*columns, "_key", "_n", "_place"))


def plan(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """The documents with size, source_size, target and copies beside their own columns."""
    names = {"size", "source_size", "target", "copies"} & set(docs.columns)
    docs = docs.drop(*names)
    targets = stage(source_targets(docs, weights, share, cap)).select(F.col("source").alias("_source"), "source_size", "target")
    sized = _keyed(docs).withColumn("size", n_words(F.col("text")))
    if targets.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(targets), F.col("source").eqNullSafe(F.col("_source")))
    else:
        salted = targets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = sized.withColumn("_deal", F.pmod(F.xxhash64("_key", "_place"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_deal") == F.col("_salt"))).drop("_deal", "_salt")
    together = F.col("_n") * F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    total = F.floor(together) + F.when(uniform(F.col("_key"), seed) < together - F.floor(together), 1).otherwise(0)
    copies = F.floor(total / F.col("_n")) + F.when(F.col("_place") < total % F.col("_n"), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("int")).drop("_source", "_key", "_n", "_place")


def emit(planned: DataFrame, columns: list[str]) -> DataFrame:
    """Each document as often as its copies say."""
    return planned.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns, whatever these are called."""
    rows = docs.select("doc_id", "text", "source", F.struct("*").alias("_row"))
    return emit(plan(rows, **options), ["_row"]).select("_row.*")


def digest(docs: DataFrame, **options) -> DataFrame:
    planned = plan(docs.select("doc_id", "text", "source"), **options)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), keyed AS (
  SELECT doc_id, source, size, count(*) OVER same AS n, row_number() OVER same - 1 AS place,
         coalesce(doc_id::VARCHAR, 'null') || CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN ':' || coalesce(md5(text), 'null') ELSE '' END AS key
  FROM sized WINDOW same AS (PARTITION BY doc_id, text, source)
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS filled,
         ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight
  FROM sums
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(filled) OVER (ORDER BY filled / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY filled / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size,
         CASE WHEN filled / weight > level THEN weight * max(CASE WHEN filled / weight > level THEN level END) OVER () ELSE filled END AS target
  FROM levels
), rated AS (
  SELECT doc_id, size, source_size, target, n, place, n * CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix:' || key), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM keyed JOIN targets ON keyed.source IS NOT DISTINCT FROM targets.source
), totals AS (
  SELECT *, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS total FROM rated
), taken AS (
  SELECT *, (total // n + CASE WHEN place < total % n THEN 1 ELSE 0 END)::INTEGER AS copies FROM totals
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM taken
"""
