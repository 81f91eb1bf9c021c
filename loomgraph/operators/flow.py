"""Flow and taint over ordered rows: what a value depends on, and whether it was cleaned on the way.

A group of up to MOST rows is a window of its own. Where one is larger, rows are dealt by ranges of group and order, windows
end with the range, and what a range needs to know of the ranges before and after it in the same group is a row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

#: Rows of a group that are sorted in one task.
MOST = 1_000_000


def _ranged(rows: DataFrame, by: str, order: list[str]) -> DataFrame | None:
    """The rows, staged, with the number of their range in `_part`; None if no group is so large that it needs ranges."""
    largest = rows.groupBy(by).count().agg(F.max("count")).first()[0]
    if not largest or largest <= MOST:
        return None
    return stage(rows.repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id()))


def event_chain(events: DataFrame) -> DataFrame:
    """Each event with the type before and after it for its user, and the microseconds since."""
    rows = events.select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"), "ts")
    ranged = _ranged(rows, "user_id", ["ts", "event_id"])
    order = Window.partitionBy(*(["user_id"] if ranged is None else ["_part", "user_id"])).orderBy("ts", "event_id")
    before, after = F.lag("event_type").over(order), F.lead("event_type").over(order)
    said = lambda df, before, after, at: df.select("event_id", "user_id", "event_type", before.alias("depends_on"), after.alias("flows_to"), (F.col("_at") - at).alias("gap_us"))
    if ranged is None:
        return said(rows, before, after, F.lag("_at").over(order))
    spans = ranged.groupBy("user_id", "_part").agg(*[f(F.struct("ts", "event_id", "event_type", "_at")).alias(name) for f, name in ((F.min, "first"), (F.max, "last"))])
    of_user = Window.partitionBy("user_id").orderBy("_part")
    spans = stage(spans.select(F.col("user_id").alias("_user"), F.col("_part").alias("_range"), F.lag("last").over(of_user).alias("_last"), F.lead("first").over(of_user).alias("_next")).where("_last is not null or _next is not null"))
    # where a range begins or ends, its neighbour of the same user goes on
    marked = ranged.withColumns({"_before": before, "_after": after, "_then": F.lag("_at").over(order), "_first": F.row_number().over(order) == 1, "_end": F.lead(F.lit(1)).over(order).isNull()})
    joined = marked.join(spans, F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("_part") == F.col("_range")), "left")
    start, end = F.col("_first") & F.col("_last").isNotNull(), F.col("_end") & F.col("_next").isNotNull()
    return said(joined, F.when(start, F.col("_last.event_type")).otherwise(F.col("_before")), F.when(end, F.col("_next.event_type")).otherwise(F.col("_after")), F.when(start, F.col("_last._at")).otherwise(F.col("_then")))


def taint_in_order(rows: DataFrame, *, by: str, order: list[str], at: str, source: Column, sanitizer: Column, sink: Column) -> DataFrame:
    """Sinks with a verdict: CLEAN without an earlier source, SAFE if a sanitizer came after the last one, else UNSAFE."""
    ranged = _ranged(rows, by, order)
    marks = {"_source": F.when(source, F.col(at)), "_clean": F.when(sanitizer, F.col(at))}
    keys = [by] if ranged is None else ["_part", by]
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    marked = (rows if ranged is None else ranged).withColumns({name: F.max(mark).over(before) for name, mark in marks.items()})
    if ranged is not None:
        earlier = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        spans = ranged.groupBy(by, "_part").agg(*[F.max(mark).alias(name) for name, mark in marks.items()])
        spans = stage(spans.select(F.col(by).alias("_by"), F.col("_part").alias("_range"), *[F.max(name).over(earlier).alias(f"_before{name}") for name in marks]))
        marked = marked.join(spans, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_range")))
        marked = marked.withColumns({name: F.greatest(name, f"_before{name}") for name in marks}).select(*rows.columns, *marks)
    verdict = F.when(F.col("_source").isNull(), "CLEAN").when(F.col("_clean") > F.col("_source"), "SAFE").otherwise("UNSAFE")
    return marked.where(sink).withColumn("verdict", verdict).drop("_source", "_clean")


def reach_later(sources: DataFrame, sinks: DataFrame, *, by: str, step: str, most: int) -> DataFrame:
    """(by, source_step, sink_step, hops) of sinks at most so many steps after a source.

    A source is repeated for each of those steps and the join is on equality, so a long group makes `most` rows a
    source, not a row for each pair.
    """
    ahead = sources.select(F.col(by), F.col(step).alias("source_step"), F.explode(F.sequence(F.lit(1), F.lit(most))).alias("hops"))
    ahead = ahead.select(by, "source_step", (F.col("source_step") + F.col("hops")).alias("sink_step"))
    found = ahead.join(sinks.select(F.col(by), F.col(step).alias("sink_step")), [by, "sink_step"])
    return found.select(by, "source_step", "sink_step", (F.col("sink_step") - F.col("source_step")).alias("hops"))
