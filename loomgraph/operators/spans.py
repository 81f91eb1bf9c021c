"""Points in spans of lines, without pairing the two: one sort a file.

Spans nest or lie apart, as those of symbols do. Of spans that begin in one line the longer is the outer one, and of equal ones
the one with the smaller `ordinal`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: In a line spans begin, then points are, then spans end.
BEGIN, POINT, END = 0, 1, 2


def _events(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Points (path, line, ...) and the beginnings and ends of spans (path, line, end_line, ordinal, id), with `of` and `rank`, their order in a line."""
    begun = spans.select("path", "line", F.lit(BEGIN).alias("of"), F.struct(-F.col("end_line"), "ordinal").alias("rank"), "id", F.lit(1).alias("step"))
    ended = spans.select("path", F.col("end_line").alias("line"), F.lit(END).alias("of"), F.struct(-F.col("end_line"), "ordinal").alias("rank"), "id", F.lit(-1).alias("step"))
    return points.withColumns({"of": F.lit(POINT), "step": F.lit(0)}).unionByName(begun.unionByName(ended), allowMissingColumns=True)


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Each point with the `id` of the innermost span around it, or null.

    The depth after each event is a running sum; a point's span is the last that began at the point's depth.
    """
    order = ["line", "of", "rank"]
    upto = Window.partitionBy("path").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deep = _events(points, spans).withColumn("depth", F.sum("step").over(upto))
    level = Window.partitionBy("path", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.last(F.when(F.col("of") == BEGIN, F.col("id")), ignorenulls=True).over(level)
    found = deep.withColumn("around", F.when(F.col("depth") > 0, begun)).where(F.col("of") == POINT)
    return found.select(*points.columns, F.col("around").alias("id"))


def holding(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, id, ordinal, points) of the spans that have points in them: how many were seen at their end, less those before their beginning."""
    marked = _events(points.select("path", "line"), spans)
    upto = Window.partitionBy("path").orderBy("line", "of").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = marked.withColumn("seen", F.sum(F.when(F.col("of") == POINT, 1).otherwise(0)).over(upto)).where(F.col("of") != POINT)
    held = seen.groupBy("path", "id", F.col("rank.ordinal").alias("ordinal")).agg((F.max("seen") - F.min("seen")).alias("points"))
    return held.where("points > 0")
