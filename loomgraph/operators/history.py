"""Commit history: churn, coupling, blame. `commits` has a row per commit and path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import spread, stage

#: Paths of a commit, or of a block of one, that are paired at once.
WIDE = 1000


def churn(commits: DataFrame, existing: DataFrame | None = None, *, since: Column | None = None, top_n: int = 20) -> DataFrame:
    """(path, commits, additions, deletions), most commits first; only paths of `existing` (path), if given."""
    rows = commits if since is None else commits.where(since)
    if existing is not None:
        rows = rows.join(existing.select("path"), "path", "left_semi")
    counted = rows.groupBy("path").agg(
        F.count_distinct("commit").alias("commits"), F.sum("additions").cast("long").alias("additions"), F.sum("deletions").cast("long").alias("deletions")
    )
    return counted.orderBy(F.col("commits").desc(), "path").limit(top_n)


def _pairs(each: DataFrame) -> DataFrame:
    """(a, b) with a < b for each two paths of a commit, dealt by both. A commit of over WIDE paths is cut into blocks of about WIDE, and
    each two blocks meet by themselves, so no task has more than WIDE times WIDE pairs of a commit.
    """
    both = lambda left, right, keys: left.withColumnRenamed("path", "a").join(right.withColumnRenamed("path", "b"), keys)
    sizes = each.groupBy("commit").agg(F.count(F.lit(1)).alias("n"))
    rows, most, total = sizes.agg(F.sum("n"), F.max("n"), F.sum(F.expr("n * (n - 1) div 2"))).first()
    # a task that meets paths makes their pairs, too
    dealt = lambda df: spread(df, max(rows or 0, total or 0), "commit")
    met = both(dealt(each), dealt(each), "commit").where("a < b").select("a", "b")
    if (most or 0) > WIDE:
        wide = stage(sizes.select("commit", F.ceil(F.col("n") / F.lit(WIDE)).cast("int").alias("blocks")).where("blocks > 1"))
        plain = dealt(each.join(wide, "commit", "left_anti"))
        cut = each.join(wide, "commit").withColumn("at", F.pmod(F.xxhash64("path"), F.col("blocks")).cast("int"))
        left = cut.select("commit", "path", F.col("at").alias("s"), F.explode(F.sequence("at", F.col("blocks") - 1)).alias("t"))
        right = cut.select("commit", "path", F.explode(F.sequence(F.lit(0), "at")).alias("s"), F.col("at").alias("t"))
        blocks = both(left, right, ["commit", "s", "t"]).where("s < t and a <> b or s = t and a < b")
        met = both(plain, plain, "commit").where("a < b").select("a", "b").unionAll(blocks.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return spread(met, total or 0, "a", "b")


def coupling(commits: DataFrame, *, path: object = None, min_commits: int = 3, top_n: int | None = None, most_paths: int | None = None) -> DataFrame:
    """Paths changed together: (a, b, co_commits, ratio), a < b; ratio is to the larger of both commit counts.

    With `path`, pairs with it at either end. `most_paths` leaves sweeping commits out, whose pairs grow with the
    square of their paths and say little; None keeps all.
    """
    each = spread(commits.select("commit", "path"), commits.count(), "commit", "path").distinct()
    if most_paths is not None:
        wide = each.groupBy("commit").count().where(F.col("count") > most_paths)
        each = each.join(wide, "commit", "left_anti")
    counts = stage(each.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_commits))
    # a path with fewer commits has no pair with enough
    each = each.join(counts.select("path"), "path", "left_semi")
    if path is not None:
        own = each.where(F.col("path") == path).select("commit")
        others = each.where(F.col("path") != path).join(own, "commit", "left_semi").select("path")
        pairs = others.select(F.least("path", F.lit(path)).alias("a"), F.greatest("path", F.lit(path)).alias("b"))
    else:
        pairs = _pairs(stage(each))
    together = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("co_commits")).where(F.col("co_commits") >= min_commits)
    kept = stage(together)
    rows = kept.count()
    rated = spread(spread(kept, rows, "a").join(counts.toDF("a", "a_n"), "a"), rows, "b").join(counts.toDF("b", "b_n"), "b")
    rated = rated.select("a", "b", "co_commits", F.round(F.col("co_commits") / F.greatest("a_n", "b_n"), 4).alias("ratio"))
    return rated if top_n is None else rated.orderBy(F.col("co_commits").desc(), F.col("ratio").desc(), "a", "b").limit(top_n)


def blame_summary(blame: DataFrame) -> DataFrame:
    """(author, lines), most first."""
    return blame.groupBy("author").agg(F.count(F.lit(1)).alias("lines")).orderBy(F.col("lines").desc(), "author")
