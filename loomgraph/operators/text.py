"""Text kernels: occurrences, normalised clones, weighted token counts, dead names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(texts: DataFrame) -> DataFrame:
    """(id, line, text), lines from 1."""
    return texts.select("id", F.posexplode(F.split("text", "\n")).alias("at", "text")).select("id", (F.col("at") + 1).alias("line"), "text")


def occurrences(texts: DataFrame, token: str) -> DataFrame:
    """(id, line, n) of lines that have the token between characters that aren't ASCII letters, digits or `_`."""
    parts = F.split("text", "[^A-Za-z0-9_]+")
    counted = lines(texts.where(F.col("text").contains(token))).where(F.col("text").contains(token)).select("id", "line", F.size(F.filter(parts, lambda w: w == token)).cast("long").alias("n"))
    return counted.where("n > 0")


def normalised(text: Column) -> Column:
    """Numbers as one name, identifiers as another, so renamed copies are equal."""
    return F.regexp_replace(F.regexp_replace(text, "[A-Za-z_][A-Za-z0-9_]*", "_ID_"), "(?<![A-Za-z0-9_])[0-9]+", "_NUM_")


def clone_groups(texts: DataFrame, key: Column, *, having: Column | None = None) -> DataFrame:
    """(hash, n, first_id) of groups of two or more equal keys; `having` is an aggregate that a group must meet.

    Members are joined by hash where they are wanted: a group of any size is one row here.
    """
    hashed = texts.withColumn("hash", F.sha2(key, 256))
    aggregates = [F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")] + ([having.alias("keep")] if having is not None else [])
    groups = hashed.groupBy("hash").agg(*aggregates).where("n >= 2")
    return groups if having is None else groups.where("keep").drop("keep")


def branch_counts(words: Column, weights: dict[str, int]) -> tuple[Column, dict[str, Column]]:
    """1 + the weighted sum of how often each token is among the words, and the counts. `words` should be a column that is there
    already, as each count reads it.
    """
    times = lambda token: F.size(F.filter(words, lambda w: w == token)).cast("long")
    counts = {t: times(t) for t in weights}
    return sum((counts[t] * w for t, w in weights.items()), F.lit(1).cast("long")), counts


def holders(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, id) of texts (id, text) that hold an item's text (item_id, item) whole, between spaces or the ends.

    An item's longest word is among the words of each text that holds it: those meet first, short rows all of them, and the
    item is then looked for in the texts that are left.
    """
    words = F.split("item", " ")
    longest = F.element_at(F.array_sort(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("word")))), -1)["word"]
    asked = items.where("item is not null").select("item_id", "item", longest.alias("word"))
    said = texts.where("text is not null").select("id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    met = said.join(asked, "word").select(F.col("id").alias("_id"), "item_id", "item").distinct()
    apart = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    both = texts.join(met, F.col("id").eqNullSafe(F.col("_id"))).where(F.contains(apart("text"), apart("item")))
    return both.select("item_id", "id").distinct()


def dead(symbols: DataFrame, uses: DataFrame) -> DataFrame:
    """Symbols (name, path, line) whose name is used nowhere but on their own line.

    Uses are counted per name first, so a common name is one row: a name with two places or more is alive; one
    with a single place is alive for symbols of another place.
    """
    places = uses.select("name", "path", "line").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("places"), F.min(F.struct("path", "line")).alias("only"))
    joined = symbols.join(places, "name", "left")
    own = (F.col("only.path") == F.col("path")) & (F.col("only.line") == F.col("line"))
    return joined.where(F.col("places").isNull() | ((F.col("places") == 1) & own)).drop("places", "only")
