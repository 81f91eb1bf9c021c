"""Names by what they contain, and tables laid out by name, so that a question reads the few folders and pages that it is about.

Every distinct name, in lower case, is listed under each text of one to GRAM characters in it. A question of GRAM characters or more asks
for the rarest of its own grams, a shorter one for itself, and the names found are held against the whole question. Tables lie
in PARTS folders by a hash of the gram or name and are sorted inside, so readers skip other folders, and pages of the folder by their bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage

GRAM, PARTS = 3, 64


def part_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def grams(text: Column, lengths: range = range(1, GRAM + 1)) -> Column:
    """The distinct texts of these lengths in a text."""
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(n) for n in lengths]))


def asked_grams(text: Column) -> Column:
    """The grams by which a question can be asked: those of full length, or the question itself if it is shorter."""
    return F.when(F.length(text) < GRAM, F.array(text)).otherwise(grams(text, range(GRAM, GRAM + 1)))


def laid_out(df: DataFrame, key: str, *then: str) -> DataFrame:
    """A table in PARTS folders by a column's hash, sorted by it; one value's rows may be many, so they are dealt by the further columns, too."""
    order = ["part", key, *then]
    return stage(df.withColumn("part", part_of(F.col(key))).repartitionByRange(*order).sortWithinPartitions(*order), by="part")


def of_keys(table: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """The rows of some values of the column that a table is laid out by."""
    if not wanted:
        return table.where(F.lit(False)).drop("part")
    return table.where(F.col("part").isin([part_of(F.lit(w)) for w in wanted]) & F.col(key).isin(*wanted)).drop("part")


class NameIndex:
    """symbols need a column name, occurrences name, path, line and col; rows without a name are found by no question."""

    def __init__(self, symbols: DataFrame, occurrences: DataFrame):
        self._columns = symbols.columns
        low = symbols.where("name is not null").withColumn("low", F.lower("name"))
        self.symbols = laid_out(low, "low", "path", "line")
        self.occurrences = laid_out(occurrences.where("name is not null"), "name", "path", "line", "col")
        names = self.symbols.select("low").distinct()
        self.postings = laid_out(names.select(F.explode(grams(F.col("low"))).alias("gram"), "low"), "gram", "low")
        self.counts = laid_out(self.postings.groupBy("gram").agg(F.count(F.lit(1)).alias("names")), "gram")

    def named(self, name: str) -> DataFrame:
        """The symbols of a name in any case."""
        return of_keys(self.symbols, "low", [name.lower()]).select(self._columns)

    def uses(self, name: str) -> DataFrame:
        return of_keys(self.occurrences, "name", [name])

    def names_with(self, query: str) -> DataFrame:
        """(low): the names that contain a text in any case."""
        asked = query.lower()
        wanted = [asked] if len(asked) < GRAM else sorted({asked[i : i + GRAM] for i in range(len(asked) - GRAM + 1)})
        held = of_keys(self.counts, "gram", wanted).collect()  # at most a row a gram of the question
        if len(held) < len(wanted):
            return of_keys(self.postings, "gram", []).select("low")
        rarest = min(held, key=lambda r: (r["names"], r["gram"]))["gram"]
        return of_keys(self.postings, "gram", [rarest]).where(F.col("low").contains(asked)).select("low")

    def containing(self, query: str) -> DataFrame:
        """The symbols whose name contains a text in any case."""
        if not query:
            return self.symbols.select(self._columns)
        found = self.names_with(query)
        parts = [r[0] for r in found.select(part_of(F.col("low"))).distinct().collect()]  # at most PARTS
        return self.symbols.where(F.col("part").isin(*parts) if parts else F.lit(False)).join(found, "low", "left_semi").select(self._columns)

    def names_with_each(self, queries: DataFrame) -> DataFrame:
        """(query, low): for each row of queries (query) once, the names that contain it in any case; an empty or missing query has none."""
        asked = queries.select("query").where("query <> ''").distinct().withColumn("asked", F.lower("query"))
        each = asked.select("query", "asked", F.explode(asked_grams(F.col("asked"))).alias("gram"))
        counted = each.join(self.counts.select("gram", "names"), "gram", "left")
        rarest = counted.groupBy("query", "asked").agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram")).alias("r")).where("r.names > 0")
        return rarest.select("query", "asked", F.col("r.gram").alias("gram")).join(self.postings, "gram").where(F.col("low").contains(F.col("asked"))).select("query", "low")
