"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

DataFrame functions only. An item's windows are its runs of `width` words (all its words, if fewer).
A document contains a window only if it contains the window's rarest word, so that word alone is the
necessary prefix: windows are ordered by the words' counts in the corpus, a window with a word that
the corpus lacks is dropped, and each document word meets the windows whose rarest word it is. Length
and position bounds (the window must begin and end inside the document) and the comparison of the whole
run of words are part of the join's condition, so only true occurrences leave it. A document's words
never move: the windows come to them in broadcast blocks of at most `BLOCK` windows, however many
windows there are.

Defined cases: null and wordless texts have no words and are not contaminated; items without words take no part; windows of
items without id hit like any other, and name no item; rows that repeat an item_id add to one item; repeated rows of documents each
get a row, and rows that share a doc_id but not the text are told apart; very long texts are read whole; further
columns, whatever they are called, take no part and `clean` keeps them; empty tables give no items and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage

#: What stands between words before A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WIDTH = 13
#: Windows broadcast at once: some 10 MB at 13 words of 12 bytes.
BLOCK = 50_000
#: A window in over 1/HOT of all documents' windows is hot, so there are at most HOT of them; below FEW rows in all none is.
HOT, FEW = 1000, 1_000_000


def words(text: Column) -> Column:
    """The words in their own case; `said` lower-cases what is compared."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def said(run: Column) -> Column:
    """A run of words as one lower-cased text."""
    return ascii_lower(F.array_join(run, " "))


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Distinct windows: window_id, window (its text), length (in words); and whose they are: window_id, item (as a string)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    runs = items.select("item", "w", F.explode(starts).alias("start")).select("item", F.slice("w", F.col("start"), F.lit(width)).alias("run"))
    owned = stage(runs.select("item", said(F.col("run")).alias("window"), F.size("run").alias("length")).distinct())
    # staged, so each window keeps its number
    windows = stage(owned.select("window", "length").distinct().withColumn("window_id", F.monotonically_increasing_id()))
    return windows, stage(owned.join(windows, ["window", "length"]).select("window_id", "item"))


def _blocks(df: DataFrame, n: int, by: str) -> list[DataFrame]:
    """df in parts of about BLOCK rows, of which each is broadcast by itself."""
    parts = max(1, -(-n // BLOCK))
    return [df] if parts == 1 else [df.where(F.pmod(F.xxhash64(by), F.lit(parts)) == k) for k in range(parts)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def anchored(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """Windows that can occur, with the corpus's rarest word of each (anchor) and its place in the window (at).

    Anchors meet document words in lower case by Unicode, which is quick and equal wherever lower-casing A-Z is.
    """
    each = windows.select("window_id", "window", "length", F.posexplode(F.split("window", " ")).alias("at", "word")).withColumn("word", F.lower("word"))
    vocabulary = stage(each.select("word").distinct(), rows=each.count())
    n = vocabulary.count()
    spoken = docs.select(F.explode(words(F.col("text"))).alias("word")).select(F.lower("word").alias("word"))
    counts = _union([spoken.join(F.broadcast(v), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n")) for v in _blocks(vocabulary, n, "word")])
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at"))
    chosen = each.join(stage(counts, rows=n), "word", "left").groupBy("window_id").agg(F.first("window").alias("window"), F.first("length").alias("length"), rarest.alias("rarest"))
    return chosen.where("rarest.n > 0").select("window_id", "window", "length", F.col("rarest.word").alias("anchor"), F.col("rarest.at").alias("at"))


def occurrences(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, windows (ids of those in it), contaminated, _text (its text's hash)."""
    table = stage(anchored(windows, docs), rows=windows.count())
    # An empty word before the first one meets an empty anchor, so that each document leaves one row besides its hits.
    text = docs.select("doc_id", F.xxhash64("text").alias("_text"), words(F.col("text")).alias("_words"))
    spoken = text.select("doc_id", "_text", "_words", F.posexplode(F.concat(F.array(F.lit("")), "_words")).alias("_place", "_word"))
    none = F.lit(None).cast("long")
    every = docs.sparkSession.range(1).select(none.alias("window_id"), F.lit("").alias("window"), F.lit(0).alias("length"), F.lit("").alias("anchor"), F.lit(0).alias("at"))
    start = F.col("_place") - F.col("at")
    occurs = (F.col("_place") == 0) | (
        (start >= 1) & (start + F.col("length") - 1 <= F.size("_words")) & (said(F.slice("_words", F.greatest(start, F.lit(1)), F.col("length"))) == F.col("window"))
    )
    hits = []
    for k, block in enumerate(_blocks(table, table.count(), "window")):
        block = block.unionByName(every) if k == 0 else block
        found = spoken.join(F.broadcast(block), (F.lower("_word") == F.col("anchor")) & occurs)
        hits.append(found.select("doc_id", "_text", F.size("_words").alias("n_words"), F.when(F.col("_place") > 0, F.struct(start.alias("start"), F.col("length"))).alias("run"), "window_id"))
    # a document's runs and windows are no more than its words by the lengths of windows, of which there are `width`
    docs_hit = _union(hits).groupBy("doc_id", "_text", "n_words").agg(
        F.array_sort(F.collect_set("run")).alias("runs"), F.collect_set("window_id").alias("windows"), F.count(F.when(F.col("run").isNull(), 1)).alias("rows")
    )
    covered = F.aggregate(
        "runs",
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("end")),
        lambda a, r: F.struct(
            (a["hit"] + F.greatest(r["start"] + r["length"] - F.greatest(r["start"], a["end"]), F.lit(0))).alias("hit"),
            F.greatest(a["end"], r["start"] + r["length"]).alias("end"),
        ),
    )["hit"]
    measured = docs_hit.select("doc_id", F.col("n_words").cast("long").alias("n_words"), covered.alias("n_hit"), "windows", F.explode(F.sequence(F.lit(1).cast("long"), "rows")), "_text").drop("col")
    return measured.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def whose(met: DataFrame, owners: DataFrame) -> DataFrame:
    """A staged `met` (window_id and more) with the items that own the windows.

    Rows of a hot window stay where they are and meet its items by broadcast, in blocks; the others meet in a shuffle.
    """
    total = met.count()
    if total < FEW:
        return met.join(owners, "window_id")
    hot = stage(met.groupBy("window_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > total // HOT).select("window_id"), rows=HOT)
    of_hot = stage(owners.join(F.broadcast(hot), "window_id"))
    blocks = [met.join(F.broadcast(block), "window_id") for block in _blocks(of_hot, of_hot.count(), "item")]
    return _union([*blocks, met.join(F.broadcast(hot), "window_id", "left_anti").join(owners, "window_id")])


def scan(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, items (sorted ids of those with a window in it), contaminated, _text.

    Items are looked up after windows have been found, so a window that many items share is no longer than another.
    """
    windows, owners = item_windows(benchmark, width)
    found = stage(occurrences(docs, windows))
    met = stage(found.where(F.size("windows") > 0).select("doc_id", "_text", F.explode("windows").alias("window_id")).distinct())
    named = whose(met, owners).groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = found.join(stage(named), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left")
    return both.select("doc_id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "contaminated", "_text")


def digest(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH) -> DataFrame:
    found = scan(docs, benchmark, width=width)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    # staged, so its size is known when Spark chooses between a broadcast and a shuffle
    dirty = stage(occurrences(docs, item_windows(benchmark, width)[0]).where("contaminated").select(F.col("doc_id").alias("_id"), "_text").distinct())
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty["_id"]) & (F.xxhash64(docs["text"]) == dirty["_text"]), "left_anti")


#: For each item window, where it begins in a document's space-joined words.
ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 13) AS length, array_to_string(w[s : s + 12], ' ') AS said
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM items WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT length FROM win
), runs AS (
  SELECT rid, s, length, array_to_string(w[s : s + length - 1], ' ') AS said
  FROM (SELECT rid, w, length, unnest(range(1, len(w) - length + 2)) AS s FROM docs, lengths WHERE len(w) >= length)
), hits AS (SELECT rid, s, runs.length, item FROM runs JOIN win USING (length, said)
), hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + length)) AS p FROM (SELECT DISTINCT rid, s, length FROM hits)) GROUP BY rid
), found AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT rid, item FROM hits WHERE item IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN found USING (rid)
"""
