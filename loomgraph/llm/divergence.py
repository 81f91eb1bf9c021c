"""Audit of a corpus's sources: how the words of each source of a language differ from those of every other one.

Sort-based streaming. A task cuts its documents into terms, sorts (lang, source, term, document) and scans the run
of each (lang, source, term) for its documents and occurrences; such partial runs are staged. They are dealt out by ranges of
(lang, term, source, document), sorted within each partition, and scanned again: a run that the border of two ranges cuts is
two partial counts, which an aggregate adds up, so the most frequent term of the largest language is split like
anything else. Terms in too few documents of their language go; the others are the kept counts.

A second pass deals the kept counts of a language by slices of its terms, sorted by (term, source) again, behind the
language's groups. The scan of a slice holds a few hundred terms at once and adds up the differences of each pair of groups: partial
pairs, one row a pair and slice, which an aggregate adds up. Languages of more than BLOCK sources are dealt by pairs of blocks of
sources, so that a task holds at most (2 * BLOCK)^2 sums. The terms' own rows come from the same counts by a window of `top` rows a group.

Defined cases: null text, lang and source are ''; each row of the documents is a document, whether its id is null
or repeated or not; a document is read whole, in pieces of PIECE bytes, and only the counts of its distinct terms are held; a
group without terms has count 0 everywhere, so its pairs are there; where a language keeps no term (V = 0) the values of
its pairs are 0; ties go by the item's UTF-8 bytes; an empty table gives no rows; other columns are not read. Sums are exact:
counts are whole numbers, and probabilities are divided as decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, join_on_hot_key, python_workers, stage

#: Letters stay, those of A-Z in lower case, and so do all bytes of characters beyond ASCII; everything else parts terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MIN_DOCUMENTS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 20
#: Rows of documents and terms, some 20 bytes each, that a task sorts and scans together before it emits their runs.
TOGETHER = 3_000_000
#: Terms of a language that are scanned together, and sources of one block.
SLICE, BLOCK = 2048, 256
RUN = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("doc", pa.int64()), ("documents", pa.int64()), ("n", pa.int64())])
RUN_KIND = "lang string, source string, term string, doc bigint, documents bigint, n bigint"


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The text in parts of about `size` bytes, cut between terms, as bytes of terms and blanks."""
    at = 0
    while at < len(text):
        part = text[at : at + size].translate(TERM_BYTES)
        if at + size < len(text):
            cut = part.rfind(b" ")
            step = size
            while cut < 0:  # one term longer than a piece
                more = text[at + step : at + step + size].translate(TERM_BYTES)
                found = more.find(b" ")
                part += more if found < 0 else more[: found + 1]
                step += size
                cut = len(part) - 1 if found >= 0 or at + step >= len(text) else -1
            part = part[: cut + 1]
        yield part
        at += len(part)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins in sorted columns."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


class Runs:
    """The runs of (lang, source, term) in some documents: first a row for each document and term, then sorted and scanned."""

    def __init__(self, size: int = PIECE):
        self.size, self.rows, self.documents = size, 0, 0
        self.names: list[pa.Array] = []
        self.docs, self.codes, self.counts, self.batches = [], [], [], []

    def add(self, batch: pa.RecordBatch) -> None:
        words: list[bytes] = []
        lengths: list[tuple[int, int]] = []
        for i, text in enumerate(batch.column("text").cast(pa.binary()), self.documents):
            for part in pieces(text.as_py() or b"", self.size):
                found = part.split()
                words += found
                lengths.append((i, len(found)))
                if len(words) >= self.size // 4:
                    self._count(words, lengths)
        self._count(words, lengths)
        self.documents += batch.num_rows
        self.batches.append(batch.select(["lang", "source", "doc"]))

    def _count(self, words: list[bytes], lengths: list[tuple[int, int]]) -> None:
        """Count the words so far by (document, term): of a long text only its distinct terms stay."""
        flat = pa.array(words, pa.binary()).dictionary_encode()
        wide = max(1, len(flat.dictionary))
        owner = np.repeat(np.array([i for i, _ in lengths], np.int64), [n for _, n in lengths])
        key, n = np.unique(owner * wide + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
        self.docs.append((key // wide).astype(np.int32))
        self.codes.append((key % wide + sum(map(len, self.names))).astype(np.int32))
        self.counts.append(n.astype(np.int64))
        self.names.append(flat.dictionary)
        self.rows += len(n)
        words.clear(), lengths.clear()

    def close(self) -> pa.RecordBatch:
        """Each run with its first document, how many there are, and occurrences, in order of (lang, source, term)."""
        encoded = pa.concat_arrays(self.names).dictionary_encode()
        doc, count = np.concatenate(self.docs), np.concatenate(self.counts)
        term = encoded.indices.to_numpy(zero_copy_only=False)[np.concatenate(self.codes)]
        about = pa.Table.from_batches(self.batches).combine_chunks()
        lang, source = (about.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
        sources = max(1, len(source.dictionary))
        group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * sources + source.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((doc, term, group[doc]))
        doc, term, count = doc[order], term[order], count[order]
        own = group[doc]
        rows = _starts(own, term, doc)  # a document whose pieces were counted apart is one
        doc, term, own = doc[rows], term[rows], own[rows]
        count = np.add.reduceat(count, rows) if len(rows) else count
        runs = _starts(own, term)
        documents = np.diff(np.append(runs, len(doc)))
        n = np.add.reduceat(count, runs) if len(runs) else count
        columns = [
            lang.dictionary.take(pa.array(own[runs] // sources)),
            source.dictionary.take(pa.array(own[runs] % sources)),
            encoded.dictionary.take(pa.array(term[runs])).cast(pa.string()),
            about.column("doc").combine_chunks().take(pa.array(doc[runs])),
            pa.array(documents, pa.int64()),
            pa.array(n, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=RUN)


def partial_runs(docs: DataFrame, size: int = PIECE, most: int = TOGETHER) -> DataFrame:
    """(lang, source, term, doc, documents, n): what a task has counted in some documents. `doc` only orders a run."""
    python_workers(docs.sparkSession)
    chosen = docs.select(F.coalesce("text", F.lit("")).alias("text"), _text("lang"), _text("source"), F.xxhash64("doc_id").alias("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(size)
        for batch in batches:
            runs.add(batch)
            if runs.rows >= most:
                yield runs.close()
                runs = Runs(size)
        if runs.documents:
            yield runs.close()

    return chosen.mapInArrow(run, RUN_KIND)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths of rows sorted by (lang, term, source, doc): a row a run, with its documents and occurrences added up."""
    names, last = ("lang", "source", "term"), None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if last is not None:  # the run that the last batch ended in may go on
            table = pa.concat_tables([last, table]).combine_chunks()
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for name in names:
            column = table.column(name)
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy(zero_copy_only=False) if table.num_rows > 1 else False
        at = np.flatnonzero(new)
        added = [np.add.reduceat(table.column(c).to_numpy(), at) for c in ("documents", "n")]
        runs = table.take(pa.array(at)).select(["lang", "source", "term", "doc"])
        for name, values in zip(("documents", "n"), added):
            runs = runs.append_column(name, pa.array(values, pa.int64()))
        if runs.num_rows > 1:
            yield from runs.slice(0, runs.num_rows - 1).combine_chunks().to_batches()
        last = runs.slice(runs.num_rows - 1)
    if last is not None:
        yield from last.combine_chunks().to_batches()


def kept_counts(docs: DataFrame, *, min_documents: int = MIN_DOCUMENTS, size: int = PIECE) -> DataFrame:
    """(lang, source, term, n, total): occurrences of each kept term in each source that has it, and in its language."""
    runs = stage(partial_runs(docs, size))
    dealt = runs.repartitionByRange("lang", "term", "source", "doc").sortWithinPartitions("lang", "term", "source", "doc")
    cut = dealt.mapInArrow(scan, RUN_KIND)
    # runs that a border has cut are added up; the same deal serves the sums of a term over its sources
    whole = cut.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"))
    term = Window.partitionBy("lang", "term")
    told = whole.select("lang", "source", "term", "n", F.sum("n").over(term).alias("total"), F.sum("documents").over(term).alias("in_all"))
    return stage(told.where(F.col("in_all") >= min_documents).drop("in_all"))


def group_sizes(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, n, held, v, all_n, sources): a group's occurrences and terms, its language's terms V, occurrences and groups."""
    groups = docs.select(_text("lang"), _text("source")).distinct()
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("held"))
    terms = counts.select("lang", "term", "total").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all_n"))
    of_lang = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(terms, "lang", "left").fillna(0, ["v", "all_n"])
    return stage(groups.join(own, ["lang", "source"], "left").fillna(0, ["n", "held"]).join(of_lang, "lang"))


def chance(count: Column, n: Column, v: Column, smooth: int = SMOOTH) -> Column:
    """1 + floor(SCALE * (count + smooth) / (n + smooth * v)), exactly; null where nothing is kept."""
    over = count.cast("decimal(19,0)") + F.lit(smooth).cast("decimal(19,0)")
    under = n.cast("decimal(19,0)") + F.lit(smooth).cast("decimal(9,0)") * v.cast("decimal(19,0)")
    return F.when(v > 0, 1 + F.call_function("div", over * F.lit(SCALE).cast("decimal(10,0)"), under)).cast("bigint")


PART = "lang string, a string, b string, value bigint, seen bigint, v bigint, gap bigint"
PART_SCHEMA = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64()), ("seen", pa.int64()), ("v", pa.int64()), ("gap", pa.int64())])
#: Rows of terms by groups that are held at once.
HELD = 512


class _Slice:
    """The sums of one slice of a language's terms over the pairs of one pair of blocks."""

    def __init__(self, lang: str, left: int, right: int):
        self.lang, self.left, self.right = lang, left, right
        self.names: list[str] = []
        self.blocks: list[int] = []
        self.zero: list[int] = []
        self.v = self.seen = 0

    def add_group(self, name: str, block: int, zero: int, v: int) -> None:
        self.names.append(name)
        self.blocks.append(block)
        self.zero.append(zero)
        self.v = v

    def begin(self) -> None:
        self.at = {name: i for i, name in enumerate(self.names)}
        self.base = np.array(self.zero, np.int64)
        self.block = np.array(self.blocks)
        self.sums = np.zeros((len(self.names), len(self.names)), np.int64)

    def add(self, rows: np.ndarray, groups: np.ndarray, p: np.ndarray) -> None:
        """`rows` numbers the terms from 0; a group that lacks a term has its value at count 0."""
        terms = int(rows[-1]) + 1
        self.seen += terms
        for first in range(0, terms, HELD):
            some = slice(*np.searchsorted(rows, [first, first + HELD]))
            table = np.repeat(self.base[None, :], min(HELD, terms - first), 0)
            table[rows[some] - first, groups[some]] = p[some]
            for g in range(len(self.names)):
                self.sums[g] += np.abs(table - table[:, g : g + 1]).sum(axis=0)

    def result(self) -> pa.RecordBatch:
        a, b = np.triu_indices(len(self.names), 1)
        if self.left != self.right:  # pairs within a block are another slice's
            across = self.block[a] != self.block[b]
            a, b = a[across], b[across]
        names = pa.array(self.names, pa.string())
        n = len(a)
        whole = lambda x: pa.array(np.full(n, x), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([self.lang] * n, pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(self.sums[a, b]), whole(self.seen), whole(self.v), pa.array(np.abs(self.base[a] - self.base[b]))],
            schema=PART_SCHEMA,
        )


def scan_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial pairs of rows sorted by (lang, low, high, slice, term, source), where a slice's groups stand first, without a term."""
    key, now, waiting = None, None, []  # the rows of the term that a batch ends in wait for the next

    def flush(rest: bool) -> None:
        if not waiting:
            return
        table = pa.concat_tables(waiting).combine_chunks()
        waiting.clear()
        term = table.column("term").combine_chunks()
        new = np.zeros(table.num_rows, np.int64)
        if table.num_rows > 1:
            new[1:] = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False)
        rows = new.cumsum()
        upto = table.num_rows if rest else int(np.searchsorted(rows, rows[-1]))
        if upto < table.num_rows:
            waiting.append(table.slice(upto))
        if upto:
            groups = np.array([now.at[s] for s in table.column("source").slice(0, upto).to_pylist()], np.int64)
            now.add(rows[:upto], groups, table.column("p").slice(0, upto).to_numpy())

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(c) for c in ("lang", "low", "high", "slice")]
        new = np.zeros(table.num_rows, bool)
        for c in columns:
            if table.num_rows > 1:
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, table.num_rows - 1)).to_numpy(zero_copy_only=False)
        for first, to in zip(edges := [0, *np.flatnonzero(new)], [*edges[1:], table.num_rows]):
            mine = tuple(c[int(first)].as_py() for c in columns)
            if mine != key:
                if now is not None:
                    flush(True)
                    yield now.result()
                key, now = mine, _Slice(mine[0], mine[1], mine[2])
                now.begin()
            part = table.slice(int(first), int(to - first))
            heads = part.filter(pc.is_null(part.column("term")))
            if heads.num_rows:
                for r in heads.select(["source", "block", "p", "v"]).to_pylist():
                    now.add_group(r["source"], r["block"], r["p"] or 0, r["v"])
                now.begin()
            body = part.filter(pc.is_valid(part.column("term"))).select(["term", "source", "p"])
            if body.num_rows:
                waiting.append(body)
                flush(False)
    if now is not None:
        flush(True)
        yield now.result()


def pairs(counts: DataFrame, groups: DataFrame, *, slice_rows: int = SLICE, block: int = BLOCK) -> DataFrame:
    """(lang, a, b, value) of every two sources of a language, a before b or after it: the sum of the differences over all kept terms."""
    spark = counts.sparkSession
    python_workers(spark)
    # a language's blocks of sources, and slices of terms: some SLICE terms each, by hash
    blocks = F.ceil(F.col("sources") / block)
    slices = F.greatest(F.lit(1), F.ceil(F.col("v") / slice_rows)).cast("int")
    plan = groups.select("lang", "source", F.pmod(F.xxhash64("source"), blocks).cast("int").alias("block"), blocks.cast("int").alias("blocks"), slices.alias("slices"), "v", "held", chance(F.lit(0), F.col("n"), F.col("v")).alias("zero"), "n")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ends = [F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]
    heads = plan.select("*", other).select("lang", *ends, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(None).cast("string").alias("term"), "source", "block", F.col("zero").alias("p"), "v")
    valued = join_on_hot_key(counts, plan, ["lang", "source"], "held")
    body = valued.select("*", other).select("lang", *ends, F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"), "term", "source", "block", chance(F.col("n_of_term"), F.col("n"), F.col("v")).alias("p"), "v")
    key = ["lang", "low", "high", "slice"]
    sorted_rows = heads.unionByName(body).repartition(*key).sortWithinPartitions(*key, F.col("term").asc_nulls_first(), "source")
    parts = sorted_rows.mapInArrow(scan_pairs, PART)
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("v").alias("v"), F.max("gap").alias("gap"))
    # terms that none of the two blocks has differ by what the groups have at count 0
    return summed.select("lang", "a", "b", (F.col("value") + (F.col("v") - F.col("seen")) * F.col("gap")).alias("value"))


def audit(docs: DataFrame, *, min_documents: int = MIN_DOCUMENTS, top: int = TOP, size: int = PIECE, slice_rows: int = SLICE, block: int = BLOCK) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: all other sources by distance, and the `top` terms that a source has most over its language."""
    counts = kept_counts(docs, min_documents=min_documents, size=size).withColumnRenamed("n", "n_of_term")
    groups = group_sizes(docs, counts.withColumnRenamed("n_of_term", "n"))
    found = stage(pairs(counts, groups, slice_rows=slice_rows, block=block))
    both = found.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(found.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    valued = join_on_hot_key(counts, groups.select("lang", "source", "n", "v", "all_n", "held"), ["lang", "source"], "held")
    over = chance(F.col("n_of_term"), F.col("n"), F.col("v")) - chance(F.col("total"), F.col("all_n"), F.col("v"))
    terms = valued.select("lang", "source", F.col("term").alias("item"), over.alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    first = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).where(F.col("rank") <= top)
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank).unionByName(first)


def digest(docs: DataFrame) -> DataFrame:
    return audit(docs)


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT row_id, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT row_id) >= {MIN_DOCUMENTS}),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
lang_sums AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
groups AS (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) g),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE} * (coalesce(c.n, 0) + {SMOOTH})) // (g.n + {SMOOTH} * l.v) AS p, 1 + ({SCALE} * (k.total + {SMOOTH})) // (l.n + {SMOOTH} * l.v) AS q
  FROM groups g JOIN lang_sums l USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.other = b.source),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term)::INTEGER FROM p WHERE n > 0 AND p > q)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
