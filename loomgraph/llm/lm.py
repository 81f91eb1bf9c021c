"""Deleted interpolation: a bigram model whose estimates are mixed by buckets of the context's frequency.

    P(w | u) = a(b) c(u w) / c(u) + d(b) c(w) / N + e(b) / (V + 1),   b = floor(log2 c(u)), a + d + e = 1

The counts are maximum-likelihood estimates over all training documents. The weights of each bucket come from
expectation-maximisation on deleted counts: a fixed seventh of the training documents is predicted from the
counts of the others. A context that was never seen has weight on the lower orders only, in the proportions of
the lowest bucket. V + 1 leaves one share for all unknown words, so the probabilities of the known words and
that one sum to 1.

How it is spread. Texts are read once: each task packs its documents into blocks of token streams over a block's
own vocabulary. A block then asks for the corpus counts of its distinct words and word pairs: 64-bit hashes, sorted,
packed as one binary value per block and bucket of the hash space. Each bucket adds up what all blocks of training
documents hold and answers each block in the order it asked. A pair's count is combined within a block first, so a
word pair that a third of all documents share is one entry a block. No count is dropped and none goes to the driver;
it gets the totals, and for the weights a histogram of (bucket, log probability, log probability) cells of a quarter of
a power of two, a number of cells that doesn't depend on the corpus.

Buckets grow with the corpus, so blocks ask in levels: where there are more than 2^MOST_BITS buckets, a block asks 2^FAN_BITS ranges of
them, there FAN blocks at a time are merged into one run, runs ask on, and what they are told is looked up for their blocks. So a
block, or a run, sends so many messages whatever the corpus's size, there are as many runs a level as blocks, and levels are
the logarithm of the buckets.

Words are told apart by a hash of 64 bits and one of 32: where the first are equal and the second aren't, the job starts again with
other hashes. Pairs are one hash of their words' (some hundreds of 1e11 pairs meet by chance). Two words are the highest order: the
keys of a third, some 1.3 times as many as pairs, would be moved and staged again, beyond the disk that is allowed here.

Defined cases: a null or empty text is the end token alone; rows that share a doc_id each get a score and each teach;
a null doc_id counts as remainder 0, and ids of any type by their text; very long texts are read whole and may be a block of their
own; without training documents all counts are 0, V is 0 and each token has what the uniform estimate gives; further columns take
no part; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.errors import PythonException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_workers, stage

FOLDS, HELD_OUT, DELETED = 7, 2, 3
#: Tokens in a block, beyond which a task begins another, and the most tokens for a bucket of the hash space.
BLOCK, BUCKET = 1_000_000, 1_000_000
#: Tokens whose answers, or scores, are worth a file.
FILE = 32_000_000
#: Buckets, as powers of two: the least, the most that are asked at once, and those ranges of them that more are asked by.
LEAST_BITS, MOST_BITS, FAN_BITS = 5, 8, 6
#: A block's number says its part: it is the rest by PARTS.
TEST, DEV, TRAIN, PARTS = 0, 1, 2, 4
ROUNDS, CELL = 60, 4.0
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
#: Seeds that are tried until no two words share a hash.
SEEDS = (0, 2, 4, 6)
WORDS, PAIRS = 0, 1


class Collision(Exception):
    """Two words with one hash."""


class Words(dict):
    """A block's vocabulary: each new word gets the next number; 0 is the end."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


def mix_pair(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two."""
    x = u * np.uint64(0x9E3779B97F4A7C15) + (v ^ (v >> np.uint64(29)))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def pack_sorted(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte planes apart: the high planes are all zeros and cost nothing."""
    steps = np.diff(hashes, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = unpack(data, "u1").reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts of up to 63 bits, byte planes apart: the planes that are all zeros cost nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(data, "u1").reshape(8, -1).T).view("<u8").reshape(-1).astype(np.int64)


def blocks(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Token streams: documents of one part (test, deleted, training) by block."""
    id_kind = docs.schema["doc_id"].dataType
    python_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        made = 0
        held: dict[int, list] = {}

        def flush(part: int) -> pa.RecordBatch:
            nonlocal made
            ids, lengths, streams, words, total = held.pop(part)
            made += 1
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
            checks = np.fromiter((xxhash.xxh64_intdigest(w, seed + 1) & 0xFFFFFFFF for w in words), np.uint32, len(words))
            row = (np.array(lengths, np.uint32).tobytes(), pack(np.concatenate(streams)), np.r_[END, hashes].tobytes(), np.r_[np.uint32(0), checks].tobytes())
            columns = [pa.array([(first + made) * PARTS + part]), pa.array([part], pa.int32()), pa.array([total]), pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.concat_arrays(ids))]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([v], pa.binary()) for v in row)], names=BLOCK_NAMES)

        for batch in batches:
            doc_ids = batch.column("doc_id")
            for i, (rest, text) in enumerate(zip(batch.column("rest").to_pylist(), batch.column("text").cast(pa.binary()))):
                part = TEST if rest == HELD_OUT else DEV if rest == DELETED else TRAIN
                block = held.setdefault(part, [[], [], [], Words(), 0])
                stream = list(map(block[3].__getitem__, (text.as_py() or b"").lower().split()))
                stream.append(0)
                for column, value in zip(block, (doc_ids[i : i + 1], len(stream), np.array(stream, np.uint32))):
                    column.append(value)
                block[4] += len(stream)
                if block[4] >= BLOCK:
                    yield flush(part)
        for part in list(held):
            yield flush(part)

    rest = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(0)).cast("int")
    kind = f"block long, part int, n_tokens long, doc_ids array<{id_kind.simpleString()}>, lengths binary, stream binary, words binary, checks binary"
    return docs.select("doc_id", "text", rest.alias("rest")).mapInArrow(run, kind)


BLOCK_NAMES = ["block", "part", "n_tokens", "doc_ids", "lengths", "stream", "words", "checks"]


def read_block(row: dict) -> dict[str, np.ndarray]:
    """The arrays of a block: tokens and their contexts as numbers of words, and the distinct pairs' hashes, sorted."""
    lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
    stream = unpack(row["stream"], "u4")
    words = np.frombuffer(row["words"], np.uint64)
    first = np.r_[0, np.cumsum(lengths)[:-1]]
    context = np.r_[0, stream[:-1]].astype(np.int64)
    context[first] = len(words)  # the start of a document
    hashes = np.r_[words, START]
    pairs, place, n = np.unique(mix_pair(hashes[context], hashes[stream]), return_inverse=True, return_counts=True)
    return {"lengths": lengths, "first": first, "stream": stream, "context": context, "words": words, "pairs": pairs, "place": place, "n": n.astype(np.uint32)}


ASK_KIND = "unit long, space long, keys binary, known binary, dev binary, checks binary"
ASK_NAMES = [c.split()[0] for c in ASK_KIND.split(", ")]


def asked(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (unit, space, sorted keys, their counts in training and in deleted documents, second hashes or None) packed."""
    columns = list(zip(*rows)) if rows else [()] * 6
    packed = [list(columns[0]), list(columns[1]), [pack_sorted(k) for k in columns[2]], *([pack_counts(n) for n in c] for c in columns[3:5]), [None if c is None else c.tobytes() for c in columns[5]]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(packed, (pa.int64(), pa.int64(), *[pa.binary()] * 4))], names=ASK_NAMES)


def read_asked(table: pa.Table | pa.RecordBatch) -> list[tuple]:
    rows = zip(*(table.column(c).to_pylist() for c in ASK_NAMES))
    return [(unit, space, unpack_sorted(keys), unpack_counts(known), unpack_counts(dev), None if checks is None else np.frombuffer(checks, np.uint32)) for unit, space, keys, known, dev, checks in rows]


def level(bits: int) -> int:
    """How many bits of the hash space are dealt at once where so many are left."""
    return bits if bits <= MOST_BITS else FAN_BITS


def dealt(ask: tuple, depth: int, bits: int) -> Iterator[pa.RecordBatch]:
    """An ask cut by the `bits` bits of its keys that follow their first `depth`, which its space goes on with."""
    unit, space, keys, known, dev, checks = ask
    at = np.searchsorted(keys << np.uint64(depth) >> np.uint64(64 - bits), np.arange(2**bits + 1))
    cuts = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(at, at[1:])) if b > a]
    for first in range(0, len(cuts), 64):
        yield asked([(unit, (space << bits) + k, keys[c], known[c], dev[c], None if checks is None else checks[c]) for k, c in cuts[first : first + 64]])


def questions(packed: DataFrame, bits: int) -> DataFrame:
    """What each block asks: its distinct words and its distinct pairs, and how often it has them itself, dealt by the first bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = read_block(row)
                order = np.argsort(b["words"])
                n = np.bincount(b["stream"], minlength=len(b["words"]))[order]
                as_part = lambda n: (n if row["part"] != TEST else 0 * n, n if row["part"] == DEV else 0 * n)
                checks = np.frombuffer(row["checks"], np.uint32)[order]
                if len(order) > 1 and not np.diff(b["words"][order]).all():
                    raise Collision("two words of a block")
                yield from dealt((row["block"], WORDS, b["words"][order], *as_part(n), checks), 0, bits)
                yield from dealt((row["block"], PAIRS, b["pairs"], *as_part(b["n"]), None), 0, bits)

    return packed.select("block", "part", "lengths", "stream", "words", "checks").mapInArrow(run, ASK_KIND)


def merged(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """Distinct keys, the sums of both counts, their second hashes, and the place of each row's keys among them."""
    keys, first, place = np.unique(np.concatenate([r[2] for r in rows]), return_index=True, return_inverse=True)
    known, dev = np.zeros((2, len(keys)), np.int64)
    for sums, k in ((known, 3), (dev, 4)):
        np.add.at(sums, place, np.concatenate([r[k] for r in rows]))
    checks = None
    if rows[0][5] is not None:
        every = np.concatenate([r[5] for r in rows])
        checks = every[first]
        if (checks[place] != every).any():
            raise Collision("two words of a bucket")
    return keys, known, dev, checks, place


TOLD_KIND = "unit long, space long, told binary, n long, v long, n_kept long"


def answered(rows: list[tuple], place: np.ndarray, known: np.ndarray, dev: np.ndarray, totals: tuple | None = None) -> pa.Table:
    """Each row's counts in the order of its keys, training then deleted; and a row of totals, without a unit."""
    ends = np.cumsum([len(r[2]) for r in rows])
    told = [pack_counts(np.concatenate([known[p], dev[p]])) for p in np.split(place, ends[:-1])]
    out = [(r[0], r[1], t, None, None, None) for r, t in zip(rows, told)]
    if totals is not None:
        out.append((None, rows[0][1], None, *totals))
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in TOLD_KIND.split(", ")])


def told(parts: DataFrame, units: int, bits: int, depth: int = 0) -> DataFrame:
    """Corpus counts for asks of at most `units` units a space that are dealt by level(bits) bits, in pieces by space, whose order is that of an ask's keys. A row
    of words' totals a bucket has the training tokens N, distinct words V, and N without the deleted.
    """

    def answer(table: pa.Table) -> pa.Table:
        rows = read_asked(table)
        keys, known, dev, checks, place = merged(rows)
        totals = (int(known.sum()), int((known > 0).sum()), int(known.sum() - dev.sum())) if checks is not None else None
        return answered(rows, place, known, dev, totals)

    now = level(bits)
    if now == bits:
        return parts.groupBy("space").applyInArrow(answer, TOLD_KIND)

    groups = -(-units // 2**FAN_BITS)
    parts = stage(parts.withColumn("run", F.col("space") * groups + F.pmod(F.xxhash64("unit"), F.lit(groups))))

    following = level(bits - now)

    def merge(table: pa.Table) -> pa.Table:
        keys, known, dev, checks, _ = merged(read_asked(table))
        run, space = table.column("run")[0].as_py(), table.column("space")[0].as_py()
        return pa.Table.from_batches(dealt((run, space, keys, known, dev, checks), depth + now, following))

    further = stage(told(stage(parts.groupBy("run").applyInArrow(merge, ASK_KIND)), groups, bits - now, depth + now))

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = read_asked(left)
        known, dev = counts_in_order(right.column("told")[0].as_py())
        return answered(rows, merged(rows)[4], known, dev)

    back = parts.groupBy("run").cogroup(in_order(further).withColumnRenamed("unit", "run").groupBy("run")).applyInArrow(look_up, TOLD_KIND)
    return back.unionByName(further.where("unit is null"))


def in_order(answers: DataFrame) -> DataFrame:
    """Per unit, its pieces in order: unit, told (array of space and told)."""
    return answers.where("unit is not null").groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("space", "told"))).alias("told"))


def counts_in_order(pieces: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Training and deleted counts from a unit's pieces."""
    split = [unpack_counts(p["told"]).reshape(2, -1) for p in pieces]
    both = np.concatenate(split, axis=1) if split else np.zeros((2, 0), np.int64)
    return both[0], both[1]


def _with_counts(packed: DataFrame, answers: DataFrame) -> DataFrame:
    """Each block with its answers in order."""
    return packed.join(in_order(answers).withColumnRenamed("unit", "block"), "block")


def counts_of(row: dict, b: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Training and deleted counts of the block's words (by number) and of its pairs (sorted by hash)."""
    known, dev = counts_in_order(row["told"])  # words' spaces are less than pairs'
    words, back = len(b["words"]), np.empty(len(b["words"]), np.int64)
    back[np.argsort(b["words"])] = np.arange(words)
    return known[:words][back], dev[:words][back], known[words:], dev[words:]


def orders(b: dict[str, np.ndarray], word_n: np.ndarray, pair_n: np.ndarray, n: int, starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket (-1: never seen), bigram and unigram estimate of each token."""
    context_n = np.r_[word_n, starts][b["context"]]
    bucket = np.where(context_n > 0, np.floor(np.log2(np.maximum(context_n, 1))).astype(np.int64), -1)
    two = pair_n[b["place"]] / np.maximum(context_n, 1)
    return bucket, np.where(context_n > 0, two, 0.0), word_n[b["stream"]] / max(n, 1)


def histogram(packed: DataFrame, told: DataFrame, n_kept: int) -> DataFrame:
    """Deleted tokens by bucket and cell of both estimates: how many, and the sums of the estimates' logarithms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = read_block(row)
                words, words_dev, pairs, pairs_dev = counts_of(row, b)
                kept = words - words_dev
                bucket, two, one = orders(b, kept, pairs - pairs_dev, n_kept, int(kept[0]))
                log = lambda p: np.where(p > 0, np.log2(np.where(p > 0, p, 1)), -999.0)
                two, one = log(two), log(one)
                key = (bucket + 1 << 26) + (np.floor(CELL * two).astype(np.int64) + 4000 << 13) + np.floor(CELL * one).astype(np.int64) + 4000
                key, place, n = np.unique(key, return_inverse=True, return_counts=True)
                cells = (key >> 26) - 1, (key >> 13) % 8192 - 4000, key % 8192 - 4000
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in (*cells, n)), *(pa.array(np.bincount(place, x, len(n)), pa.float64()) for x in (two, one))],
                    names=["bucket", "cell_two", "cell_one", "n", "two", "one"],
                )

    cells = _with_counts(packed.where(F.col("part") == DEV).drop("doc_ids"), told.where(F.col("unit") % PARTS == DEV)).mapInArrow(run, "bucket long, cell_two long, cell_one long, n long, two double, one double")
    return cells.groupBy("bucket", "cell_two", "cell_one").agg(F.sum("n").alias("n"), F.sum("two").alias("two"), F.sum("one").alias("one"))


def learn(cells: list, v: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of buckets 0 to 63, then of the context that was never seen."""
    out = np.tile([1 / 3, 1 / 3, 1 / 3], (65, 1))
    by = {}
    for c in cells:
        by.setdefault(c["bucket"], []).append(c)
    filled = []
    for bucket in range(64):
        if bucket not in by:
            continue
        n = np.array([c["n"] for c in by[bucket]], float)
        p = np.stack([np.array([2.0 ** (c[k] / c["n"]) if c[f"cell_{k}"] > -999 else 0.0 for c in by[bucket]]) for k in ("two", "one")] + [np.full(len(n), 1 / (v + 1))], axis=1)
        weights = out[bucket]
        for _ in range(rounds):
            share = weights * p
            share /= share.sum(axis=1, keepdims=True)
            weights = (n[:, None] * share).sum(axis=0) / n.sum()
        out[bucket] = np.maximum(weights, 1e-6) / np.maximum(weights, 1e-6).sum()
        filled.append(bucket)
    for bucket in range(64):  # no deleted token: as the nearest bucket that has some
        if filled and bucket not in filled:
            out[bucket] = out[min(filled, key=lambda f: (abs(f - bucket), f))]
    low = out[0, 1:]
    out[64] = [0.0, *(low / low.sum())]
    return out


RESULT_NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def scores(packed: DataFrame, told: DataFrame, weights: np.ndarray, n: int, v: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_ids")
            for k, row in enumerate(batch.drop_columns(["doc_ids"]).to_pylist()):
                b = read_block(row)
                words, _, pairs, _ = counts_of(row, b)
                bucket, two, one = orders(b, words, pairs, n, int(words[0]))
                a = weights[bucket]  # -1 is the last row
                model = np.log10(a[:, 0] * two + a[:, 1] * one + a[:, 2] / (v + 1))
                of_word = words[b["stream"]]
                base = np.log10((of_word + 1) / (n + 1 * (v + 1)))
                add = lambda x: np.add.reduceat(x, b["first"])
                size = len(b["lengths"])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[k].values,
                        pa.array(np.full(size, row["part"] == TEST)),
                        pa.array(b["lengths"], pa.int64()),
                        pa.array(add((of_word > 0).astype(np.int64)), pa.int64()),
                        pa.array(np.full(size, n), pa.int64()),
                        pa.array(np.round(add(base), 9)),
                        pa.array(np.round(add(model), 9)),
                    ],
                    names=RESULT_NAMES,
                )

    kinds = (packed.schema["doc_ids"].dataType.elementType.simpleString(), "boolean", "long", "long", "long", "double", "double")
    return _with_counts(packed, told).mapInArrow(run, ", ".join(map(" ".join, zip(RESULT_NAMES, kinds))))


def _counted(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The blocks, and what they are told."""
    packed = stage(blocks(docs, seed))
    tokens, units = packed.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count(F.lit(1))).first()
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, tokens / BUCKET))))
    # few, larger files: what is told takes about two bytes a token
    files = max(2 * docs.sparkSession.sparkContext.defaultParallelism, tokens // FILE)
    return packed, stage(told(questions(packed, level(bits)), units, bits).coalesce(files))


def score(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, both log10."""
    for seed in SEEDS:
        try:
            packed, answers = _counted(docs, seed)
            break
        except PythonException as error:
            if "Collision" not in str(error) or seed == SEEDS[-1]:
                raise
    totals = answers.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"), F.coalesce(F.sum("n_kept"), F.lit(0)).alias("k")).first()
    weights = learn(histogram(packed, answers, totals["k"]).collect(), totals["v"])  # at most 65 times some 140 by 140 cells
    scored = scores(packed, answers, weights, totals["n"], totals["v"])
    return scored.coalesce(max(2 * docs.sparkSession.sparkContext.defaultParallelism, totals["n"] // FILE))


digest = score
