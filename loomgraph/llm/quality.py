"""Quality classifier: similarity-weighted votes of labelled neighbours in a latent-semantic space.

A text becomes two groups of features: hashed words (1 + log count, weighted by inverse document
frequency) and the shapes of its words (classes of first and last character, repeats of the previous word,
shortness). A truncated singular value decomposition of the labelled sample gives the latent space. The
sample's vectors are broadcast; every document's exact cosines with all of them come from blocked matrix
products, and its nearest `NEIGHBOURS` vote with a power of their cosine.

The model is fitted on at most `SAMPLE` labelled rows, those with the least hash of doc_id, on the driver:
at most SAMPLE times WIDTH numbers, whatever the corpus's size. Scoring is one pass over the documents,
without a shuffle; texts are read whole.

Defined cases: null and empty texts are one and the same text, without words but with the shape feature of
shortness, and so vote like the shortest; labels of one doc_id are averaged; null labels and ids teach
nothing; without any label each score is 0.5; rows that repeat a doc_id are scored one by one, and one of them teaches, that of the least features; labelled rows as near as
the last neighbour all vote, so copies in the sample don't depend on its order; cosines are single precision, so scores may
differ in the last of their nine digits with the shape of a block; very long texts are read whole; an empty table gives
no rows. A column of the documents that is called like the score is replaced by `score` and kept by `keep`.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, hash_sample, python_workers, stage

#: Hashed words, hashed shapes, then one feature each for repeats and for shortness.
WORDS, SHAPES = 8192, 254
WIDTH = WORDS + SHAPES + 2
#: The bound on labelled rows that the model is fitted on.
SAMPLE = 4096
RANK, NEIGHBOURS, POWER, BLOCK = 48, 16, 8, 512
WORD_SHARE, REPEAT_SHARE, SHORT = 0.4, 3.0, 8
THRESHOLD, FOLDS, HELD_OUT = 0.3, 5, 0
#: Letters of either case, digits, and every other byte for itself.
CLASSES = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))

Sparse = tuple[np.ndarray, np.ndarray]


class Model(NamedTuple):
    weights: np.ndarray  # of each feature
    basis: np.ndarray  # WIDTH by rank
    vectors: np.ndarray  # of the sample, of length 1
    labels: np.ndarray


def features(text: bytes) -> Sparse:
    """Indexes and values, before weighting."""
    words = text.split()
    n = len(words)
    if not n:
        return np.array([WIDTH - 1], np.int32), np.array([1.0], np.float32)
    counts = Counter(text.lower().split())
    index = np.fromiter((zlib.crc32(w) % WORDS for w in counts), np.int64, len(counts))
    said = np.bincount(index, 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts))), WORDS)
    at = np.flatnonzero(said)
    shapes = Counter([w[:1] + w[-1:] for w in text.translate(CLASSES).split()])
    shape = np.zeros(SHAPES + 2)
    for s, c in shapes.items():
        shape[zlib.crc32(s) % SHAPES] += c / n
    shape[SHAPES] = REPEAT_SHARE * sum(map(eq, words, words[1:])) / n
    shape[SHAPES + 1] = 1 / (1 + n / SHORT)
    to = np.flatnonzero(shape)
    said = said[at] * (WORD_SHARE / np.sqrt((said[at] ** 2).sum()))
    return np.r_[at, to + WORDS].astype(np.int32), np.r_[said, np.sqrt(shape[to])].astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


class Sample:
    """Weighted rows of length 1, never held densely but for a block of ROWS."""

    ROWS = 256

    def __init__(self, rows: list[Sparse]):
        self.at = np.concatenate([i for i, _ in rows])
        values = np.concatenate([v for _, v in rows])
        self.ends = np.cumsum([len(i) for i, _ in rows])
        n = len(rows)
        self.weights = np.log((1 + n) / (1 + np.bincount(self.at[values > 0], minlength=WIDTH))).astype(np.float32)
        self.weights[WORDS:] = 1
        values *= self.weights[self.at]
        starts = self.ends - np.diff(self.ends, prepend=0)
        norms = np.sqrt(np.add.reduceat(values.astype(np.float64) ** 2, starts))
        self.values = values / np.repeat(np.maximum(norms, 1e-9), self.ends - starts).astype(np.float32)

    def blocks(self) -> Iterator[tuple[slice, np.ndarray]]:
        block, n = np.empty((self.ROWS, WIDTH), np.float32), len(self.ends)
        for first in range(0, n, self.ROWS):
            to = min(first + self.ROWS, n)
            a, b = self.ends[first - 1] if first else 0, self.ends[to - 1]
            block[:] = 0
            block[np.repeat(np.arange(to - first), np.diff(self.ends[first:to], prepend=a)), self.at[a:b]] = self.values[a:b]
            yield slice(first, to), block[: to - first]

    def times(self, space: np.ndarray) -> np.ndarray:
        out = np.empty((len(self.ends), space.shape[1]), np.float32)
        for rows, x in self.blocks():
            out[rows] = x @ space
        return out

    def gram_times(self, space: np.ndarray) -> np.ndarray:
        """The sample's transpose by the sample by `space`."""
        out = np.zeros_like(space)
        for _, x in self.blocks():
            out += x.T @ (x @ space)
        return out


def fit_rows(rows: list[Sparse], labels: np.ndarray, rank: int = RANK) -> Model:
    """The decomposition by seeded subspace iteration, which goes over the sample a few times, block by block."""
    sample = Sample(rows)
    space = np.random.default_rng(7).standard_normal((WIDTH, min(rank + 8, len(rows)))).astype(np.float32)
    for _ in range(4):
        space, _ = np.linalg.qr(sample.gram_times(space))
    _, _, turn = np.linalg.svd(sample.times(space), full_matrices=False)
    basis = (space @ turn.T)[:, :rank].astype(np.float32)
    return Model(sample.weights, basis, _unit(sample.times(basis)).astype(np.float32), labels.astype(np.float64))


def fold(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model | None:
    """Learn from labelled documents outside the held-out fold; None if there are none."""
    python_workers(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    known = known.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label"))
    # the sample is drawn from labels that have a document here: others would use it up
    known = stage(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    chosen = stage(hash_sample(known, "doc_id", sample), rows=sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([at.tobytes() for at, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())],
                names=["doc_id", "label", "at", "value"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(run, f"doc_id {kind}, label double, at binary, value binary")
    # a row an id, however often it is repeated; at most `sample` rows, of which none is longer than WIDTH
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("at", "value", "label")).alias("r")).select("doc_id", "r.*")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "at", "value").limit(sample).select("label", "at", "value").toArrow()
    if not rows.num_rows:
        return None
    arrays = ([np.frombuffer(x.as_buffer(), kind) for x in rows.column(name)] for name, kind in (("at", np.int32), ("value", np.float32)))
    return fit_rows(list(zip(*arrays)), rows.column("label").to_numpy())


def votes(model: Model, rows: list[Sparse], neighbours: int = NEIGHBOURS, power: int = POWER) -> np.ndarray:
    """Scores in [0, 1] by exact cosines with the whole sample, a block of documents at a time."""
    out = np.empty(len(rows))
    k = min(neighbours, len(model.labels))
    prior = model.labels.mean()
    for at in range(0, len(rows), BLOCK):
        part = rows[at : at + BLOCK]
        x = np.stack([(v * model.weights[i]) @ model.basis[i] for i, v in part])
        cosines = _unit(x) @ model.vectors.T
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, 1).astype(np.float64), 0) ** power
        total, said = weight.sum(axis=1), (weight * model.labels[near]).sum(axis=1)
        least = np.take_along_axis(cosines, near, 1).min(axis=1, keepdims=True)
        for i in np.flatnonzero((cosines >= least).sum(axis=1) > k):  # ties at the last place
            every = np.flatnonzero(cosines[i] >= least[i])
            weight = np.maximum(cosines[i, every].astype(np.float64), 0) ** power
            total[i], said[i] = weight.sum(), (weight * model.labels[every]).sum()
        out[at : at + BLOCK] = np.where(total > 0, said / np.where(total > 0, total, 1), prior)
    return np.clip(np.round(out, 9), 0, 1)


def score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """The documents with their score beside their columns (one of its name is replaced)."""
    docs = docs.drop(name)
    if model is None:
        return docs.withColumn(name, F.lit(0.5))
    python_workers(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*sent.value)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            scores = [votes(known, [features(t.as_py() or b"") for t in texts[at : at + BLOCK]]) for at in range(0, batch.num_rows, BLOCK)]
            yield batch.append_column(name, pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64()))

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, DoubleType()))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    held = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    if model is None:
        scored = score(docs.select("doc_id", "text"), None)
    else:
        scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected."""
    name = free_name(docs, "score")
    return score(docs, fit(docs, labels), name).where(F.col(name) >= THRESHOLD).drop(name)
