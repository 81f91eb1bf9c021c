"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

The centroids and the codebooks are fitted on the driver on at most `SAMPLE` vectors, those with the least hash of
vec_id; every row is indexed. A row goes to the list of its nearest centroid with one byte per subspace of its
residual (unit vectors less their mean, so that nearness by distance is nearness by cosine, and vectors that all point one way
stay apart). A query probes the lists nearest to it, and
for these makes tables of inner products, one per subspace (its own, shared by all lists, plus one with the
centroid), and adds up each code's entries, less half the square of what is coded. The best codes of all lists are its one
shortlist, whose rows alone are fetched and reranked by the exact cosine of the original vectors in double precision.

How many lists are probed and how long the shortlist is follow from the sample and from the queries: for CHECKED rows of each the true
neighbours are found by brute force, among the sample and among all rows, and both are as large as FOUND of these ask for,
each, equal codes counted (and, by the sample, the shortlist as many times longer as there are more rows than the sample has). So
clustered vectors need few probes; vectors without clusters, or queries that lie apart from the rows, need most lists.

Rows are dealt to tasks by ranges of lists and, in a list, of rows, so a list of any length is split. Queries go to the tasks
in broadcast blocks of at most QUERIES, however many there are, and a task answers with its best codes a query, so what is
moved is the shortlists. A vector with a third of all rows is first cut to those copies that can be in a result: ties go
to smaller ids, so that is 2K of them.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, as queries or
candidates; rows that share a vec_id are candidates each, except for queries of that id, and answer as one query; a null vec_id takes no part;
fewer than K candidates give all of them; vectors of different lengths raise a ValueError; ties go to the smaller id; further
columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_sample, python_workers, stage

#: The bound on vectors that centroids and codebooks are fitted on.
SAMPLE = 16_384
K, QUERY_STEP = 5, 50
SUBSPACES, CODES, ITERATIONS = 32, 256, 8
#: Rows of the sample that codebooks are fitted on, rows of the sample and queries whose neighbours are checked, and the share of these to be found.
BOOK_ROWS, CHECKED, FOUND = 8192, 512, 0.985
LEAST_LISTS, MOST_LISTS, LEAST_PROBES, LEAST_SHORTLIST = 4, 4096, 8, 64
#: Queries that are broadcast at once, queries and rows times queries that a task looks at together.
QUERIES, TOGETHER, CELLS = 16_384, 128, 8_000_000
#: Rows of whole lists that are looked up at once.
RUN = 1024


class Index(NamedTuple):
    centroids: np.ndarray  # lists by dimensions
    books: np.ndarray  # subspaces by codes by dimensions of a subspace
    probes: int
    shortlist: int
    mean: np.ndarray  # of the sample's unit vectors


def usable(v: Column) -> Column:
    """Finite, complete and not zero."""
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(v.isNotNull() & fit, F.lit(False))


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means from distinct rows drawn at random; an empty cluster keeps its centre."""
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(ITERATIONS):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * (x @ centres.T), axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top  # else squares of very large or small components leave the range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centred(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Unit vectors less a mean, with zeros up to as many components as the subspaces have together."""
    width = x.shape[1]
    each = -(-width // SUBSPACES)
    return np.pad((x - mean).astype(np.float32), ((0, 0), (0, -width % each)))


def fit_rows(x: np.ndarray, n: int, k: int = K) -> Index:
    """An index for about n rows like x, whose rows are unit vectors."""
    rng = np.random.default_rng(11)
    mean = x.mean(axis=0)
    x = centred(x, mean)
    lists = int(max(LEAST_LISTS, min(MOST_LISTS, 2 ** round(math.log2(max(1, math.sqrt(n)))))))
    centroids = _means(x, lists, rng)
    subspaces = x.shape[1] // -(-x.shape[1] // SUBSPACES)
    parts = (x - centroids[nearest(x, centroids)])[:BOOK_ROWS].reshape(min(len(x), BOOK_ROWS), subspaces, -1)
    books = []
    for s in range(subspaces):
        book = _means(np.ascontiguousarray(parts[:, s]), CODES, rng)
        books.append(np.vstack([book, np.repeat(book[:1], CODES - len(book), axis=0)]))
    index = Index(centroids, np.stack(books), len(centroids), len(x), mean)
    return index._replace(**dict(zip(("probes", "shortlist"), _wanted(index, x, n, k, rng))))


def _wanted(index: Index, x: np.ndarray, n: int, k: int, rng: np.random.Generator) -> tuple[int, int]:
    """Lists to probe and length of the shortlist by which FOUND of the checked rows' true neighbours are met."""
    k = min(k, len(x) - 1)
    if k < 1:
        return len(index.centroids), LEAST_SHORTLIST
    at, codes = encode(index, x)
    places, ranks = [], []
    for own in np.array_split(rng.permutation(len(x))[:CHECKED], min(8, len(x))):
        exact = x[own] @ x.T - (x**2).sum(axis=1) / 2
        exact[np.arange(len(own)), own] = -np.inf
        true = np.argpartition(-exact, k - 1, axis=1)[:, :k]
        order = np.argsort(list_order(index, x[own]), axis=1)
        places.append(np.take_along_axis(order, at[true], axis=1).ravel())
        guess = guesses(index, x[own], at, codes)
        guess[np.arange(len(own)), own] = -np.inf
        ranks += [np.count_nonzero(g >= g[t]) for g, row in zip(guess, true) for t in row]
    return _enough(index, np.concatenate(places), np.array(ranks) * max(1.0, n / len(x)), k)


def _enough(index: Index, places: np.ndarray, ranks: np.ndarray, k: int) -> tuple[int, int]:
    """Probes and length of a shortlist by which FOUND of some rows are met: their lists' places from 0, and their own from 1."""
    place, rank = (float(np.quantile(v, FOUND)) for v in (places, ranks))
    return min(len(index.centroids), max(LEAST_PROBES, math.ceil(place) + 1)), max(LEAST_SHORTLIST, 4 * k, math.ceil(rank))


def list_order(index: Index, queries: np.ndarray) -> np.ndarray:
    """The lists of each query, nearest first."""
    return np.argsort((index.centroids**2).sum(axis=1) - 2 * (queries @ index.centroids.T), axis=1, kind="stable")


def guesses(index: Index, queries: np.ndarray, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The nearness of each query and each coded row, by tables of the query's products with the codebooks: their inner product less half the
    row's square, which falls as their distance grows.
    """
    tables = np.einsum("qsd,scd->scq", queries.reshape(len(queries), len(index.books), -1), index.books)
    out = (index.centroids @ queries.T)[at]  # a row's entries for all queries stand together
    out -= (decoded(index, at, codes) ** 2).sum(axis=1, keepdims=True) / 2
    for s, table in enumerate(tables):
        out += table[codes[:, s]]
    return out.T


def decoded(index: Index, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """What lists and codes stand for."""
    return index.centroids[at] + index.books[np.arange(len(index.books)), codes].reshape(len(at), -1)


def encode(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """List and codes of each centred vector."""
    at = nearest(x, index.centroids)
    parts = (x - index.centroids[at]).reshape(len(x), len(index.books), -1)
    return at, np.stack([nearest(np.ascontiguousarray(parts[:, s]), b) for s, b in enumerate(index.books)], axis=1).astype(np.uint8)


def cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact cosines in double precision of each query with its row, each by itself, so that copies have equal ones.

    Scaling by a power of two changes no digit, and keeps squares of very large or small components in range.
    """
    queries, rows = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (queries, rows))
    return (rows * queries).sum(axis=1) / (np.sqrt((queries * queries).sum(axis=1)) * np.sqrt((rows * rows).sum(axis=1)))


def shortlisted(index: Index, sizes: np.ndarray, at: np.ndarray, codes: np.ndarray, ids: np.ndarray, names: np.ndarray, queries: np.ndarray, needed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some queries at a time: numbers of queries, places of their best codes among the rows, and what the codes promise.

    `sizes` are those of all lists; a query probes as many as the index says, and more until they hold the rows it needs.
    """
    by_list = np.argsort(at, kind="stable")
    at, codes, ids = at[by_list], codes[by_list], ids[by_list]
    ends = np.r_[np.unique(at, return_index=True)[1][1:], len(at)]  # of lists
    ends = ends[np.r_[np.flatnonzero(ends[1:] // RUN != ends[:-1] // RUN), len(ends) - 1]]
    runs = list(zip(np.r_[0, ends[:-1]], ends))
    by_id = np.argsort(ids, kind="stable")
    most = max(1, min(TOGETHER, CELLS // max(1, len(at))))
    for first in range(0, len(names), most):
        part, own = queries[first : first + most], names[first : first + most]
        order = list_order(index, part)
        held = np.cumsum(sizes[order], axis=1)
        probes = np.maximum(index.probes, (held < needed[first : first + most, None]).sum(axis=1) + 1)
        probed = np.zeros((len(part), len(index.centroids)), bool)
        np.put_along_axis(probed, order, np.arange(order.shape[1])[None] < probes[:, None], axis=1)
        guess = np.full((len(part), len(at)), -np.inf, np.float32)
        for a, b in runs:  # of a few lists: those who probe none of them are left out, then who doesn't probe a list
            who = np.flatnonzero(probed[:, np.unique(at[a:b])].any(axis=1))
            if len(who):
                guess[who, a:b] = np.where(probed[who][:, at[a:b]], guesses(index, part[who], at[a:b], codes[a:b]), -np.inf)
        for q, (a, b) in enumerate(zip(*(np.searchsorted(ids, own, side, sorter=by_id) for side in ("left", "right")))):
            guess[q, by_id[a:b]] = -np.inf
        if guess.shape[1] > index.shortlist:
            best = np.argpartition(-guess, index.shortlist - 1, axis=1)[:, : index.shortlist]
        else:
            best = np.broadcast_to(np.arange(guess.shape[1]), guess.shape)
        found = np.take_along_axis(guess, best, axis=1)
        who, place = np.nonzero(found > -np.inf)
        yield first + who, by_list[best[who, place]], found[who, place]


def _doubles(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, int)
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths")
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def fit(rows: DataFrame, n: int, sample: int = SAMPLE, k: int = K) -> Index:
    found = hash_sample(rows.select("vec_id", "embedding"), "vec_id", sample).select("embedding").toArrow()
    return fit_rows(unit(_doubles(found.column("embedding"))), n, k)


def _few_copies(rows: DataFrame, k: int) -> DataFrame:
    """The rows without copies of a vector that can't be in a result: K of an id and 2K in all, smallest ids first, are kept."""
    hashed = rows.withColumn("_hash", F.xxhash64("embedding"))
    often = stage(hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 2 * k).select("_hash"))
    if often.isEmpty():
        return rows
    place = lambda *by: F.row_number().over(Window.partitionBy("_hash", *by).orderBy("vec_id"))
    many = hashed.join(often, "_hash", "left_semi").withColumn("_own", place("embedding", "vec_id")).where(F.col("_own") <= k)
    many = many.withColumn("_all", place("embedding")).where(F.col("_all") <= 2 * k)
    return hashed.join(often, "_hash", "left_anti").select(*rows.columns).unionByName(many.select(*rows.columns))


def search(embeddings: DataFrame, is_query: Column, *, k: int = K, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query, the k nearest others found."""
    spark = embeddings.sparkSession
    python_workers(spark)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("is_query"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    n, least, most = rows.agg(F.count(F.lit(1)), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if least != most:
        raise ValueError(f"vectors of different lengths: {least} to {most}")
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(rows, n, sample, k)
    sent = spark.sparkContext.broadcast(tuple(index))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Index(*sent.value)
        for batch in batches:
            if batch.num_rows:
                at, codes = encode(known, centred(unit(_doubles(batch.column("embedding"))), known.mean))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("embedding"), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "embedding", "list", "codes"]
                )

    few = _few_copies(rows.select("vec_id", "embedding"), k)
    placed = few.mapInArrow(place, "vec_id long, embedding array<double>, list int, codes binary")
    # dealt by lists, and staged, so that each row keeps its number
    placed = stage(placed.repartitionByRange("list", "vec_id").withColumn("row", F.monotonically_increasing_id()))
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in placed.groupBy("list").count().collect():  # at most MOST_LISTS rows
        sizes[r["list"]] = r["count"]
    # a query's repeated rows ask once, and `own` rows are none of its candidates
    asked = rows.where("is_query").select("vec_id", "embedding")
    asked = stage(asked.distinct().join(stage(asked.groupBy("vec_id").agg(F.count(F.lit(1)).alias("own"))), "vec_id"))
    blocks = -(-asked.count() // QUERIES)
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = checked(placed, asked, index, k)
    found = None
    for b in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        part = _answers(placed, block, index, sizes, k)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def checked(placed: DataFrame, asked: DataFrame, index: Index, k: int) -> Index:
    """The index, with as many probes and as long a shortlist as the true neighbours of CHECKED queries among all rows ask for, if more.

    Two passes over the rows: each task's nearest k of a checked query, and for the nearest k of all how many codes promise as much.
    """
    table = hash_sample(asked.select("vec_id", "embedding"), "vec_id", CHECKED).toArrow()
    names, vectors = table.column("vec_id").to_numpy(), unit(_doubles(table.column("embedding")))
    queries = centred(vectors, index.mean)
    sent = placed.sparkSession.sparkContext.broadcast((tuple(index), names, vectors, queries))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, names, vectors, _ = sent.value
        best = np.full((len(names), k), -np.inf)
        at, codes = np.zeros(best.shape, np.int32), np.full(best.shape, b"", object)
        for batch in batches:
            if batch.num_rows:
                score = vectors @ unit(_doubles(batch.column("embedding"))).T
                score[names[:, None] == batch.column("vec_id").to_numpy()] = -np.inf
                score = np.hstack([best, score])
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                best = np.take_along_axis(score, top, axis=1)
                old, new = top < k, np.maximum(top - k, 0)
                at = np.where(old, np.take_along_axis(at, np.minimum(top, k - 1), axis=1), batch.column("list").to_numpy()[new])
                codes = np.where(old, np.take_along_axis(codes, np.minimum(top, k - 1), axis=1), np.array(batch.column("codes").to_pylist(), object)[new])
        who, place = np.nonzero(best > -np.inf)
        found = [who.astype(np.int32), best[who, place], at[who, place].astype(np.int32)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, found), pa.array(list(codes[who, place]), pa.binary())], names=["query", "score", "list", "codes"])

    first = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc()))
    true = placed.select("vec_id", "embedding", "list", "codes").mapInArrow(near, "query int, score double, list int, codes binary").withColumn("r", first).where(F.col("r") <= k).drop("r").toArrow()
    if not true.num_rows:
        return index
    who, at = true.column("query").to_numpy(), true.column("list").to_numpy()
    codes = np.frombuffer(b"".join(true.column("codes").to_pylist()), np.uint8).reshape(len(who), -1)
    rows, own = decoded(index, at, codes), queries[who]
    size = np.sqrt((rows**2).sum(axis=1))
    promised = (rows * own).sum(axis=1) - size**2 / 2 - 1e-6 * size * (size + np.sqrt((own**2).sum(axis=1)))  # less what sums in another order differ by
    sought = placed.sparkSession.sparkContext.broadcast((who, promised))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names, _, queries = sent.value
        who, promised = sought.value
        n = np.zeros(len(who), np.int64)
        for batch in batches:
            if batch.num_rows:
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                guess = guesses(Index(*known), queries, batch.column("list").to_numpy(), codes)
                guess[names[:, None] == batch.column("vec_id").to_numpy()] = -np.inf
                n += [np.count_nonzero(guess[q] >= p) for q, p in zip(who, promised)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["place", "n"])

    ranks = placed.select("vec_id", "list", "codes").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow().column("n").to_numpy()
    place = np.argsort(list_order(index, queries), axis=1)[who, at]
    probes, shortlist = _enough(index, place, ranks, k)
    return index._replace(probes=max(index.probes, probes), shortlist=max(index.shortlist, shortlist))


def _answers(placed: DataFrame, asked: DataFrame, index: Index, sizes: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, row, score of the shortlists of a block of queries, which is all that is collected here."""
    spark = placed.sparkSession
    table = asked.toArrow()
    names, vectors = table.column("vec_id").to_numpy(), _doubles(table.column("embedding"))
    sent = spark.sparkContext.broadcast((tuple(index), sizes, names, vectors, table.column("own").to_numpy()))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([b for b in batches if b.num_rows] or [], schema=pa.schema([("vec_id", pa.int64()), ("list", pa.int32()), ("codes", pa.binary()), ("row", pa.int64())]))
        if not held.num_rows:
            return
        known, sizes, names, vectors, own = sent.value
        known = Index(*known)
        at, ids, row = (held.column(c).to_numpy() for c in ("list", "vec_id", "row"))
        codes = np.frombuffer(b"".join(held.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        for who, place, guess in shortlisted(known, sizes, at, codes, ids, names, centred(unit(vectors), known.mean), own + k):
            asked, first = np.unique(who, return_index=True)  # of each query, its codes stand together
            offsets = pa.array(np.r_[first, len(who)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(asked.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(row[place])), pa.ListArray.from_arrays(offsets, pa.array(guess))], names=["query", "rows", "guesses"])

    def best(table: pa.Table) -> pa.Table:
        row, guess = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("rows", "guesses"))
        top = np.lexsort((row, -guess))[: index.shortlist]
        return pa.table({"query": pa.array(np.full(len(top), table.column("query")[0].as_py(), np.int32)), "row": pa.array(row[top])})

    near = placed.select("vec_id", "list", "codes", "row").mapInArrow(probe, "query int, rows array<long>, guesses array<float>")
    near = near.groupBy("query").applyInArrow(best, "query int, row long")
    pairs = placed.select("vec_id", "row", "embedding").join(near, "row")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, names, vectors, _ = sent.value
        for batch in batches:
            if batch.num_rows:
                who = batch.column("query").to_numpy()
                score = cosines(vectors[who], _doubles(batch.column("embedding")))
                yield pa.RecordBatch.from_arrays([pa.array(names[who]), batch.column("vec_id"), batch.column("row"), pa.array(score)], names=["query_id", "vec_id", "row", "score"])

    answered = pairs.select("query", "vec_id", "row", "embedding").mapInArrow(rerank, "query_id long, vec_id long, row long, score double")
    # rows of a query with different vectors answer together: a candidate row counts once, by its best score
    return answered.groupBy("query_id", "vec_id", "row").agg(F.max("score").alias("score"))


def digest(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, F.col("vec_id") % QUERY_STEP == 0)
