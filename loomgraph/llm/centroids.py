"""Centroid clustering in exact integers, with Hamerly's bounds.

Each vector carries its cluster, one upper bound on the distance to its centroid and one lower bound on the distance to its
second-nearest one. When centroids move, the upper bound grows by the drift of the vector's own centroid and
the lower one shrinks by the largest drift of any other. A vector whose upper bound is below its lower bound, or below half
the way from its centroid to the nearest other one, keeps its cluster unseen; of the others the upper bound is made exact first,
and those that are still ambiguous get a full exact scan of all centroids. Bounds are doubles that are widened by more than
their rounding, and a comparison must be strict, so a tie is always scanned and goes to the smaller number.

A round writes the vectors with their bounds to the shared folder, a task each for itself, without a shuffle, and the round before it is
deleted. Vectors that have changed cluster, and only those, send the sums of their components: one row a cluster and batch,
added up before a shuffle of at most a row a cluster and task. The driver holds the centroids, `k` times `dims` whole numbers.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component take no part; a row whose id is repeated is
a vector of its own, and among equal hashes of the start the smaller components come first; null ids hash after all others and
stay in the result; fewer vectors than `k` are as many centroids, and no vectors give no rows; empty clusters stay where they are;
other columns are not read. A component whose whole number is 2^27 or more away from 0 raises an error: squared
distances would not fit 63 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_workers, shared_dir, stage
from ..staging import discard

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, "2"
#: Squared distances between whole numbers below this fit 63 bits, for up to 128 components.
LARGEST = 1 << 27
#: Below this, sums of products are whole numbers that a double holds exactly.
EXACT = 1 << 22
#: More than doubles lose in a root and a sum of a few.
WIDEN = 1e-9
STATE = "vec_id {}, vector array<int>, was int, cluster int, upper double, lower double"


def whole_vectors(embeddings: DataFrame, *, dims: int = DIMS, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector): floor(scale * x) of the vectors that take part."""
    x = F.col(vector).cast("array<double>")
    sound = (F.size(x) == dims) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    scaled = F.transform(x, lambda v: F.floor(v * scale))
    fits = F.forall(F.transform(x, lambda v: v * scale), lambda v: (v >= -LARGEST) & (v < LARGEST))
    checked = F.when(fits, scaled).otherwise(F.raise_error(F.lit(f"a component times {scale} does not fit {LARGEST}")))
    return embeddings.where(F.coalesce(sound, F.lit(False))).select("vec_id", checked.cast("array<int>").alias("vector"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The vectors with the least hash of `seed:vec_id`, in its order: k rows come to the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "vector").orderBy(F.col("key").asc_nulls_last(), "vector").limit(k).select("vector").collect()
    return np.array([r["vector"] for r in rows], np.int64)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exactly; by matrix products of doubles where these are exact."""
    kind = np.float64 if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT else np.int64
    a, c = x.astype(kind), centroids.astype(kind)
    found = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None, :]
    return found.astype(np.int64)


def own_distances(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    away = x.astype(np.int64) - centroids[cluster]
    return (away * away).sum(axis=1)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector the nearest centroid (of ties the first), and bounds: upper on it, lower on the second-nearest."""
    far = distances(x, centroids)
    nearest = far.argmin(axis=1)  # the first of equals
    best = far[np.arange(len(x)), nearest]
    if len(centroids) > 1:
        far[np.arange(len(x)), nearest] = np.iinfo(np.int64).max
        second = np.sqrt(far.min(axis=1).astype(np.float64)) * (1 - WIDEN)
    else:
        second = np.full(len(x), np.inf)
    return nearest, np.sqrt(best.astype(np.float64)) * (1 + WIDEN), second


def reassign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters and bounds once the centroids have drifted to where they are, and how many vectors were scanned in full."""
    k = len(centroids)
    half = np.full(k, np.inf)
    most = np.zeros(k)  # the largest drift of another centroid
    if k > 1:
        between = np.sqrt(distances(centroids, centroids).astype(np.float64))
        np.fill_diagonal(between, np.inf)
        half = between.min(axis=1) / 2 * (1 - WIDEN)
        order = np.argsort(drift)
        most[:] = drift[order[-1]]
        most[order[-1]] = drift[order[-2]]
    upper = (upper + drift[cluster]) * (1 + WIDEN)
    lower = np.maximum(lower - most[cluster] * (1 + WIDEN), 0) * (1 - WIDEN)
    cluster = cluster.copy()
    bound = np.maximum(lower, half[cluster])
    unsure = np.flatnonzero(~(upper < bound))
    upper[unsure] = np.sqrt(own_distances(x[unsure], centroids, cluster[unsure]).astype(np.float64)) * (1 + WIDEN)
    ambiguous = unsure[~(upper[unsure] < bound[unsure])]
    if len(ambiguous):
        cluster[ambiguous], upper[ambiguous], lower[ambiguous] = scan(x[ambiguous], centroids)
    return cluster, upper, lower, len(ambiguous)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def assign(state: DataFrame, centroids: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    """The next round's vectors with their bounds; all are scanned if there is no drift yet."""
    kind = state.schema["vec_id"].dataType.simpleString()
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"), dims)
            if drift is None:
                was = np.full(len(x), -1)
                cluster, upper, lower = scan(x, centroids)
            else:
                was = batch.column("cluster").to_numpy()
                cluster, upper, lower, _ = reassign(x, was, batch.column("upper").to_numpy(), batch.column("lower").to_numpy(), centroids, drift)
            columns = [batch.column("vec_id"), batch.column("vector"), pa.array(was, pa.int32()), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vector", "was", "cluster", "upper", "lower"])

    return state.mapInArrow(run, STATE.format(kind))


def moved_sums(state: DataFrame, k: int, dims: int) -> tuple[list[list[int]], list[int]]:
    """What the vectors that have changed cluster add to the sums and counts of each: k rows come to the driver."""
    fields = ", ".join(f"s{i} bigint" for i in range(dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), dims).astype(np.int64)
            sums, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
            for name, sign in (("cluster", 1), ("was", -1)):
                at = batch.column(name).to_numpy()
                there = at >= 0
                np.add.at(sums, at[there], sign * x[there])
                np.add.at(count, at[there], sign)
            some = np.flatnonzero((count != 0) | sums.any(axis=1))
            columns = [pa.array(some, pa.int32()), pa.array(count[some]), *(pa.array(sums[some, i]) for i in range(dims))]
            yield pa.RecordBatch.from_arrays(columns, names=["c", "n", *(f"s{i}" for i in range(dims))])

    moved = state.where("was <> cluster").select("vector", "was", "cluster")
    parts = moved.mapInArrow(run, f"c int, n bigint, {fields}")
    exact = [F.sum(F.col(name).cast("decimal(19,0)")).alias(name) for name in ("n", *(f"s{i}" for i in range(dims)))]
    sums, counts = [[0] * dims for _ in range(k)], [0] * k
    for r in parts.groupBy("c").agg(*exact).collect():
        counts[r["c"]] = int(r["n"])
        sums[r["c"]] = [int(r[f"s{i}"]) for i in range(dims)]
    return sums, counts


def cluster(embeddings: DataFrame, *, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED, vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, vector, cluster, distance) of every vector that takes part, and the centroids after `rounds` rounds."""
    spark = embeddings.sparkSession
    python_workers(spark)
    vectors = stage(whole_vectors(embeddings, dims=dims, scale=scale, vector=vector))
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("bigint")}), centroids
    sums, counts = [[0] * dims for _ in centroids], [0] * len(centroids)
    state, folder, drift = vectors, None, None
    for at in range(rounds + 1):
        written = shared_dir(spark)
        state = stage(assign(state, centroids, drift), path=written)
        if folder:
            discard(spark, folder)  # the round before this one
        folder = written
        if at == rounds:
            break
        more, counted = moved_sums(state, len(centroids), dims)
        sums = [[a + b for a, b in zip(x, y)] for x, y in zip(sums, more)]
        counts = [a + b for a, b in zip(counts, counted)]
        moved = np.array([[s // n for s in row] if n else list(old) for row, n, old in zip(sums, counts, centroids.tolist())], np.int64)
        drift = np.sqrt(((moved - centroids) ** 2).sum(axis=1).astype(np.float64)) * (1 + WIDEN)
        centroids = moved
    # distances in whole numbers, without Python
    numbered = [F.array(*map(F.lit, row)).cast("array<bigint>") for row in centroids.tolist()]
    own = F.element_at(F.array(*numbered), F.col("cluster") + 1)
    squared = F.zip_with("vector", own, lambda x, c: (x - c) * (x - c))
    distance = F.aggregate(squared, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return state.select("vec_id", "vector", "cluster", distance.alias("distance")), centroids


def digest(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row a vector."""
    spark = embeddings.sparkSession
    found, centroids = cluster(embeddings)
    shas = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()}
    known = [(c, sums.get(c, 0), sum(sums.values()), sha) for c, sha in enumerate(shas)]
    told = spark.createDataFrame(known, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.drop("vector").join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds() -> str:
    """The rounds of the SQL: a table of assignments and one of centroids each, by (vector, component)."""
    near = "n{0} AS (SELECT row_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT v.row_id, c.cluster, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v.x, c.x)])::BIGINT AS d FROM v CROSS JOIN c{0} c) GROUP BY row_id)"
    move = (
        "m{0} AS (SELECT cluster, list((s - (s % n + n) % n) // n ORDER BY i) AS x FROM (SELECT n.cluster, i, sum(v.x[i])::BIGINT AS s, count(*)::BIGINT AS n FROM v JOIN n{0} n USING (row_id), generate_series(1, {2}) g(i) GROUP BY n.cluster, i) GROUP BY cluster),\n"
        "c{1} AS (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{0} c LEFT JOIN m{0} m USING (cluster))"
    )
    steps = []
    for at in range(ROUNDS + 1):
        steps.append(near.format(at))
        if at < ROUNDS:
            steps.append(move.format(at, at + 1, DIMS))
    return ",\n".join(steps)


ORACLE = f"""
WITH v AS (
  SELECT row_number() OVER () AS row_id, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS x FROM embeddings
  WHERE len(embedding) = {DIMS} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x::DOUBLE)]) = {DIMS}),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1)::INTEGER AS cluster, x FROM v ORDER BY sha256('{SEED}:' || vec_id), x LIMIT {CLUSTERS}),
{_rounds()},
sums AS (SELECT cluster, sum(d)::BIGINT AS cluster_inertia FROM n{ROUNDS} GROUP BY cluster)
SELECT v.vec_id, n.cluster, n.d AS distance, s.cluster_inertia, (SELECT sum(d)::BIGINT FROM n{ROUNDS}) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN n{ROUNDS} n USING (row_id) JOIN sums s USING (cluster) JOIN c{ROUNDS} c USING (cluster)
"""
