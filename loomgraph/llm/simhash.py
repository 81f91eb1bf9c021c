"""SimHash near-duplicates: word-shingle fingerprints, tiled exact comparison, connected components.

Fingerprints are made batch by batch in Python (the words are cut, hashed and voted on with bytes methods,
xxhash and numpy). Equal fingerprints are one node from there on, so a group of exact copies costs one row.
The nodes are dealt into tiles by the population count of the fingerprint (and, if asked, by a band of the
number of shingles). Tiles whose counts differ by more than the radius are never paired; every other pair of
tiles is compared whole with exclusive-or and bit counts, so no link is lost. A pair of tiles answers with a
spanning forest of its links, not with all of them: at most one row per node, however large a group is.
The components come from minimum labels with pointer jumping over those rows, staged each round.

Where links must be true (keep_one), those components only say which documents to compare: within each, links are
verified by the exact Jaccard similarity of the shingle sets, and the components are formed anew from verified ones.

Comparing all pairs of tiles is quadratic in the number of distinct fingerprints: about 2 ns a pair on one
core, less by what the skipped tiles save.

Defined cases: null, empty and wordless texts have fingerprint zero and link like any other; rows that share
a doc_id each get their fingerprint and component; a null doc_id gets a row too but never names a component
(a component of null ids alone has a null name); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, join_on_hot_key, python_workers, stage

SEED, WIDTH, RADIUS = 42, 3, 3
#: Nodes in a tile, and tiles; past both, tiles grow. Two tiles are compared in slices of SLICE by STRIDE.
TILE, MOST_TILES, SLICE, STRIDE = 65_536, 2048, 256, 4096
#: Shingle hashes whose bits are counted at once: 64 bytes each.
VOTES = 1 << 17
#: A component is verified in blocks of about MEMBERS sets, in at most MOST_BLOCKS unless one would be over BLOCK_BYTES.
MEMBERS, MOST_BLOCKS, BLOCK_BYTES = 128, 64, 8 << 20
#: Edges that a task turns into stars.
FOREST_ROWS = 200_000
#: Odd multipliers that turn a hash into the further words of a fingerprint longer than 64 bits.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of each run of `width` words, joined by spaces; of all words if there are fewer."""
    words = text.lower().split()  # of bytes: A-Z, and white space 09-0D and 20
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -width].tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]


def _words_of(hashes: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The hash, then further 64-bit words mixed from it."""
    yield hashes
    for k in range(n - 1):
        x = hashes * np.uint64(MIX[k % 3]) + np.uint64(k + 1)
        x ^= x >> np.uint64(31)
        x *= np.uint64(MIX[(k + 1) % 3])
        yield x ^ (x >> np.uint64(29))


def fingerprints(hashes: list[list[int]], n_words: int = 1) -> np.ndarray:
    """A row of n_words uint64 per list: each bit is set if it is in over half the hashes."""
    lengths = np.fromiter(map(len, hashes), np.int64, len(hashes))
    votes = np.zeros((len(hashes), 64 * n_words), np.int64)
    flat = np.fromiter((h for one in hashes for h in one), np.uint64, int(lengths.sum()))
    owner = np.repeat(np.arange(len(hashes)), lengths)
    for at in range(0, len(flat), VOTES):
        part, whose = flat[at : at + VOTES], owner[at : at + VOTES]
        first = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]])
        for k, word in enumerate(_words_of(part, n_words)):
            bits = np.unpackbits(word.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            for a, b in zip(first, np.r_[first[1:], len(part)]):
                votes[whose[a], 64 * k : 64 * k + 64] += bits[a:b].sum(axis=0, dtype=np.int32)
    won = votes * 2 > lengths[:, None]
    return np.packbits(won, axis=1).view(">u8").astype(np.uint64).reshape(len(hashes), n_words)


def with_fingerprints(docs: DataFrame, *, width: int = WIDTH, n_words: int = 1, sizes: bool = False) -> DataFrame:
    """doc_id, text_hash (XXH64 of the text) and node per row: the fingerprint's n_words 64-bit words, big-endian.

    With `sizes`, repeated shingles count once, and their number and a hash of their set follow in the node, so that
    only texts with equal sets share one.
    """
    kind = docs.schema["doc_id"].dataType
    python_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for at in range(0, batch.num_rows, 512):
                hashes = [shingle_hashes(t.as_py() or b"", width) for t in texts[at : at + 512]]
                if sizes:
                    hashes = [sorted(set(h)) for h in hashes]
                rows = fingerprints(hashes, n_words)
                if sizes:
                    marks = [xxhash.xxh64_intdigest(np.array(h, ">u8").tobytes(), SEED) for h in hashes]
                    rows = np.column_stack([rows, np.fromiter(map(len, hashes), np.uint64, len(hashes)), np.array(marks, np.uint64)])
                flat, size = rows.astype(">u8").tobytes(), 8 * rows.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[at : at + 512], batch.column("text_hash")[at : at + 512], pa.array([flat[i : i + size] for i in range(0, len(flat), size)], pa.binary())],
                    names=["doc_id", "text_hash", "node"],
                )

    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return hashed.mapInArrow(run, f"doc_id {kind.simpleString()}, text_hash long, node binary")


def _forest(a: np.ndarray, b: np.ndarray, n_words: int, radius: int, same: bool) -> np.ndarray:
    """The least index of each row's component among the links between rows of a and b; b's indexes follow a's.

    Links are merged row by row, so a group of many near copies costs no more than its rows by its size in numpy.
    """
    shift = 0 if same else len(a)
    label = np.arange(len(a) if same else len(a) + len(b))
    for at in range(0, len(a), SLICE):
        part = a[at : at + SLICE]
        for to in range(at - at % STRIDE if same else 0, len(b), STRIDE):
            other = b[to : to + STRIDE]
            near = np.bitwise_count(part[:, 0, None] ^ other[None, :, 0])
            for k in range(1, n_words):
                near = np.add(near, np.bitwise_count(part[:, k, None] ^ other[None, :, k]), dtype=np.uint16)
            hit = near <= radius
            if not hit.any():
                continue
            if part.shape[1] > n_words:
                x, y = part[:, None, n_words], other[None, :, n_words]
                hit &= 5 * np.minimum(x, y) >= 4 * np.maximum(x, y)
            for i in np.flatnonzero(hit.any(axis=1)):
                found = np.unique(np.append(label[np.flatnonzero(hit[i]) + to + shift], label[at + i]))
                if len(found) > 1:
                    label[np.isin(label, found)] = found[0]
    return label


def tiles_of(counts: dict[tuple[int, int], int], most: int) -> dict[tuple[int, int], range]:
    """The tiles of each cell (band, ones): several for a large one, one shared by small neighbours of a band."""
    names, n, room, last = {}, 0, 0, None
    for key in sorted(counts):
        if key[0] != last or counts[key] > room:
            k = -(-counts[key] // most)
            names[key], n = range(n, n + k), n + k
            room, last = (most - counts[key] if k == 1 else 0), key[0]
        else:
            names[key] = range(n - 1, n)
            room -= counts[key]
    return names


def tile_pairs(names: dict[tuple[int, int], range], radius: int) -> list[tuple[int, int]]:
    """Tiles that may hold a link: in the same or neighbouring bands, with population counts within the radius."""
    cells: dict[int, list[tuple[int, int]]] = {}
    for key, tiles in names.items():
        for t in tiles:
            cells.setdefault(t, []).append(key)
    box = {t: (ks[0][0], min(o for _, o in ks), max(o for _, o in ks)) for t, ks in cells.items()}
    return [(s, t) for s, (b, low, high) in box.items() for t, (c, low_t, high_t) in box.items() if s <= t and abs(b - c) <= 1 and low_t - high <= radius and low - high_t <= radius]


def links(nodes: DataFrame, *, radius: int = RADIUS, n_words: int = 1, sizes: bool = False) -> DataFrame:
    """Rows (u, v) over `nodes` (staged, distinct) whose components are those of all links within the radius.

    With `sizes`, a link also asks that the smaller number of shingles is at least 4/5 of the larger: tiles are
    dealt by bands of that number a factor 5/4 wide, of which only the same and the next can meet.
    """
    spark = nodes.sparkSession
    number = lambda at, n: F.conv(F.hex(F.substring("node", at, n)), 16, 10).cast("long")
    ones = sum((F.bit_count(number(1 + 4 * k, 4)) for k in range(2 * n_words)), F.lit(0)).cast("int")
    size = number(8 * n_words + 1, 8) if sizes else F.lit(1)
    band = F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(math.log(1.25))).cast("int")
    keyed = nodes.select("node", ones.alias("ones"), band.alias("band"))
    # at most 64 * n_words + 1 population counts by some 200 bands come to the driver, however many nodes there are
    counts = {(r.band, r.ones): r["count"] for r in keyed.groupBy("band", "ones").count().collect()}
    total = sum(counts.values())
    names = tiles_of(counts, max(256, min(TILE, total // 24), total // MOST_TILES))
    cells = spark.createDataFrame([(b, o, t.start, len(t)) for (b, o), t in names.items()], "band int, ones int, first int, tiles int")
    tile = F.col("first") + F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    packed = stage(keyed.join(F.broadcast(cells), ["band", "ones"]).groupBy(tile.alias("tile")).agg(F.collect_list("node").alias("nodes")), rows=total)
    meet = tile_pairs(names, radius)
    pairs = spark.createDataFrame(meet, "s int, t int")
    both = pairs.join(packed.toDF("s", "a"), "s").join(packed.toDF("t", "b"), "t")
    # by the work, not by the bytes: a pair is little to send and much to compare
    both = both.repartition(max(1, min(len(meet), 4 * spark.sparkContext.defaultParallelism)), "s", "t")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column("s")[i].as_py() == batch.column("t")[i].as_py()
                of_a, of_b = batch.column("a")[i].as_py(), batch.column("b")[i].as_py()
                a, b = (np.frombuffer(b"".join(x), ">u8").astype(np.uint64).reshape(len(x), -1) for x in (of_a, of_b))
                every = of_a if same else of_a + of_b
                label = _forest(a, b, n_words, radius, same)
                found = [(every[label[x]], every[x]) for x in np.flatnonzero(label != np.arange(len(label)))]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["u", "v"])

    return both.mapInArrow(compare, "u binary, v binary")


def _verified(marks: np.ndarray, sets: list[np.ndarray], cut: int, n_words: int, radius: int) -> np.ndarray:
    """The least index of each row's component among the links within the radius whose sets have a Jaccard similarity
    of 0.8 or more: links between the first `cut` rows and the others, or among all if cut is their number.

    Rows that are already in one component aren't compared, so a group of copies costs about a comparison a row.
    """
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(flat, np.cumsum(n)[:-1])
    label, has = np.arange(len(sets)), np.zeros(len(flat), bool)
    for i in range(cut):
        to = i + 1 if cut == len(sets) else cut
        near = np.bitwise_count(marks[to:, :n_words] ^ marks[i, :n_words]).sum(axis=1, dtype=np.int64) <= radius
        hit = np.flatnonzero(near & (5 * np.minimum(n[to:], n[i]) >= 4 * np.maximum(n[to:], n[i]))) + to
        hit = hit[label[hit] != label[i]]
        if not len(hit):
            continue
        has[ids[i]] = True
        first = hit[np.unique(label[hit], return_index=True)[1]]  # one of each component, then what that leaves open
        for rest in (False, True):
            others = np.setdiff1d(hit[label[hit] != label[i]], first) if rest else first
            shared = np.fromiter((np.count_nonzero(has[ids[j]]) for j in others), np.int64, len(others))
            true = others[5 * shared >= 4 * (n[others] + n[i] - shared)]
            found = np.unique(np.append(label[true], label[i]))
            if len(found) > 1:
                label[np.isin(label, found)] = found[0]
        has[ids[i]] = False
    return label


def verified_links(docs: DataFrame, nodes: DataFrame, roots: DataFrame, *, width: int, n_words: int, radius: int) -> DataFrame:
    """Rows (u, v) over the nodes of `roots` whose components are those of all their verified links.

    `nodes` names a row of docs that has the node's text. A component's sets meet in one task, those of a large one
    block by block.
    """
    picks = nodes.join(roots, "node").select("node", "root", F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = texts.join(picks.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))).select("root", "node", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.array(shingle_hashes(t.as_py() or b"", width), np.uint64)).tobytes() for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("node"), pa.array(sets, pa.binary())], names=["root", "node", "set"])

    sets = stage(texts.mapInArrow(cut, "root binary, node binary, set binary").groupBy("node").agg(F.first("root").alias("root"), F.first("set").alias("set")))
    size, n = F.sum(F.octet_length("set")), F.count(F.lit(1))
    blocks = F.greatest(F.least(F.ceil(n / F.lit(MEMBERS)), F.lit(MOST_BLOCKS)), F.ceil(size / F.lit(BLOCK_BYTES))).cast("int")
    dealt = stage(sets.groupBy("root").agg(n.alias("members"), blocks.alias("blocks")))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    packed = stage(join_on_hot_key(sets, dealt, "root", "members", short=False).groupBy("root", block, "blocks").agg(F.collect_list(F.struct("node", "set")).alias("a")))
    pairs = dealt.where("blocks > 1").select("root", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("s"))
    pairs = pairs.select("root", "s", F.explode(F.sequence("s", F.col("blocks") - 1)).alias("t"))
    several = pairs.join(packed.select("root", F.col("block").alias("s"), "a"), ["root", "s"]).join(packed.select("root", F.col("block").alias("t"), F.col("a").alias("b")), ["root", "t"])
    several = several.select("a", F.when(F.col("s") != F.col("t"), F.col("b")).alias("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = [x.values for x in (batch.column("a")[i], batch.column("b")[i]) if x.is_valid]
                names = [m for x in sides for m in x.field("node").to_pylist()]
                held = [np.frombuffer(m, np.uint64) for x in sides for m in x.field("set").to_pylist()]
                marks = np.frombuffer(b"".join(names), ">u8").astype(np.uint64).reshape(len(names), -1)
                label = _verified(marks, held, len(sides[0]), n_words, radius)
                found = [(names[label[x]], names[x]) for x in np.flatnonzero(label != np.arange(len(label)))]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["u", "v"])

    alone = packed.where("blocks = 1").select("a", F.lit(None).cast(packed.schema["a"].dataType).alias("b"))
    return alone.unionByName(several).mapInArrow(compare, "u binary, v binary")


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (u, v) of a task as stars: the least node of each component with each other node of it."""
    parent: dict = {}
    kind = pa.binary()

    def find(x: object) -> object:
        root = x
        while (up := parent.get(root)) is not None:
            root = up
        while x != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        kind = batch.column("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            low, high = sorted((find(u), find(v)))
            if low != high:
                parent[high] = low
    nodes = list(parent)
    for at in range(0, len(nodes), 4096):
        part = nodes[at : at + 4096]
        yield pa.RecordBatch.from_arrays([pa.array([find(x) for x in part], kind), pa.array(part, kind)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for nodes that have an edge. `edges` is staged (u, v).

    First each task turns some FOREST_ROWS edges into stars, so that few edges and short ways are left. Then, each round, a
    node takes the least label of itself and its neighbours, then its label's label. Nodes with many neighbours, and
    labels with many nodes, are joined by broadcast: there are few of them, by their share of rows.
    """
    python_workers(edges.sparkSession)
    found = edges.count()
    # dealt round robin, so that no node's edges gather in a task
    edges = stage(edges.repartition(max(1, -(-found // FOREST_ROWS))).mapInArrow(local_forest, edges.schema), rows=found)
    rows = 2 * edges.count()
    both = stage(edges.union(edges.select("v", "u")).toDF("u", "v").where("u <> v").distinct(), rows=rows)
    labels = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c"), F.count(F.lit(1)).alias("links")), rows=rows)
    while True:
        heard = join_on_hot_key(both, labels.toDF("v", "d", "links"), "v", "links").groupBy("u").agg(F.min("d").alias("d"))
        lower = stage(labels.join(heard, "u").select("u", F.least("c", "d").alias("c"), F.col("c").alias("was"), "links"), rows=rows)
        named = lower.groupBy("c").agg(F.count(F.lit(1)).alias("members")).join(lower.select(F.col("u").alias("c"), F.col("c").alias("cc")), "c")
        jumped = join_on_hot_key(lower, stage(named, rows=rows), "c", "members")
        new = stage(jumped.select("u", F.col("cc").alias("c"), "links", (F.col("cc") != F.col("was")).alias("moved")), rows=rows)
        if new.where("moved").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("c").alias("root"))
        labels = new.select("u", "c", "links")


def near_duplicates(docs: DataFrame, *, width: int = WIDTH, radius: int = RADIUS, n_words: int = 1, verify: bool = False) -> DataFrame:
    """Per row: doc_id, text_hash, fingerprint (hex), component_id (the smallest doc_id of its component) and
    component_hash (the least text_hash of the rows with that id there). With `verify`, only links whose sets of
    shingles have a Jaccard similarity of 0.8 or more count.
    """
    marked = stage(with_fingerprints(docs, width=width, n_words=n_words, sizes=verify))
    nodes = stage(marked.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("copies")), rows=marked.count())
    n = nodes.count()
    roots = components(stage(links(nodes.select("node"), radius=radius, n_words=n_words, sizes=verify)))
    if verify:
        roots = components(stage(verified_links(docs, nodes, roots, width=width, n_words=n_words, radius=radius)))
    named = stage(nodes.join(roots, "node", "left").select("node", "first", "copies", F.coalesce("root", "node").alias("root")), rows=n)
    names = stage(named.groupBy("root").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("members")), rows=n)
    table = stage(join_on_hot_key(named.drop("first"), names, "root", "members").select("node", "copies", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("component_hash")), rows=n)
    joined = join_on_hot_key(marked, table, "node", "copies")
    return joined.select("doc_id", "text_hash", F.lower(F.hex(F.substring("node", 1, 8 * n_words))).alias("fingerprint"), "component_id", "component_hash")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, *, width: int = 5, n_words: int = 4, radius: int = 72) -> DataFrame:
    """One document of each group, that with the smallest doc_id, with all its columns.

    A group is a component of links between documents whose sets of five-word shingles have a Jaccard similarity of
    0.8 or more; that is verified exactly, by the 64-bit hashes of the shingles. The search for links is by 256-bit
    fingerprints of the sets, which is likely but not certain to find one: sets of equal size at exactly 0.8 differ by
    39 bits, give or take 6, sets of four and five shingles by 48, and the radius is 72. Unrelated documents differ by
    128 bits, give or take 8.
    """
    marked = stage(near_duplicates(docs, width=width, radius=radius, n_words=n_words, verify=True).select("doc_id", "text_hash", "component_id", "component_hash"))
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("text_hash").eqNullSafe(F.col("component_hash"))
    gone = stage(marked.where(~first).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    # What goes grows with the corpus, so it is never broadcast; hashing it spares the texts a sort.
    own = free_name(docs, "_text")
    hashed = docs.withColumn(own, F.xxhash64("text"))
    kept = hashed.join(gone.hint("shuffle_hash"), hashed["doc_id"].eqNullSafe(gone["_id"]) & (hashed[own] == gone["_hash"]), "left_anti")
    if marked.where(first).groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        return kept.drop(own)
    return kept.dropDuplicates(["doc_id", own]).drop(own)  # the same row, more than once
