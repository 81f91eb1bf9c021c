"""Token ids in a content-addressed store: chunks cut by a rolling hash, recipes, Merkle manifests.

A store is a folder of Parquet files:

* `chunks/` has each distinct chunk once: its SHA-256 and its ids, little-endian, two bytes each (`kind` says four for
  larger vocabularies; one that doesn't fit raises an error);
* `recipes/` has the documents in ascending order of doc_id, over numbered parts: each one's place in its part, ids
  before it there, number of ids, and its chunks' digests and lengths; at a part's end, a row with the part's totals
  and its Merkle root, whose leaves are the documents' roots, whose leaves are their chunks' digests.

A chunk ends where the rolling hash of the last WINDOW ids has its highest bits zero, after MIN ids at least and MAX
at most; as MIN exceeds WINDOW, a document's chunks don't depend on what stands before it, so copies and long shared
passages meet in the same chunks. White space always separates tokens of this tokenizer, so the ids of a text
are those of its words, and each distinct word of a batch is looked at once.

Reading verifies: each chunk's bytes against its digest, each part's roots against its totals row, and each document's
length against its recipe. `summary` then gets a document's CRC-32 from those of its chunks by the linearity of CRC,
so that chunks are read once and not sent to each document; `documents` puts the ids themselves together.

Defined cases: a null or empty text is the end id alone; rows that share a doc_id stand in order of their digests; null
doc_ids come first; very long texts are read whole; further columns take no part; an empty table gives no rows. A chunk that many documents share (empty texts, say) is written
once a task and then once; its references are joined by broadcast.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_on_hot_key, python_workers, shared_dir, stage

END = 1
WINDOW, MIN, MAX, BITS = 16, 64, 2048, 9
#: Pieces that are encoded as one text, and pieces that a worker remembers.
TOGETHER, REMEMBERED = 1024, 500_000
#: Bytes and documents that are looked at together, and documents that are sent together.
GROUP, DOCS_AT_ONCE, SENT = 12 << 20, 8192, 1024
#: Characters from U+0240 on; before, nothing combines. And white space that isn't ASCII, and the one letter with two in lower case.
BEYOND_LATIN = r"[^\x00-\x{84}\x{86}-\x{9F}\x{A1}-\x{12F}\x{131}-\x{23F}]"
GEAR = np.random.default_rng(20).integers(0, 1 << 64, 1 << 16, np.uint64)
POLYNOMIAL = 0xEDB88320


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts. Arrow tells a batch's words apart, and cuts each distinct one into the pieces that the tokenizer
    encodes by themselves.

    New pieces are encoded together: each ends with a token that closes a word, which tells them apart again; those met
    more than once lately are remembered. Texts with characters beyond Latin or parts of special tokens
    are encoded whole, as are all by a tokenizer of another kind.
    """

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer, self._kind = Tokenizer.from_file(path), kind
        if self._tokenizer.get_vocab_size() > 1 << 8 * np.dtype(kind).itemsize:
            raise ValueError(f"{self._tokenizer.get_vocab_size()} ids don't fit into {kind}")
        self._forget()
        made = json.loads(self._tokenizer.to_str())
        steps = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])]
        splits = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        suffix = made["model"].get("end_of_word_suffix")
        self._cut = None
        if steps == ["NFC", "Replace", "Lowercase"] and splits[0].get("type") == "Split" and splits[0].get("invert") and suffix:
            self._cut = f"({splits[0]['pattern']['Regex']})"
            self._closes = np.zeros(self._tokenizer.get_vocab_size(), bool)
            self._closes[[i for t, i in self._tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self._kind) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, one after the other, and how many each has (none, if it is empty)."""
        starts = np.r_[0 : len(pieces) : TOGETHER, len(pieces)]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pieces), " ")
        flat, lengths = [np.empty(0, self._kind)], [np.empty(0, np.int64)]
        for a, b, ids in zip(starts, starts[1:], self._ids(joined.to_pylist())):
            said = np.asarray(pc.binary_length(pieces[a:b])) > 0
            ends = np.flatnonzero(self._closes[ids]) + 1
            size = np.zeros(b - a, np.int64)
            if len(ends) == said.sum() and (not len(ids) or len(ends) and ends[-1] == len(ids)):
                size[said] = np.diff(ends, prepend=0)
            else:
                each = self._ids(pieces[a:b].to_pylist())
                ids, size = np.concatenate(each), np.fromiter(map(len, each), np.int64, b - a)
            flat.append(ids)
            lengths.append(size)
        return np.concatenate(flat), np.concatenate(lengths)

    def _ids_of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same, with those that have been met lately taken from what is remembered."""
        at = pc.index_in(pieces, self._known)
        fresh = np.flatnonzero(np.asarray(at.is_null()))
        new = pieces.take(pa.array(fresh))
        ids, sizes = self._ids_of_new(new)
        place = np.array(at.fill_null(0))
        place[fresh] = len(self._known) + np.arange(len(fresh))
        self._known = pa.concat_arrays([self._known, new])
        self._flat, self._sizes = np.r_[self._flat, ids], np.r_[self._sizes, sizes]
        self._used = np.r_[self._used, np.zeros(len(fresh), np.int64)]
        self._used[place] += 1
        size, shift = self._sizes[place], (np.cumsum(self._sizes) - self._sizes)[place]
        out = self._flat[np.repeat(shift - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        if len(self._known) > REMEMBERED:  # what came once since the last time goes
            keep = self._used > 1
            self._flat, self._known = self._flat[np.repeat(keep, self._sizes)], self._known.filter(pa.array(keep))
            self._sizes, self._used = self._sizes[keep], np.zeros(int(keep.sum()), np.int64)
            if len(self._known) > REMEMBERED // 2:
                self._forget()
        return out, size

    def _forget(self) -> None:
        self._known, self._flat = pa.array([], pa.string()), np.empty(0, self._kind)
        self._sizes, self._used = np.empty(0, np.int64), np.empty(0, np.int64)

    def _spaced(self, words: pa.Array) -> pa.Array:
        """Words with spaces between their pieces: letters alone are one, and most others are letters and a full stop or comma."""
        most, last = pc.utf8_slice_codeunits(words, 0, -1), pc.utf8_slice_codeunits(words, -1)
        closed = pc.and_(pc.utf8_is_alpha(most), pc.is_in(last, pa.array([",", "."])))
        out = pc.if_else(closed, pc.binary_join_element_wise(most, last, " "), words)
        rest = pc.invert(pc.or_(closed, pc.utf8_is_alpha(words)))
        return pc.replace_with_mask(out, rest, pc.replace_substring_regex(words.filter(rest), self._cut, r"\1 "))

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of plain texts, without ends, and how many each has."""
        said, words = _told_apart(pc.ascii_lower(texts))
        cut, pieces = _told_apart(self._spaced(pc.utf8_lower(words)))
        return _put_together(*said, *_put_together(*cut, *self._ids_of_pieces(pieces)))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each closed by the end, and how many each has."""
        texts = texts.fill_null("")
        other = np.ones(len(texts), bool)
        if self._cut:
            other = np.array(pc.match_substring(texts, "<|"))
            wide = np.flatnonzero(~np.asarray(pc.string_is_ascii(texts)))
            other[wide] |= np.asarray(pc.match_substring_regex(texts.take(pa.array(wide)), BEYOND_LATIN))
        flat, lengths = self._plain(texts.filter(pa.array(~other))) if not other.all() else (np.empty(0, self._kind), np.empty(0, np.int64))
        ends = np.cumsum(lengths)
        if other.any():
            parts, own = np.empty(len(texts), object), iter(self._ids(texts.filter(pa.array(other)).to_pylist()))
            for i, (a, b) in zip(np.flatnonzero(~other), zip(ends - lengths, ends)):
                parts[i] = flat[a:b]
            for i in np.flatnonzero(other):
                parts[i] = next(own)
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            flat, ends = np.concatenate([np.empty(0, self._kind), *parts]), np.cumsum(lengths)
        return np.insert(flat, ends, END), lengths + 1


def _told_apart(texts: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], pa.Array]:
    """(Where each text's words begin and the last ends, each word's number), and the distinct words."""
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    offsets = np.asarray(split.offsets)
    return (offsets - offsets[0], np.asarray(coded.indices)), coded.dictionary


def _put_together(offsets: np.ndarray, code: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts, one after the other, and how many each has, from those of their words by number."""
    size = lengths[code]
    shift = (np.cumsum(lengths) - lengths)[code] - (np.cumsum(size) - size)
    return flat[np.repeat(shift, size) + np.arange(size.sum())], np.diff(np.r_[0, np.cumsum(size)][offsets])


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One per worker, kept from task to task."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


def cuts(ids: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
    """Where the chunks of each document end, counted from the first id of all."""
    rolled, step = GEAR[ids & 0xFFFF], 1
    while step < WINDOW:  # sums over 2, 4, 8, 16 ids, each id a bit further up
        rolled = np.r_[rolled[:step], rolled[step:] + (rolled[:-step] << np.uint64(step))]
        step *= 2
    natural = np.flatnonzero(rolled >> np.uint64(64 - BITS) == 0) + 1
    ends = np.cumsum(lengths)
    first, last = np.searchsorted(natural, ends - lengths), np.searchsorted(natural, ends)
    out = []
    for begin, end, a, b in zip((ends - lengths).tolist(), ends.tolist(), first, last):
        found, at = [], begin
        for c in natural[a:b].tolist() if end - begin > MIN else ():
            while c - at > MAX:
                at += MAX
                found.append(at)
            if c - at >= MIN:
                found.append(c)
                at = c
        while end - at > MAX:
            at += MAX
            found.append(at)
        out.append([*found, end] if at < end else found)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary hash tree; an odd last node moves up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about GROUP bytes: the more documents at once, the fewer of their distinct words are new."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GROUP:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def encoded(docs: DataFrame, path: Callable[[], str], kind: str) -> DataFrame:
    """Per document: doc_id, n, digests and sizes of its chunks, and `fresh`, the chunks that its task hadn't seen."""
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(path(), kind), set()
        width = np.dtype(kind).itemsize
        for batch in _together(batches):
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                ids, lengths = encode.texts(part.column("text"))
                flat = ids.tobytes()
                digests, sizes, offsets, names, chunks, begin = [], [], [0], [], [], 0
                for ends in cuts(ids, lengths):
                    own = []
                    for end in ends:
                        piece = flat[begin * width : end * width]
                        own.append(hashlib.sha256(piece).digest())
                        sizes.append(end - begin)
                        begin = end
                        if own[-1] not in seen:
                            seen.add(own[-1])
                            names.append(own[-1])
                            chunks.append(piece)
                    digests.append(b"".join(own))
                    offsets.append(len(names))
                flat_sizes, at_size, split = np.array(sizes, np.uint32), 0, []
                for d in digests:
                    split.append(flat_sizes[at_size : at_size + len(d) // 32].tobytes())
                    at_size += len(d) // 32
                fresh = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(chunks, pa.binary())], ["digest", "ids"]))
                out = pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(lengths), pa.array(digests, pa.binary()), pa.array(split, pa.binary()), fresh], names=["doc_id", "n", "digests", "sizes", "fresh"]
                )
                yield from (out.slice(i, SENT) for i in range(0, out.num_rows, SENT))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_kind}, n long, digests binary, sizes binary, fresh array<struct<digest: binary, ids: binary>>")


def _unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, d in enumerate(batch.column("digest").to_pylist()):
            if d not in seen:
                seen.add(d)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int32()))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a part in order, then its totals: number of documents in `place`, of ids in `n`, root in `digests`."""
    from pyspark import TaskContext

    part, place, before, roots = TaskContext.get().partitionId(), 0, 0, []
    names = ["part", "place", "before", "doc_id", "n", "digests", "sizes", "total"]
    kind = None
    for batch in batches:
        n = np.asarray(batch.column("n"), np.int64)
        rows = len(n)
        if not rows:
            continue
        kind = batch.column("doc_id").type
        roots += [merkle([d[i : i + 32] for i in range(0, len(d), 32)]) for d in batch.column("digests").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(rows, part, np.int32)),
                pa.array(np.arange(place, place + rows)),
                pa.array(before + np.cumsum(n) - n),
                *(batch.column(c) for c in ("doc_id", "n", "digests", "sizes")),
                pa.array(np.zeros(rows, bool)),
            ],
            names=names,
        )
        place, before = place + rows, before + int(n.sum())
    if place:
        values = (pa.array([part], pa.int32()), pa.array([place]), pa.array([0]), pa.array([None], kind), pa.array([before]), pa.array([merkle(roots)], pa.binary()), pa.array([b""], pa.binary()), pa.array([True]))
        yield pa.RecordBatch.from_arrays(list(values), names=names)


def write(docs: DataFrame, root: str, *, path: Callable[[], str] = tokenizer_path, kind: str = "<u2") -> None:
    """Encode all documents into a new store at `root`."""
    python_workers(docs.sparkSession)
    once = stage(encoded(docs, path, kind))
    once.select(F.inline("fresh")).repartition("digest").mapInArrow(_unique, "digest binary, ids binary").write.option("compression", "zstd").parquet(f"{root}/chunks")
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").asc_nulls_first(), F.col("digests")]
    recipes = once.select("doc_id", "n", "digests", "sizes").repartitionByRange(*order).sortWithinPartitions(*order)
    recipes.mapInArrow(_numbered, f"part int, place long, before long, doc_id {id_kind}, n long, digests binary, sizes binary, total boolean").write.parquet(f"{root}/recipes")


# Reading


def shift_table(bits: int) -> np.ndarray:
    """For k below `bits`, x to the power 8 * 2^k modulo the polynomial, bits reversed as CRC-32 has them."""
    out, one = [], np.array([1 << 23], np.uint64)  # x^8
    for _ in range(bits):
        out.append(one[0])
        one = times(one, one)
    return np.array(out, np.uint64)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo that of CRC-32; bit 31 is x^0."""
    b, out = b.copy(), np.zeros(len(b), np.uint64)
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(k)) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), (b >> np.uint64(1)) ^ np.uint64(POLYNOMIAL), b >> np.uint64(1))
    return out


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a piece's CRC adds to the whole's, if so many bytes follow it."""
    out, n = crc.astype(np.uint64), n_bytes.astype(np.uint64)
    bits = int(n.max()).bit_length() if len(n) else 0
    for k, power in enumerate(shift_table(bits)):
        on = np.flatnonzero((n >> np.uint64(k)) & np.uint64(1))
        out[on] = times(np.full(len(on), power, np.uint64), out[on])
    return out


def _checked(kind: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, chunks = batch.column("digest").to_pylist(), batch.column("ids").to_pylist()
            for d, c in zip(digests, chunks):
                if hashlib.sha256(c).digest() != d:
                    raise ValueError(f"chunk {d.hex()} isn't what its name says")
            ids = [np.frombuffer(c, kind) for c in chunks]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())], names=["digest", "chunk_n", "crc"]
            )

    return run


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document and chunk: part, place, step, digest, chunk_size, ids that follow."""
    for batch in batches:
        digests, sizes = batch.column("digests").to_pylist(), [np.frombuffer(s, np.uint32).astype(np.int64) for s in batch.column("sizes").to_pylist()]
        steps = np.fromiter(map(len, sizes), np.int64, len(sizes))
        flat = np.concatenate([np.empty(0, np.int64), *sizes])
        ends = np.concatenate([np.empty(0, np.int64), *(s.sum() - np.cumsum(s) for s in sizes)])
        first = np.repeat(np.cumsum(steps) - steps, steps)
        again = lambda c: pa.array(np.repeat(np.asarray(batch.column(c)), steps))
        yield pa.RecordBatch.from_arrays(
            [again("part"), again("place"), pa.array(np.arange(len(flat)) - first), pa.array([d[i : i + 32] for d in digests for i in range(0, len(d), 32)], pa.binary()), pa.array(flat), pa.array(ends)],
            names=["part", "place", "step", "digest", "size", "after"],
        )


def _verified_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a part's file, in order, against its totals."""
    roots, n, part = [], 0, None
    for batch in batches:
        for p, count, d, total in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "digests", "total"))):
            if p != part:
                roots, n, part = [], 0, p
            if total:
                if merkle(roots) != d or n != count:
                    raise ValueError(f"part {p} of the recipes isn't what its root says")
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([count])], names=["part", "n"])
            else:
                roots.append(merkle([d[i : i + 32] for i in range(0, len(d), 32)]))
                n += count


def references(spark: SparkSession, root: str) -> DataFrame:
    python_workers(spark)
    recipes = spark.read.parquet(f"{root}/recipes").where(~F.col("total")).select("part", "place", "digests", "sizes")
    return recipes.mapInArrow(_references, "part int, place long, step long, digest binary, size long, after long")


def verify(spark: SparkSession, root: str) -> DataFrame:
    """The parts whose Merkle roots hold: part and its number of ids; an error if one doesn't. Each part's file is read whole, by one task."""
    python_workers(spark)
    rows = spark.read.parquet(f"{root}/recipes").select("part", "place", "n", "digests", "total").repartition("part").sortWithinPartitions("part", "total", "place")
    return rows.select("part", "n", "digests", "total").mapInArrow(_verified_parts, "part int, n long")


def summary(spark: SparkSession, root: str, *, kind: str = "<u2") -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    recipes = spark.read.parquet(f"{root}/recipes")
    parts = stage(verify(spark, root))  # a row a part
    offsets = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    chunks = spark.read.parquet(f"{root}/chunks").mapInArrow(_checked(kind), "digest binary, chunk_n long, crc long")
    refs = stage(references(spark, root))
    counted = refs.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    known = stage(chunks.join(counted, "digest"))  # reads and checks all chunks, so by as many tasks as they need

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, after = (np.asarray(batch.column(c), np.int64) for c in ("crc", "after"))
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("place"), batch.column("size"), pa.array(shifted(crc, 4 * after).astype(np.int64))], names=["part", "place", "size", "crc"])

    pieces = join_on_hot_key(refs, known, "digest", "copies").where(F.col("size") == F.col("chunk_n")).select("part", "place", "size", "crc", "after")
    sums = pieces.mapInArrow(move, "part int, place long, size long, crc long").groupBy("part", "place").agg(F.sum("size").alias("found"), F.bit_xor("crc").alias("crc"))
    rows = recipes.where(~F.col("total")).select("part", "place", "before", "doc_id", "n").join(sums, ["part", "place"], "left").join(F.broadcast(offsets), "part")
    whole = F.col("found").eqNullSafe(F.col("n"))
    crc = F.when(whole, F.col("crc")).otherwise(F.raise_error(F.lit("a document's chunks are missing")).cast("long"))
    return rows.select("doc_id", (F.col("before") + F.col("offset")).alias("start"), F.col("n").alias("n_tokens"), crc.alias("ids_crc32"))


def documents(spark: SparkSession, root: str) -> DataFrame:
    """Per document: doc_id, part, place and all its ids, as the store's little-endian numbers."""
    chunks = spark.read.parquet(f"{root}/chunks")
    refs = stage(references(spark, root))
    counted = refs.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    pieces = join_on_hot_key(refs, stage(chunks.join(counted, "digest")), "digest", "copies", short=False)
    joined = pieces.groupBy("part", "place").agg(F.array_sort(F.collect_list(F.struct("step", "ids"))).alias("pieces"))
    ids = F.aggregate("pieces", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    recipes = spark.read.parquet(f"{root}/recipes").where(~F.col("total")).select("part", "place", "doc_id")
    return recipes.join(joined, ["part", "place"]).select("doc_id", "part", "place", ids.alias("ids"))


def digest(docs: DataFrame, **options) -> DataFrame:
    root = shared_dir(docs.sparkSession)
    write(docs, root, **options)
    return summary(docs.sparkSession, root)
