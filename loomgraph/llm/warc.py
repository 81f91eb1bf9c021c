"""WARC archives of Zstandard frames: a writer, and a reader that validates what it reads.

An archive begins with a skippable frame (magic number 0x184D2A5D) that holds the dictionary, itself compressed
or not; after it, each record is one frame. The reader loads the dictionary, walks the frames by their headers
and block sizes without decoding, decodes each by itself, and checks the version line, the mandatory headers, the
content length, the record's end, the payload's length and its SHA-1. Broken archives raise an error.

Archives from elsewhere are read through Spark's binaryFile source, so from any store that Spark reads. Those written here
are written and read by the tasks through pyarrow's file systems, in the shared folder, some tens of MB each. A task's row
names its file; these rows are a table that never comes to the driver, and only files in it are read, so what a lost
task left is never read.

Records of equal payloads: that with the largest page_id is a response, the others are revisits without payload that
name it. Digests are grouped and joined by themselves; pages then meet only their own decision, by page_id, so a
group of copies of any size doesn't gather anywhere.

Defined cases: null html is an empty payload; a null page_id is less than any other and never named, and copies
that all have null ids are all responses, as are rows that repeat the largest page_id; a null url gives a record without
target; control characters and spaces in urls are percent-encoded; pages of any length are one record each; further columns take no part; an empty table gives no
archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, join_on_hot_key, python_workers, shared_dir, stage

DICTIONARY_MAGIC, SKIPPABLE, FRAME_MAGIC, RAW_DICTIONARY = 0x184D2A5D, 0x184D2A50, 0xFD2FB528, 0xEC30A437
#: The dictionary is made from at most so many pages, none longer than SAMPLE_BYTES.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 65_536, 32_768
ARCHIVE_BYTES, LEVEL, READ_BYTES = 16 << 20, 3, 64 << 20
DATE = "2024-01-01T00:00:00Z"


class BadArchive(ValueError):
    pass


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Writing


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One uncompressed WARC record. A revisit keeps the payload's digest and length only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    digest = sha1_base32(payload)
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{kind}:{digest}')}>",
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        headers["X-Page-Id"] = str(page_id)
    if url is not None:
        headers["WARC-Target-URI"] = "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)
    if kind == "revisit":
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        headers["WARC-Refers-To"] = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:response:{digest}')}>"
        headers["X-Refers-To-Page-Id"] = str(refers_to)
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary_of(samples: list[bytes]) -> bytes:
    """A trained dictionary; of few samples, their text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    trained = len(content) >= 8 and struct.unpack_from("<I", content)[0] == RAW_DICTIONARY
    return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def decisions(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """The pages that are revisits: _page, _sha1, refers_to."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    hashed = stage(pages.select("page_id", F.sha1(html).alias("_sha1"), F.octet_length(html).alias("size")))
    groups = hashed.where(F.col("size") >= min_bytes).groupBy("_sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies"))
    groups = groups.where((F.col("copies") > 1) & F.col("refers_to").isNotNull())
    both = join_on_hot_key(hashed.select("page_id", "_sha1"), stage(groups, rows=hashed.count()), "_sha1", "copies")
    return both.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("_page"), "_sha1", "refers_to").distinct()


def write(pages: DataFrame, root: str, *, min_bytes: int = 0) -> DataFrame:
    """Archive all pages under root: a staged table of path, records, bytes."""
    python_workers(pages.sparkSession)
    sample = hash_sample(pages.select("page_id", "html").where(F.octet_length("html").between(1, SAMPLE_BYTES)), "page_id", SAMPLE).select("html").collect()
    dictionary = dictionary_of([r["html"].encode() for r in sample])
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    revisits = stage(decisions(pages, min_bytes=min_bytes))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("_hash"))
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_hash") == F.col("_sha1")), "left").select("page_id", "url", "html", F.col("_page").isNotNull() | F.col("refers_to").isNotNull(), "refers_to").toDF("page_id", "url", "html", "revisit", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs
        from pyspark import TaskContext

        files, folder = pyarrow.fs.FileSystem.from_uri(root)
        known = _dictionary(dictionary)
        known.precompute_compress(level=LEVEL)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
        context, head, held, n, size = TaskContext.get(), dictionary_frame(dictionary), [], 0, 0

        def flush() -> pa.RecordBatch:
            name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{n:04d}.warc.zst"
            files.create_dir(folder, recursive=True)
            with files.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(head)
                for frame in held:
                    out.write(frame)
            return pa.RecordBatch.from_arrays([pa.array([f"{root}/{name}"]), pa.array([len(held)], pa.int64()), pa.array([size + len(head)], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for page_id, url, html, revisit, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "revisit", "refers_to"))):
                kind = "revisit" if revisit.as_py() else "response"
                held.append(compressor.compress(record(kind, page_id.as_py(), url.as_py(), html.as_py(), refers_to.as_py())))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, n, size = [], n + 1, 0
        if held:
            yield flush()

    return stage(rows.mapInArrow(run, "path string, records long, bytes long"))


# Reading


class Record(NamedTuple):
    offset: int
    headers: dict[str, str]
    payload: bytes | None


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends, by its header and block sizes."""
    if at + 6 > len(data) or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise BadArchive(f"no frame at {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
    last = False
    while not last:
        if at + 3 > len(data):
            raise BadArchive("a frame is cut off")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
        if kind == 3:
            raise BadArchive("a block of a reserved kind")
        at += 3 + (1 if kind == 1 else size)
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise BadArchive("a frame is cut off")
    return at


def load_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame, if there is one, and where the records begin."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        return None, 0
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise BadArchive("the dictionary is cut off")
    content = bytes(data[8 : 8 + size])
    if len(content) >= 4 and struct.unpack_from("<I", content)[0] == FRAME_MAGIC:
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    return (_dictionary(content) if content else None), 8 + size


def parse(raw: bytes, offset: int) -> Record:
    """One record from its frame's content."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise BadArchive(f"no WARC record at {offset}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadArchive(f"a header without a colon at {offset}")
        headers[name.decode().lower()] = value.strip().decode()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise BadArchive(f"no {name} at {offset}")
    length = headers["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive(f"the content's length isn't {length} at {offset}")
    if headers["warc-type"] != "response":
        return Record(offset, headers, None)
    http, blank, payload = rest[:-4].partition(b"\r\n\r\n")
    if not blank or not http.startswith(b"HTTP/"):
        raise BadArchive(f"no HTTP response at {offset}")
    said = [x.partition(b":")[2].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if said and int(said[0]) != len(payload):
        raise BadArchive(f"the payload's length isn't {said[0].decode()} at {offset}")
    digest = headers.get("warc-payload-digest", "")
    if digest.startswith("sha1:") and digest[5:] != sha1_base32(payload):
        raise BadArchive(f"the payload's digest is wrong at {offset}")
    return Record(offset, headers, payload)


def records(data: bytes) -> Iterator[Record]:
    """All records of an archive, one frame each."""
    view = memoryview(data)
    dictionary, at = load_dictionary(view)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(view):
        magic = struct.unpack_from("<I", view, at)[0] if at + 8 <= len(view) else 0
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            at += 8 + struct.unpack_from("<I", view, at + 4)[0]
            continue
        end = frame_end(view, at)
        yield parse(decompressor.decompressobj().decompress(view[at:end]), at)
        at = end


READ_KIND = "archive string, offset long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def _rows(path: str, content: bytes, payloads: bool) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(8 + payloads)]
    number = lambda h, k: int(h[k]) if k in h else None
    for r in records(content):
        h = r.headers
        size = len(r.payload) if r.payload is not None else number(h, "x-payload-length")
        row = [path, r.offset, number(h, "x-page-id"), h.get("warc-target-uri"), h["warc-type"], size, h.get("warc-payload-digest", "").removeprefix("sha1:"), number(h, "x-refers-to-page-id")]
        for c, v in zip(columns, row + [r.payload] * payloads):
            c.append(v)
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in READ_KIND.split(", ")] + ["payload"] * payloads
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def read(spark: SparkSession, paths: list[str], *, payloads: bool = False) -> DataFrame:
    """A row per record of the archives, with `payload` (null for revisits) if asked for. From any store that Spark reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                yield _rows(path.as_py(), content.as_py(), payloads)

    python_workers(spark)
    kind = READ_KIND + ", payload binary" * payloads
    if not paths:
        return spark.createDataFrame([], kind)
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, kind)


def read_written(archives: DataFrame, *, payloads: bool = False) -> DataFrame:
    """The same for the archives that `write` has listed: the list stays a table, whose rows tasks read some READ_BYTES of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, name = pyarrow.fs.FileSystem.from_uri(path)
                with files.open_input_stream(name, compression=None) as archive:
                    content = archive.read()
                yield _rows(path, content, payloads)

    spark = archives.sparkSession
    python_workers(spark)
    n, size = archives.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(n, max(-(-size // READ_BYTES), 2 * spark.sparkContext.defaultParallelism)))
    return archives.select("path").repartition(tasks).mapInArrow(run, READ_KIND + ", payload binary" * payloads)


def digest(pages: DataFrame) -> DataFrame:
    archives = write(pages, shared_dir(pages.sparkSession))
    return read_written(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
