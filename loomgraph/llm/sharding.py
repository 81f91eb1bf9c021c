"""Size-tiered shard store: small immutable shards per arrival, merges of similarly sized ones, versioned manifests.

DataFrame functions only on the data; the driver handles file names and sizes, never rows. A store is a
folder with `data/` (Parquet files, written once and never changed) and `manifests/` (one JSON file a
version: every live shard's path, bytes, rows, tier and the version that made it, and the store's schema).

* `append` writes each arrival's rows where they are (no shuffle): one small shard per task and arrival.
* `compact` looks at sizes only. Shards fall into tiers, a factor `fanout` apart; a tier with at least
  `fanout` shards below the target size is merged, map-only, into files of about the target size. It
  repeats until no tier is due.
* `commit` writes the new manifest under a temporary name and renames it to the next version's name, which
  fails if another writer has taken that version, and then reads it back, for not every file system renames
  atomically. Readers that hold an older manifest keep a whole snapshot, for old shards stay until `vacuum`. A job
  that dies before its commit leaves files that no manifest lists.

Hot keys don't matter, as nothing is dealt by key; a lost executor's tasks are run again by Spark and only
committed files are listed. Each append checks that every row it can count is in a listed shard, and each merge that
it wrote as many rows as it read. The driver holds a manifest's entry a shard, as Spark's planner does for
any scan: some 1.6 million at 100 TB and the default target, which is why `target` is a parameter. Folders whose
shards are all live are read by the folder's name.

Defined cases: an empty arrival adds no shard and an empty store reads as no rows; nulls, repeated rows and
very long texts are stored as they are. An arrival may have any value, null too. A later append may lack
columns (null when read) or add some (null in older rows); one whose column has another type, or that has a column
twice, is refused before anything is written. The store's own columns (`shard`, `shard_tier`, `shard_version`) get
underscores at the end where the rows have columns of these names.
"""

from __future__ import annotations

import json
import math
import uuid
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from .common import ROW_GROUP, free_name, shared_dir

TARGET, SMALLEST, FANOUT = 64 << 20, 1 << 20, 4
WRITTEN = {"compression": "zstd", "parquet.block.size": ROW_GROUP}


class Conflict(Exception):
    """Another writer committed this version first."""


class SchemaMismatch(ValueError):
    """Rows that the store's schema can't take."""


def _nullable(kind: DataType) -> DataType:
    """The type with nulls allowed everywhere, as Parquet files of any origin are read."""

    def loosen(value: object) -> object:
        if isinstance(value, dict):
            return {k: True if k in ("nullable", "containsNull", "valueContainsNull") else {} if k == "metadata" else loosen(v) for k, v in value.items()}
        return [loosen(v) for v in value] if isinstance(value, list) else value

    return StructField.fromJson(loosen(StructField("x", kind).jsonValue())).dataType


def merged_schema(old: StructType | None, new: StructType) -> StructType:
    """The old columns in their order, then the new ones; names are equal whatever their case."""
    fields = {f.name.lower(): f for f in old or []}
    names = [f.name.lower() for f in new]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise SchemaMismatch(f"columns that occur twice: {', '.join(twice)}")
    for f in new:
        kind = _nullable(f.dataType)
        known = fields.setdefault(f.name.lower(), StructField(f.name, kind))
        if known.dataType != kind:
            raise SchemaMismatch(f"column {f.name} is {f.dataType.simpleString()} and was {known.dataType.simpleString()}")
    return StructType(list(fields.values()))


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, *, target: int = TARGET, smallest: int = SMALLEST, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.smallest, self.fanout = spark, root.rstrip("/"), target, smallest, fanout
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    # Manifests

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest, the last one's if none is named."""
        found = self.versions()
        if not found:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version or found[-1]:09d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: dict, shards: list[dict], schema: str | None) -> dict:
        """Publish shards as the version after base's, or raise Conflict."""
        token = uuid.uuid4().hex
        new = {"version": base["version"] + 1, "token": token, "schema": schema, "shards": sorted(shards, key=lambda s: s["path"])}
        temporary = self._path(f"{self.root}/manifests/.{token}")
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        final = self._path(f"{self.root}/manifests/v{new['version']:09d}.json")
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            files.rename(self._fs.makeQualified(temporary), self._fs.makeQualified(final), none)
        except Py4JJavaError as error:
            self._fs.delete(temporary, False)
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            raise Conflict(f"version {new['version']} of {self.root}") from error
        if self.manifest(new["version"])["token"] != token:
            raise Conflict(f"version {new['version']} of {self.root}")
        return new

    # Shards

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.smallest, self.fanout)) + 1) if size >= self.smallest else 0

    def _listed(self, folder: str, version: int) -> list[dict]:
        """The files that a finished job left under a folder of data/."""
        files, out = self._fs.listFiles(self._path(f"{self.root}/data/{folder}"), True), []
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().endswith(".parquet"):
                path = f.getPath().toUri().getPath()
                path = path[path.rindex(f"/data/{folder}/") + 1 :]
                out.append({"path": path, "bytes": f.getLen(), "tier": self.tier(f.getLen()), "version": version})
        if not out:
            return out
        # a count by file; readers take it from footers and page headers, not from the texts
        found = self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.root}/data/{folder}").groupBy(F.col("_metadata.file_path").alias("file")).count().collect()
        counts = {(path := unquote(r["file"]))[path.rindex(f"/data/{folder}/") + 1 :]: r["count"] for r in found}
        for s in out:
            s["rows"] = counts.pop(s["path"], 0)
        if counts:
            raise RuntimeError(f"rows in files that aren't listed: {sorted(counts)[:3]}")
        out = [s for s in out if s["rows"]]
        return [s | {"of": len(out)} for s in out]

    def append(self, df: DataFrame, arrival: Column | None = None) -> dict:
        """Add rows as small shards, one per task and arrival; the committed manifest."""
        base = self.manifest()
        folder = f"a{base['version'] + 1:09d}-{uuid.uuid4().hex[:8]}"
        schema = merged_schema(self._schema(base), df.schema).json()
        name = free_name(df, "_arrival")
        df.withColumn(name, F.lit(0) if arrival is None else arrival).write.partitionBy(name).options(**WRITTEN).parquet(f"{self.root}/data/{folder}")
        return self.commit(base, base["shards"] + self._listed(folder, base["version"] + 1), schema)

    def due(self, manifest: dict) -> list[list[dict]]:
        """The runs of similarly sized shards that are to be merged."""
        tiers: dict[int, list[dict]] = {}
        for s in manifest["shards"]:
            if s["bytes"] * 2 <= self.target:
                tiers.setdefault(s["tier"], []).append(s)
        return [run for _, run in sorted(tiers.items()) if len(run) >= self.fanout]

    def compact(self) -> dict:
        """Merge until no tier is due; the last manifest."""
        base = self.manifest()
        while runs := self.due(base):
            merged, gone = [], set()
            for k, run in enumerate(runs):
                files = max(1, round(sum(s["bytes"] for s in run) / self.target))
                read = sum(s["rows"] for s in run)
                folder = f"c{base['version'] + 1:09d}-{k}-{uuid.uuid4().hex[:8]}"
                # tasks may be fewer than files, as Spark reads small files together: then a task writes several
                self._rows(run, base).coalesce(files).write.options(**WRITTEN, maxRecordsPerFile=-(-read // files)).parquet(f"{self.root}/data/{folder}")
                new = self._listed(folder, base["version"] + 1)
                if (wrote := sum(s["rows"] for s in new)) != read:
                    raise RuntimeError(f"a merge read {read} rows and wrote {wrote}")
                if len(new) >= len(run):
                    continue
                merged += new
                gone |= {s["path"] for s in run}
            if not gone:
                break
            base = self.commit(base, [s for s in base["shards"] if s["path"] not in gone] + merged, base["schema"])
        return base

    def _schema(self, manifest: dict) -> StructType | None:
        return StructType.fromJson(json.loads(manifest["schema"])) if manifest["schema"] else None

    def _rows(self, shards: list[dict], manifest: dict) -> DataFrame:
        """Rows of some shards in the store's columns, without what the path holds."""
        folders: dict[str, list[dict]] = {}
        for s in shards:
            folders.setdefault("/".join(s["path"].split("/")[:2]), []).append(s)
        paths = [p for folder, own in folders.items() for p in ([folder] if len(own) == own[0]["of"] else [s["path"] for s in own])]
        return self.spark.read.schema(self._schema(manifest)).option("recursiveFileLookup", True).parquet(*[f"{self.root}/{p}" for p in paths])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, each with its shard, that shard's tier and the version that made it."""
        manifest = self.manifest(version)
        kind = self._schema(manifest) or StructType()
        if not manifest["shards"]:
            rows = self.spark.createDataFrame([], kind)
            return rows.withColumns({free_name(rows, "shard"): F.lit(None).cast("string"), free_name(rows, "shard_tier"): F.lit(0), free_name(rows, "shard_version"): F.lit(0)})
        rows = self._rows(manifest["shards"], manifest)
        path, size = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), F.col("_metadata.file_size")
        steps = F.lit(0)
        for t in range(self.tier(1 << 50) + 1):
            steps = F.when(size >= self.smallest * self.fanout**t, t + 1).otherwise(steps)
        made = F.regexp_extract(path, r"^.*/data/[ac](\d+)-", 1).cast("int")
        own = {"shard": F.regexp_extract(path, r"^.*/(data/[ac]\d+-.*)$", 1), "shard_tier": steps, "shard_version": made}
        return rows.withColumns({free_name(rows, name): value for name, value in own.items()})

    def vacuum(self) -> int:
        """Delete files that the last manifest doesn't list; how many. Readers of older versions lose their snapshots."""
        live, n = {s["path"] for s in self.manifest()["shards"]}, 0
        files = self._fs.listFiles(self._path(f"{self.root}/data"), True)
        gone = []
        while files.hasNext():
            f = files.next().getPath()
            path = f.toUri().getPath()
            if f.getName().endswith(".parquet") and path[path.rindex("/data/") + 1 :] not in live:
                gone.append(f)
        for f in gone:
            n += bool(self._fs.delete(f, False))
        return n


def shard(docs: DataFrame, *, arrivals: int = 4, **options) -> DataFrame:
    """All rows appended in `arrivals` arrivals, compacted, and read back from the last manifest."""
    store = ShardStore(docs.sparkSession, shared_dir(docs.sparkSession), **options)
    store.append(docs, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)))
    store.compact()
    return store.read()


def digest(docs: DataFrame, **options) -> DataFrame:
    """Where each document went: doc_id, the length and SHA-256 of the text as read back, shard, its tier and version."""
    rows = shard(docs, **options)
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), "shard", "shard_tier", "shard_version")
