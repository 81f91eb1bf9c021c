"""Keep a repository's tables fresh from a stream of changed paths.

The stream has a column `path` (and anything else): a queue of file events, or a folder that a watcher writes lists
into. Each micro-batch reads only what it names, and publishes one new version of the parsed table if the hash of a file's content
is another than the table's; so readers see whole versions, and a batch that is replayed after a failure, or tells of files
that were written with what they held, makes no version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Conflict, Versions, snapshot_diff, upsert
from ..sources import files as source_files
from ..staging import stage


def apply_paths(versions: Versions, root: str, changed: DataFrame) -> int:
    """Re-read the named files, drop those that have gone, publish if that makes a difference; the version."""
    named = stage(source_files.present(changed, root))
    fresh = stage(source_files.read(changed.sparkSession, root, named.where("mtime is not null")))
    keys = lambda df: df.select(F.col("path").alias("key"), F.col("sha256").alias("hash"))
    while True:
        base = versions.last()
        try:
            if not base:
                return versions.publish({"parsed": fresh}, base)
            parsed = versions.read("parsed", base)
            if snapshot_diff(keys(parsed.join(named, "path", "left_semi")), keys(fresh)).where("status <> 'same'").isEmpty():
                return base
            return versions.publish({"parsed": upsert(parsed.join(named, "path", "left_anti"), fresh, ["path"])}, base)
        except Conflict:  # another writer was first: these files once more, on top of its version
            continue


def refresh_stream(events: DataFrame, root: str, store_dir: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start it; `trigger` is writeStream's, availableNow by default."""
    versions = Versions(events.sparkSession, store_dir)

    def batch(changed: DataFrame, _: int) -> None:
        if not changed.isEmpty():
            apply_paths(versions, root, changed)

    return events.select(F.col("path")).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
