"""Commit history by the git program on the driver: text in, tables out.

No repository is an empty history. Anything else that git can't do raises GitError: an answer is whole or there is none.
"""

from __future__ import annotations

import os
import subprocess
import tempfile
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

COMMIT_ARROW = pa.schema(
    [("commit", pa.string()), ("author", pa.string()), ("author_ts", pa.timestamp("us", "UTC")), ("path", pa.string()), ("additions", pa.int32()), ("deletions", pa.int32())]
)
BLAME_KIND = "path string, line int, author string, commit string, author_time string, text string"


class GitError(RuntimeError):
    """What git says where it can't answer."""


def _is_repository(root: str) -> bool:
    """Whether git is there and root is inside a work tree; without, there is no history, which is no error."""
    try:
        return subprocess.run(["git", "-C", root, "rev-parse", "--is-inside-work-tree"], capture_output=True, text=True).stdout.strip() == "true"
    except FileNotFoundError:
        return False


def git_lines(root: str, *args: str) -> Iterator[str]:
    """The lines of its output as they come, however long that takes; GitError if it fails."""
    with tempfile.TemporaryFile() as said:
        with subprocess.Popen(["git", "-C", root, *args], stdout=subprocess.PIPE, stderr=said, env=os.environ | {"LC_ALL": "C"}) as run:
            for line in run.stdout:
                yield line.decode("utf-8", "replace").rstrip("\n")
        if run.returncode:
            said.seek(0)
            raise GitError(f"git {args[0]}: {said.read().decode('utf-8', 'replace').strip()}")


def parse_log(lines: Iterable[str]) -> Iterator[tuple]:
    """Rows of `git log --numstat --no-renames` with a header line that begins with a record separator."""
    head = None
    for line in lines:
        if line.startswith("\x1e"):
            commit, author, stamp = line[1:].split("\x1f")
            head = (commit, author, datetime.fromtimestamp(int(stamp), timezone.utc))
        elif head and line.count("\t") >= 2:
            added, deleted, path = line.split("\t", 2)
            yield (*head, path, int(added) if added.isdigit() else 0, int(deleted) if deleted.isdigit() else 0)


def commits(spark: SparkSession, root: str, *, since: str | None = None) -> DataFrame:
    """A row per commit and path, as long as the history is; empty without a repository or a commit."""
    args = ["log", "--numstat", "--no-renames", "--format=%x1e%H%x1f%an%x1f%at", *([f"--since={since}"] if since else [])]
    started = _is_repository(root) and subprocess.run(["git", "-C", root, "rev-parse", "--verify", "--quiet", "HEAD"], capture_output=True).returncode == 0
    columns: list[list] = [[] for _ in COMMIT_ARROW]
    for row in parse_log(git_lines(root, *args)) if started else ():
        for column, value in zip(columns, row):
            column.append(value)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, COMMIT_ARROW)], schema=COMMIT_ARROW))


def parse_blame(lines: Iterable[str], path: str) -> list[tuple]:
    """Rows of `git blame --line-porcelain`. A line of the file begins with a tab, whatever it says."""
    out, head, said = [], None, {}
    for line in lines:
        if line.startswith("\t"):
            if head:
                out.append((path, int(head[2]), said.get("author", ""), head[0][:8], said.get("author-time", ""), line[1:]))
            head, said = None, {}
        elif head is None and len(line.split()) >= 3 and len(line.split()[0]) == 40:
            head = line.split()
        else:
            key, _, value = line.partition(" ")
            said[key] = value
    return out


def blame(spark: SparkSession, root: str, path: str) -> DataFrame:
    """A row per line; empty for a file that git doesn't know, and without a repository."""
    known = _is_repository(root) and any(True for _ in git_lines(root, "ls-files", "--", path))
    return spark.createDataFrame(parse_blame(git_lines(root, "blame", "--line-porcelain", "--", path), path) if known else [], BLAME_KIND)


def changed_paths(root: str, scope: str) -> list[str]:
    """Paths that differ: in the working tree, in the index ("staged"), or since a revision; GitError for one that isn't there."""
    args = {"working": ["diff", "--name-only"], "staged": ["diff", "--name-only", "--cached"]}.get(scope, ["diff", "--name-only", scope, "--"])
    if scope.startswith("-") or not _is_repository(root):
        return []
    return [p for p in git_lines(root, *args) if p]
