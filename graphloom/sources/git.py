"""Git as a source: listings, history, function changes, diffs and snapshots.

Listings and logs are read by one child process each on the driver; what needs a process per function or per file runs on
the executors, which then need the repository on storage that they share.
"""

from __future__ import annotations

import subprocess
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import AnalysisError
from graphloom.functions import paths
from graphloom.operators import history

CHANGES = "path string, author string, insertions long, deletions long, committed_at timestamp, committed_text string, sha string"
CHURN = "path string, qualname string, commits long, authors long, lines int, last_modified string"
_FIELD, _RECORD = "\x1f", "\x1e"


def run(root: Path | str, *arguments: str, data: bytes | None = None) -> bytes:
    """Output of a git command; AnalysisError with git's own words if it fails."""
    try:
        done = subprocess.run(["git", "-C", str(root), "-c", "core.quotepath=off", *arguments], input=data, capture_output=True, check=False)
    except OSError as error:
        raise AnalysisError(f"git cannot be run: {error}") from error
    if done.returncode:
        raise AnalysisError(done.stderr.decode(errors="replace").strip() or f"git {arguments[0]} failed")
    return done.stdout


def _names(output: bytes) -> list[str]:
    return [x for x in output.decode("utf-8", "surrogateescape").split("\0") if x]


def top_level(root: Path) -> Path | None:
    """Working tree that ``root`` is in; None outside of one."""
    try:
        return Path(run(root, "rev-parse", "--show-toplevel").decode().rstrip("\n"))
    except AnalysisError:
        return None


def tracked_files(root: Path) -> list[str] | None:
    """Tracked and new files below ``root`` that are not ignored, relative to it; None outside of a repository."""
    try:
        return _names(run(root, "ls-files", "--cached", "--others", "--exclude-standard", "-z"))
    except AnalysisError:
        return None


@dataclass(frozen=True)
class Head:
    sha: str
    branch: str | None


def head(root: Path) -> Head | None:
    """The current commit; None outside of a repository or before the first commit. A detached head has no branch."""
    try:
        sha = run(root, "rev-parse", "--verify", "HEAD").decode().strip()
    except AnalysisError:
        return None
    try:
        return Head(sha, run(root, "symbolic-ref", "--short", "-q", "HEAD").decode().strip() or None)
    except AnalysisError:
        return Head(sha, None)


def _prefix(root: Path) -> str:
    """Where ``root`` is below the working tree's top, with a slash at its end."""
    return run(root, "rev-parse", "--show-prefix").decode("utf-8", "surrogateescape").rstrip("\n")


def file_changes(spark: SparkSession, root: Path, max_commits: int) -> tuple[DataFrame, int]:
    """(a row per commit and changed file, number of commits) of the newest commits. Merges count against their first
    parent; binary files change no lines."""
    form = f"--format={_RECORD}%H{_FIELD}%an{_FIELD}%ae{_FIELD}%cI"
    log = run(root, "log", "-n", str(max_commits), "--numstat", "-z", "--no-renames", "--diff-merges=first-parent", form).decode("utf-8", "replace")
    prefix, rows, commits = _prefix(root), [], 0
    for record in log.split(_RECORD)[1:]:
        header, *entries = record.split("\0")
        sha, name, email, when = header.strip("\n").split(_FIELD)
        commits += 1
        for entry in entries:
            parts = entry.strip("\n").split("\t", 2)
            if len(parts) == 3 and parts[2].startswith(prefix):
                lines = [int(x) if x.isdigit() else 0 for x in parts[:2]]
                rows.append((parts[2][len(prefix) :], name or email or "unknown", *lines, when, sha))
    frame = spark.createDataFrame(rows, "path string, author string, insertions long, deletions long, committed_text string, sha string")
    return frame.withColumn("committed_at", F.try_to_timestamp("committed_text")), commits


def function_churn(root: Path, functions: DataFrame, per_file: int = 8) -> DataFrame:
    """Commits and authors that changed the lines of each file's most complex functions, one git process a function on
    the executors. Ranges that git cannot follow are left out; of functions with one name the last counts."""
    rows = history.most_complex(functions.withColumnRenamed("rel_path", "path"), per_file)
    rows = rows.select("path", "qualname", "ordinal", "lineno", "end_lineno")
    where = str(root)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                try:
                    # relative to the analysed root, which may lie inside the working tree
                    log = run(where, "log", "-s", f"--format={_RECORD}%H{_FIELD}%an{_FIELD}%cI", "-L", f"{r['lineno']},{r['end_lineno']}:{r['path']}")
                except AnalysisError:
                    continue
                for line in log.decode("utf-8", "replace").split(_RECORD)[1:]:
                    sha, author, when = line.strip("\n").split(_FIELD)
                    found.append({**r, "sha": sha, "author": author, "when": when})
            yield pa.RecordBatch.from_pylist(found, schema=_RANGES)

    schema = "path string, qualname string, ordinal int, lineno int, end_lineno int, sha string, author string, when string"
    each = rows.repartition("path").mapInArrow(ranges, schema)
    grouped = each.groupBy("path", "qualname", "ordinal").agg(
        F.countDistinct("sha").alias("commits"),
        F.countDistinct("author").alias("authors"),
        F.max(F.col("end_lineno") - F.col("lineno") + 1).alias("lines"),
        F.max_by("when", F.try_to_timestamp("when")).alias("last_modified"),
    )
    last = grouped.groupBy("path", "qualname").agg(F.max_by(F.struct("commits", "authors", "lines", "last_modified"), "ordinal").alias("c"))
    return last.select("path", "qualname", "c.*")


_RANGES = pa.schema([("path", pa.string()), ("qualname", pa.string()), ("ordinal", pa.int32()), ("lineno", pa.int32()), ("end_lineno", pa.int32()), ("sha", pa.string()), ("author", pa.string()), ("when", pa.string())])


def changed_paths(root: Path, since: str) -> frozenset[str]:
    """Python files below ``root`` that differ from a revision: committed, staged, unstaged or untracked."""
    if top_level(root) is None:
        raise AnalysisError(f"{root} is in no Git repository")
    try:
        run(root, "rev-parse", "--verify", "--quiet", f"{since}^{{commit}}")
    except AnalysisError as error:
        raise AnalysisError(f"unknown revision: {since}") from error
    changed = _names(run(root, "diff", "--name-only", "--relative", "-z", since, "--"))
    new = _names(run(root, "ls-files", "--others", "--exclude-standard", "-z"))
    return frozenset(p for p in changed + new if p.endswith(".py"))


@dataclass(frozen=True)
class Commit:
    sha: str
    committed_at: str
    subject: str


def commits(root: Path, window: int) -> list[Commit]:
    """The newest commits first."""
    log = run(root, "log", "-n", str(window), f"--format={_RECORD}%H{_FIELD}%cI{_FIELD}%s").decode("utf-8", "replace")
    return [Commit(*record.strip("\n").split(_FIELD)) for record in log.split(_RECORD)[1:]]


def snapshot_files(spark: SparkSession, root: Path, shas: Collection[str], exclude: Collection[str] = ()) -> DataFrame:
    """snapshot, rel_path, content of the Python files of each commit, without a working tree: names come from the
    driver, contents are read on the executors, one git process a batch."""
    prefix, rows = _prefix(root), []
    for sha in shas:
        for name in _names(run(root, "ls-tree", "-r", "-z", "--name-only", "--full-tree", sha)):
            rel = name.removeprefix(prefix)
            if name.startswith(prefix) and rel.endswith(".py") and not paths.is_excluded_text(rel) and not paths.matches_text(rel, tuple(exclude)):
                rows.append((sha, rel))
    where = str(root)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.to_pylist()
            asked = "".join(f"{r['snapshot']}:{prefix}{r['rel_path']}\n" for r in names).encode()
            out, found, at = run(where, "cat-file", "--batch", data=asked), [], 0
            for _ in names:
                end = out.index(b"\n", at)
                told = out[at:end].split(b" ")
                size = int(told[-1]) if told[-1].isdigit() else -1
                found.append(out[end + 1 : end + 1 + size] if size >= 0 else None)
                at = end + 1 + (size + 1 if size >= 0 else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["snapshot", "rel_path", "content"])

    listed = spark.createDataFrame(rows, "snapshot string, rel_path string")
    return listed.repartition("snapshot", "rel_path").mapInArrow(contents, "snapshot string, rel_path string, content binary")
