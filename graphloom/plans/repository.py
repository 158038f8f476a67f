"""Queries on a Git repository that is made of ``supplier``: each supplier, in order, is a commit by its nation that adds a
function to one of seven files, which hold the last twenty each. The SQL counts in the table."""

from __future__ import annotations

import subprocess
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import AnalysisError
from graphloom.operators import history, parse, trend
from graphloom.plans.registry import query
from graphloom.session import shared_dir
from graphloom.sources import files, git
from graphloom.tables import table

_FILES, _HELD, _SAMPLES = 7, 20, 5


def folder(spark: SparkSession, kind: str) -> Path:
    """A new folder in the shared one, which must be one that a path can name."""
    scheme, _, place = shared_dir(spark).rpartition(":")
    if scheme not in ("", "file"):
        raise AnalysisError(f"only a mounted folder can hold a {kind}, not {scheme}: storage")
    root = Path(f"/{place.lstrip('/')}") / f"{kind}-{uuid.uuid4().hex}"
    root.mkdir(parents=True)
    return root


def make(spark: SparkSession, d: str) -> Path:
    root = folder(spark, "repository")
    git.run(root, "init", "-q", "-b", "main")
    feed = subprocess.Popen(["git", "-C", str(root), "fast-import", "--quiet"], stdin=subprocess.PIPE)
    held: dict[int, list[str]] = {}
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").orderBy("s_suppkey")
    for n, (key, nation) in enumerate(rows.toLocalIterator()):
        own = held.setdefault(key % _FILES, [])
        own.append(f"def a{key}():\n    return {key}\n")
        del own[:-_HELD]
        body = "".join(own).encode()
        feed.stdin.write(b"commit refs/heads/main\ncommitter n%d <n%d@x> %d +0000\ndata 1\nx\nM 100644 inline f%d.py\ndata %d\n%s\n" % (nation, nation, 1_700_000_000 + 3600 * n, key % _FILES, len(body), body))
    feed.stdin.close()
    if feed.wait():
        raise AnalysisError("git fast-import failed")
    git.run(root, "reset", "-q", "--hard")
    return root


_OWN = f"own AS (SELECT s_suppkey AS key, s_nationkey AS nation, 'f' || (s_suppkey % {_FILES}) || '.py' AS path, row_number() OVER (ORDER BY s_suppkey) - 1 AS n, row_number() OVER (PARTITION BY s_suppkey % {_FILES} ORDER BY s_suppkey DESC) AS back FROM supplier)"


@query(f"WITH {_OWN} SELECT path, count(*) AS commits, CAST(2 * count(*) AS BIGINT) AS insertions, CAST(2 * greatest(count(*) - {_HELD}, 0) AS BIGINT) AS deletions, count(DISTINCT nation) AS authors, strftime(to_timestamp(1700000000 + 3600 * max(n)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last_modified FROM own GROUP BY path")
def git_history(spark, d):
    changes, _ = git.file_changes(spark, make(spark, d), 1_000_000)
    rows = history.file_history(changes)
    return rows.select("path", "commits", "insertions", "deletions", "authors", F.date_format(F.to_utc_timestamp("last_modified", F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("last_modified"))


@query(
    f"""WITH {_OWN}, total AS (SELECT count(*) AS t FROM supplier), spots AS (SELECT DISTINCT CAST(CASE WHEN t <= {_SAMPLES} THEN i ELSE round_even(i * (t - 1) / {_SAMPLES - 1}.0, 0) END AS BIGINT) AS pos, t FROM range({_SAMPLES}) r(i), total WHERE i < t)
    SELECT pos AS position, path, CAST(least(count(*), {_HELD}) AS BIGINT) AS functions FROM spots JOIN own ON n <= t - 1 - pos GROUP BY pos, path"""
)
def git_snapshots(spark, d):
    """Functions of each file at evenly spaced commits, counted from the newest."""
    root = make(spark, d)
    every = git.commits(root, 1_000_000)
    chosen = {every[k].sha: k for k in trend.positions(len(every), _SAMPLES)}
    modules = parse.parse_sources(git.snapshot_files(spark, root, list(chosen)))
    position = F.create_map(*(F.lit(x) for pair in chosen.items() for x in pair))[F.col("snapshot")]
    return modules.select(position.cast("long").alias("position"), F.col("rel_path").alias("path"), F.size("functions").cast("long").alias("functions"))


@query(f"WITH {_OWN} SELECT DISTINCT path FROM own WHERE n >= (SELECT count(*) FROM supplier) - 3")
def git_changed(spark, d):
    """Files that the last three commits changed."""
    return _names(spark, git.changed_paths(make(spark, d), "HEAD~3"))


@query(f"WITH {_OWN} SELECT path, CAST(least(count(*), {_HELD}) AS BIGINT) AS functions FROM own GROUP BY path")
def git_sources(spark, d):
    """Functions of the files that Git lists."""
    modules = parse.parse_sources(files.source_files(spark, make(spark, d)))
    return modules.select(F.col("rel_path").alias("path"), F.size("functions").cast("long").alias("functions"))


@query(f"WITH {_OWN}, kept AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY key) AS place FROM own WHERE back <= {_HELD}) SELECT path, replace(path, '.py', '') || '.a' || key AS qualname, CAST(1 AS BIGINT) AS commits, CAST(1 AS BIGINT) AS authors, 2 AS lines FROM kept WHERE place <= 8")
def git_function_churn(spark, d):
    root = make(spark, d)
    functions = parse.functions(parse.parse_sources(files.source_files(spark, root)))
    return git.function_churn(root, functions).select("path", "qualname", "commits", "authors", "lines")


def _names(spark: SparkSession, found) -> DataFrame:
    return spark.createDataFrame([(n,) for n in sorted(found)], "path string")
