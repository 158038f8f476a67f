"""Change history: per-file sums, percentiles, hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_history(changes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``changes`` (path, author, insertions, deletions, committed_at; a row per commit and file) to path, commits,
    insertions, deletions, churn, authors, last_modified."""
    total = lambda c: F.sum(F.col(c).cast("long"))
    rows = changes.groupBy(*by, "path").agg(
        F.count(F.lit(1)).alias("commits"),
        total("insertions").alias("insertions"),
        total("deletions").alias("deletions"),
        F.countDistinct("author").alias("authors"),
        F.max("committed_at").alias("last_modified"),
    )
    return rows.withColumn("churn", F.col("insertions") + F.col("deletions"))


def churn_percentile(history: DataFrame, share: float) -> DataFrame:
    """One row: ``value``, the interpolated percentile of commits per file; zero without files."""
    return history.agg(F.coalesce(F.percentile("commits", min(max(share, 0.0), 1.0)), F.lit(0.0)).alias("value"))


def top_churn(history: DataFrame, limit: int) -> DataFrame:
    return history.orderBy(F.desc("commits"), F.desc("churn"), "path").limit(limit)


def heat(history: DataFrame) -> DataFrame:
    """Adds ``heat``, 0 to 100: churn times the logarithm of commits, relative to the hottest file; no rows if no file
    has any. The maximum is one row, joined by broadcast."""
    rows = history.withColumn("raw", F.col("churn") * F.log1p(F.col("commits").cast("double")))
    peak = rows.agg(F.max("raw").alias("peak"))
    return rows.join(F.broadcast(peak)).where("peak > 0").withColumn("heat", F.round(100 * F.col("raw") / F.col("peak"), 1)).drop("raw", "peak")


def hotspots(history: DataFrame, limit: int) -> DataFrame:
    return heat(history).orderBy(F.desc("heat"), "path").limit(limit)


def hot_functions(functions: DataFrame, history: DataFrame, churn: DataFrame, min_commits: int, min_cyclomatic: int, high: int) -> DataFrame:
    """Complex functions in often changed code, with scope ('function' or 'file') and level.

    functions: path, qualname, cyclomatic and more. history: ``file_history``. churn: path, qualname, commits, authors,
    lines, last_modified of functions whose own changes are known: these must suffice; others have their file's.
    """
    floor = churn_percentile(history, 0.75).select(F.greatest(F.lit(min_commits), F.col("value").cast("int")).alias("floor"))
    often = history.join(F.broadcast(floor)).where("commits >= floor")
    files = often.select("path", F.col("commits").alias("file_commits"), F.col("churn").alias("file_churn"), F.col("authors").alias("file_authors"))
    own = churn.select("path", "qualname", F.col("commits").alias("own_commits"), F.col("authors").alias("own_authors"), F.col("lines").alias("own_lines"), F.col("last_modified").alias("own_modified"))
    rows = functions.where(F.col("cyclomatic") >= min_cyclomatic).join(files, "path").join(own, ["path", "qualname"], "left")
    known = F.col("own_commits").isNotNull()
    rows = rows.where(~known | (F.col("own_commits") >= min_commits))
    return rows.withColumn("scope", F.when(known, "function").otherwise("file")).withColumn("level", F.when(F.col("cyclomatic") >= high, 3).otherwise(2))


def most_complex(functions: DataFrame, per_file: int = 8, by: str = "path", order: tuple[Column | str, ...] = ("ordinal",)) -> DataFrame:
    """The most complex functions of each file, in source order among equals."""
    window = Window.partitionBy(by).orderBy(F.desc("cyclomatic"), *order)
    return functions.withColumn("place", F.row_number().over(window)).where(F.col("place") <= per_file)
