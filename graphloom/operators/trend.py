"""Health over snapshots of a repository: all snapshots are analysed in one job, keyed by ``snapshot``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import severity
from graphloom.operators import scoring


def positions(n: int, samples: int) -> list[int]:
    """Places of evenly spaced ones among ``n`` items, the first and last included; all if there are no more."""
    if n <= samples or samples < 2:
        return list(range(min(n, max(samples, 0)) if n > samples else n))
    return sorted({round(i * (n - 1) / (samples - 1)) for i in range(samples)})


def samples_of(rows: DataFrame, when: str, samples: int) -> DataFrame:
    """Evenly spaced rows by ``when``, counted from the newest. One row a snapshot is small: a window orders them."""
    placed = rows.withColumn("at", F.row_number().over(Window.orderBy(F.desc(when))) - 1)
    return placed.where(F.col("at").isin(positions(rows.count(), samples))).drop("at")


def changes(samples: DataFrame, when: str) -> DataFrame:
    """Adds ``change``, the difference to the sample before. Samples are few: a window orders them."""
    return samples.withColumn("change", F.col("score") - F.lag("score").over(Window.orderBy(when)))


def snapshot_scores(modules: DataFrame, findings: DataFrame) -> DataFrame:
    """snapshot, score, grade, findings, critical, high, loc, files of each snapshot."""
    scored = scoring.health_score(findings, modules.select("snapshot", "loc"), ["snapshot"])
    files = modules.groupBy("snapshot").agg(F.count(F.lit(1)).alias("files"))
    n = sum((F.col(x) for x in severity.LABELS), F.lit(0))
    return scored.join(files, "snapshot").select("snapshot", "score", "grade", n.alias("findings"), "critical", "high", "loc", "files")


def summary(samples: DataFrame, when: str) -> DataFrame:
    """One row: delta (last score minus first, zero for less than two samples), samples, best and worst (the first of
    equals)."""
    rows = samples.agg(
        F.count(F.lit(1)).alias("samples"),
        F.max_by("score", when).alias("last"),
        F.min_by("score", when).alias("first"),
        F.min_by(when, F.struct(-F.col("score"), F.col(when))).alias("best"),
        F.min_by(when, F.struct("score", when)).alias("worst"),
    )
    return rows.select(F.when(F.col("samples") > 1, F.col("last") - F.col("first")).otherwise(0).alias("delta"), "samples", "best", "worst")
