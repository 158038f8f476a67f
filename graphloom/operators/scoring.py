"""The health score: penalties of findings relative to the size of the code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import severity


def counts(by_level: Column | str = "severity") -> list[Column]:
    level = F.col(by_level) if isinstance(by_level, str) else by_level
    return [F.count_if(level == k).alias(name) for k, name in enumerate(severity.LABELS)]


def health(rows: DataFrame, loc: str = "loc") -> DataFrame:
    """Adds penalty, density, score and grade to rows that have a count per severity label and ``loc`` lines."""
    penalty = sum((F.col(name) * F.lit(w) for name, w in zip(severity.LABELS, severity.WEIGHTS)), F.lit(0.0))
    size = F.greatest(F.lit(1.0), F.col(loc) / F.lit(100.0))
    grade = F.lit(severity.GRADES[-1][0])
    for name, bound in reversed(severity.GRADES[:-1]):
        grade = F.when(F.col("_density") < bound, name).otherwise(grade)
    rows = rows.withColumn("_penalty", penalty).withColumn("_density", F.col("_penalty") / size)
    score = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - 10 * F.col("_density")))).cast("int")
    return (
        rows.withColumn("penalty", F.round("_penalty", 2))
        .withColumn("density", F.round("_density", 2))
        .withColumn("score", score)
        .withColumn("grade", grade)
        .drop("_penalty", "_density")
    )


def health_score(findings: DataFrame, sizes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Score per group of ``by`` (or one row): ``findings`` with severity levels, ``sizes`` with loc per group.

    Groups without findings score 100; those without lines count as a hundred lines.
    """
    by = by or []
    lines = sizes.groupBy(*by).agg(F.coalesce(F.sum(F.col("loc").cast("long")), F.lit(0)).alias("loc"))
    found = findings.groupBy(*by).agg(*counts())
    joined = lines.join(found, by, "left") if by else lines.join(F.broadcast(found))
    return health(joined.fillna(0, list(severity.LABELS)))
