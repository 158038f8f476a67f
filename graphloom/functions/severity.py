"""Severities: levels 0 to 4, their labels and weights, and the scales that thresholds make."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ("info", "low", "medium", "high", "critical")
INFO, LOW, MEDIUM, HIGH, CRITICAL = range(5)
#: Penalty of a finding by level.
WEIGHTS = (0.1, 0.5, 1.5, 4.0, 8.0)
#: Grades by the first bound that the density of penalties stays below.
GRADES = (("A", 1.0), ("B", 2.0), ("C", 4.0), ("D", 7.0), ("F", None))
SARIF_LEVELS = ("note", "note", "warning", "error", "error")


def scaled(value: Column, warn, high, critical) -> Column:
    """Level of a measured value; below ``warn`` it is low."""
    return F.when(value >= critical, CRITICAL).when(value >= high, HIGH).when(value >= warn, MEDIUM).otherwise(LOW)


def label(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LABELS)), level + 1)


def sarif_level(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SARIF_LEVELS)), level + 1)


def level_of(name: str) -> int:
    return LABELS.index(name)
