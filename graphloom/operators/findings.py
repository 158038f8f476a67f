"""Algebra of finding tables: identity, order, suppression, baseline, display limits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.config import parse_suppression
from graphloom.functions import paths, text
from graphloom.session import cut

SCHEMA = (
    "snapshot string, rule_id string, title string, message string, severity int, category string, path string, line int,"
    " symbol string, suggestion string, details string, rule_ordinal int, src_ordinal long"
)


def order() -> list[Column]:
    """Order of findings: the worst first, then by place, then as the rules found them."""
    return [F.desc("severity"), F.col("path"), F.coalesce("line", F.lit(0)), F.col("rule_id"), F.col("rule_ordinal"), F.col("src_ordinal")]


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*order())


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", text.fingerprint(F.col("rule_id"), F.col("path"), F.col("symbol")))


def ranked(rows: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Global row numbers without a global task: range partitions are sorted, and each adds the sizes of those before it.

    ``order`` must tell all rows apart that the result should number the same way at every run.
    """
    laid = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = laid.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = laid.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.withColumn(name, (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1).cast("long")).drop("_at", "_part", "_n", "_before")


def suppression(entries: Sequence[str], rule: Column, path: Column) -> Column:
    """Whether any ``rule`` or ``rule@glob`` entry covers a finding."""
    hits = []
    for entry in entries:
        name, glob = parse_suppression(entry)
        hits.append((rule == name) & paths.matches_glob(path, glob) if glob else rule == name)
    return reduce(or_, hits, F.lit(False))


def split_suppressed(findings: DataFrame, entries: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    hit = suppression(entries, F.col("rule_id"), F.col("path"))
    return findings.where(~hit), findings.where(hit)


def unknown_rules(entries: Sequence[str], known: Sequence[str]) -> list[str]:
    return sorted({parse_suppression(e)[0] for e in entries} - set(known))


def split_baseline(findings: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, known) findings by fingerprint; ``accepted`` has a fingerprint column. A finding is never split twice."""
    rows = with_fingerprint(findings) if "fingerprint" not in findings.columns else findings
    accepted = accepted.select("fingerprint").distinct()
    return rows.join(accepted, "fingerprint", "left_anti"), rows.join(accepted, "fingerprint", "left_semi")


def at_or_above(findings: DataFrame, level: int) -> DataFrame:
    return findings.where(F.col("severity") >= level)


def top_per_group(findings: DataFrame, group: str, limit: int, order: Sequence[Column]) -> DataFrame:
    """The first rows of each group, and how many its report leaves out. The window keeps ``limit`` rows a group before
    the shuffle; sizes come from an aggregate, not from the window."""
    first = findings.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= limit)
    sizes = findings.groupBy(group).agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("omitted"))
    return first.join(sizes, group)


def with_callers(findings: DataFrame, functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``callers``, the number of functions that call a finding's symbol; null if the symbol is no function.

    functions: name; edges: caller, callee; all by snapshot.
    """
    called = edges.groupBy("snapshot", F.col("callee").alias("symbol")).agg(F.countDistinct("caller").alias("n"))
    counted = functions.select("snapshot", F.col("name").alias("symbol")).distinct().join(called, ["snapshot", "symbol"], "left")
    return findings.join(counted.select("snapshot", "symbol", F.coalesce("n", F.lit(0)).alias("callers")), ["snapshot", "symbol"], "left")


def add_detail(details: Column, key: str, value: Column) -> Column:
    """A JSON object with one more entry, where ``value`` is not null."""
    inner = F.expr("substring(details, 2, length(details) - 2)")
    entry = F.concat(F.lit(f'"{key}":'), value.cast("string"))
    return F.when(value.isNull(), details).when(F.length(inner) == 0, F.concat(F.lit("{"), entry, F.lit("}"))).otherwise(F.concat(F.lit("{"), inner, F.lit(","), entry, F.lit("}")))
