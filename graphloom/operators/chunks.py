"""Searchable pieces of source files: a preview of each module, its functions, classes and methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text

PREVIEW_LINES = 20


def chunk_id(path: Column, kind: Column, symbol: Column) -> Column:
    return text.sha1_of(path, kind, symbol)


def content_hash(body: Column) -> Column:
    return F.sha1(F.encode(body, "utf-8"))


def span_text(lines: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")


def chunks(modules: DataFrame) -> DataFrame:
    """snapshot, chunk_id, kind, path, symbol, lineno, end_lineno, text, content_hash, ordinal. Blank pieces and files that
    cannot be parsed have none."""

    def span(kind: str, symbol: Column, first: Column, last: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), symbol.alias("symbol"), first.cast("int").alias("lineno"), last.cast("int").alias("end_lineno"))

    functions = F.transform("functions", lambda f: span("function", f["qualname"], f["lineno"], f["end_lineno"]))

    def of_class(c: Column) -> Column:
        own = span("class", F.concat_ws(".", "module_name", c["name"]), c["lineno"], c["end_lineno"])
        return F.concat(F.array(own), F.transform(c["methods"], lambda m: span("method", m["qualname"], m["lineno"], m["end_lineno"])))

    module = span("module", F.col("module_name"), F.lit(1), F.least(F.size("lines"), F.lit(PREVIEW_LINES)))
    spans = F.concat(F.array(module), functions, F.flatten(F.transform("classes", of_class)))
    rows = modules.where("syntax_error IS NULL").select("snapshot", F.col("rel_path").alias("path"), "lines", F.posexplode(spans).alias("ordinal", "s"))
    rows = rows.select("snapshot", "path", "ordinal", "s.*", span_text(F.col("lines"), F.col("s.lineno"), F.col("s.end_lineno")).alias("text"))
    rows = rows.where(F.col("text").rlike(r"\S"))
    return rows.withColumn("chunk_id", chunk_id(F.col("path"), F.col("kind"), F.col("symbol"))).withColumn("content_hash", content_hash(F.col("text")))
