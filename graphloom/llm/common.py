"""Shared pieces of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import cut, shared_dir

__all__ = ["WORD", "cut", "fold", "fresh", "keep_rows", "labelled_sample", "map_rows", "shared_dir", "table", "text_key", "text_of", "union_all"]

#: Longest text that a model learns from: none of the longer ones is cut, they are not samples.
MAX_BYTES = 1 << 15
#: One ASCII word of the contracts: what stands between the bytes 0x20 and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id falls into fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)), F.lit(0))


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def map_rows(df: DataFrame, function: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``mapInArrow``: one record batch (bounded in rows and bytes by the session) at a time."""
    return df.mapInArrow(function, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(documents: DataFrame) -> tuple[DataFrame, str]:
    """``documents`` with a 128-bit hash of the text (null: empty), and the new column's name."""
    name = fresh(documents, "text_key")
    return documents.withColumn(name, F.unhex(F.md5(text_of().cast("binary")))), name


def keep_rows(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose id and text are in ``kept`` (doc_id, key), each of them once.

    One shuffle of the documents serves the join and the removal of repeated rows.
    """
    keyed, key = text_key(documents)
    here = keyed["doc_id"].cast("long").eqNullSafe(kept["doc_id"]) & (keyed[key] == kept["key"])
    return keyed.join(kept, here, "left_semi").dropDuplicates(["doc_id", key]).select(*documents.columns)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, keep: Column, max_rows: int):
    """At most ``max_rows`` labelled texts on the driver, the same ones at every run.

    The labels are cut first, by a hash of the id, so that what is broadcast and what is collected has at most
    ``max_rows`` rows whatever the size of the corpus: of rows that share an id, however many, the least text counts. Null
    ids, labels and texts are left out, and so are texts of more than ``MAX_BYTES`` bytes, which bounds what is collected.
    Returns (texts, labels).
    """
    picked = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & keep)
        .select("doc_id", F.col(label).cast("int").alias("y"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(max_rows)
    )
    rows = (
        documents.where(F.octet_length("text") <= MAX_BYTES)
        .select("doc_id", "text")
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "y")
        .agg(F.min("text").alias("text"))
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("y", "ascending")])
    )
    return rows.column("text").cast("binary").to_pylist(), rows.column("y").to_pylist()
