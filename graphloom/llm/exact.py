"""Exact duplicates: 128-bit content hash, comparison of the bytes inside each hash group, one row kept.

Aggregating by (hash, text) compares the bytes: the aggregate's hash map takes two texts for one key only if they are
identical. It runs before the shuffle, so a text with a billion copies leaves each map task once. Rows find their class
through a join on the hash alone, which moves no text; its skewed partitions are split by the adaptive planner. Hashes
that stand for more than one text (none is to be expected) are joined once more, on the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, keep_rows, table, text_of


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_duplicates(
    documents: DataFrame, normalise: Callable[[Column], Column] | None = None, hash_of: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """One row per row of ``documents``: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts form a group and the largest doc_id stays. A null text counts as empty; null ids never stay while the
    group has another id (a group of null ids only has a null keep_id and keeps nothing); rows repeated with one id and
    text are all marked kept, as nothing tells them apart. Other columns are ignored. An empty table gives no rows.
    """
    clean = normalise or (lambda c: c)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), clean(text_of()).alias("t"))
    texts = texts.withColumn("h", hash_of(F.col("t")))
    classes = texts.groupBy("h", "t").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    sha = F.sha2(F.col("t").cast("binary"), 256)
    classes = cut(classes.select("h", sha.alias("text_sha256"), "keep_id", "group_size"))
    collided = classes.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h")
    collided = cut(collided)
    columns = ["doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept")]
    columns.append("text_sha256")
    several = collided.limit(1).count() > 0
    plain = classes.join(collided, "h", "left_anti") if several else classes
    # a text that occurs once needs no join: its class holds its id
    found = plain.where("group_size = 1").withColumn("doc_id", F.col("keep_id")).select(*columns)
    copies = plain.where("group_size > 1")
    found = found.unionByName(texts.select("doc_id", "h").join(copies, "h").select(*columns))
    if several:
        odd = texts.join(collided, "h", "left_semi")
        odd_classes = odd.groupBy("h", "t").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found = found.unionByName(odd.join(odd_classes, ["h", "t"]).withColumn("text_sha256", sha).select(*columns))
    return found


def keep_one(documents: DataFrame, null_ids: bool = False) -> DataFrame:
    """The rows of ``documents`` that stay, with their columns: of equal texts that with the largest doc_id, once; of
    equal texts with null ids only, none, or with ``null_ids`` one."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    classes = texts.withColumn("key", content_hash(F.col("t"))).groupBy("key", "t").agg(F.max("doc_id").alias("doc_id"))
    kept = classes if null_ids else classes.where("doc_id IS NOT NULL")
    return keep_rows(documents, cut(kept.select("doc_id", "key").distinct()))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
