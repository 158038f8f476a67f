"""The vector index: a Parquet table that is renewed by what changed.

Versions lie side by side under the index folder and a small pointer names the current one, so readers never meet a half
written index and no file is overwritten while it is read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import IndexUnavailable
from graphloom.operators import search
from graphloom.session import cut

VERSION = 1
COLUMNS = ("chunk_id", "kind", "path", "symbol", "lineno", "end_lineno", "text", "content_hash")


@dataclass(frozen=True)
class IndexStats:
    total: int
    embedded: int
    reused: int
    removed: int
    dimensions: int
    model: str


def plan(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Each chunk with ``action``: reuse what is stored under its id with the same content, else embed; and each stored
    chunk that is gone, with remove. One full join on the id."""
    new, old = chunks.select("chunk_id", F.col("content_hash").alias("new_hash")), stored.select("chunk_id", F.col("content_hash").alias("old_hash"))
    action = F.when(F.col("new_hash").isNull(), "remove").when(F.col("new_hash") == F.col("old_hash"), "reuse").otherwise("embed")
    return new.join(old, "chunk_id", "full").select("chunk_id", action.alias("action"))


def stats(actions: DataFrame) -> DataFrame:
    n = lambda a: F.count_if(F.col("action") == a)
    return actions.agg(n("embed").alias("embedded"), n("reuse").alias("reused"), n("remove").alias("removed"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _pointer(spark: SparkSession, folder: str) -> dict | None:
    fs, at = _fs(spark, f"{folder}/current.json")
    if not fs.exists(at):
        return None
    try:
        found = json.loads(spark.read.text(f"{folder}/current.json", wholetext=True).first()[0])
    except (ValueError, TypeError):
        return None
    return found if isinstance(found, dict) and found.get("version") == VERSION else None


def _point(spark: SparkSession, folder: str, value: dict) -> None:
    fs, at = _fs(spark, f"{folder}/current.json")
    out = fs.create(at, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()


def load(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """The current table; an error if there is none of this model and version."""
    pointer = _pointer(spark, folder)
    if pointer is None or pointer.get("model") != model:
        raise IndexUnavailable(f"{folder} holds no index of the model {model}; build it first")
    return spark.read.parquet(f"{folder}/{pointer['table']}")


def _last(chunks: DataFrame) -> DataFrame:
    """Of chunks with one id the last in order. Only ids are grouped, and texts only where an id does occur again."""
    again = cut(chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_id"))
    if again.isEmpty():
        return chunks.select(*COLUMNS)
    several = chunks.join(again, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.max_by(F.struct(*COLUMNS[1:]), F.struct("path", "ordinal")).alias("c"))
    return chunks.join(again, "chunk_id", "left_anti").select(*COLUMNS).unionByName(several.select("chunk_id", "c.*"))


def build(chunks: DataFrame, folder: str, embedder, rebuild: bool = False) -> IndexStats:
    """Renew the index: only new and changed chunks are embedded, those that are gone are left out, and another model
    starts afresh. Chunks of one id count once (the last in order)."""
    spark = chunks.sparkSession
    chunks = _last(chunks)
    try:
        old = None if rebuild else load(spark, folder, embedder.model_name)
    except IndexUnavailable:
        old = None
    if old is None:
        everything, kept, counts = search.embedded(chunks, embedder), None, None
    else:
        same = old.select("chunk_id", "content_hash")
        kept = old.join(chunks.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_semi")
        fresh = search.embedded(chunks.join(same, ["chunk_id", "content_hash"], "left_anti"), embedder)
        everything = kept.unionByName(fresh)
        counts = stats(plan(chunks, old)).first()
    table = f"chunks-{uuid.uuid4().hex}"
    everything.write.parquet(f"{folder}/{table}")
    stored = spark.read.parquet(f"{folder}/{table}")
    total, size = stored.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    _point(spark, folder, {"version": VERSION, "model": embedder.model_name, "table": table})
    reused = counts.reused if counts else 0
    removed = max(0, old.count() - reused) if old is not None else 0
    return IndexStats(total, total - reused, reused, removed, getattr(embedder, "dimensions", size), embedder.model_name)


def find(spark: SparkSession, folder: str, query: str, embedder, limit: int, min_score: float) -> DataFrame:
    vector = search.query_vector(spark, embedder, query)
    return search.cosine_hits(load(spark, folder, embedder.model_name), "embedding", vector, limit, min_score, ("path", "lineno"), unit=True)
