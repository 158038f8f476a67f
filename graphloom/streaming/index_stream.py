"""A chunk table kept up to date from a stream of files.

Each micro-batch is merged by id: the newest content wins. The table is cut into buckets by a hash of the id, and a batch
writes anew only the buckets that it touches, each under its own number, so a batch that is run again writes the same
folders again, and a failure between writing and committing repeats nothing. Of a bucket the newest version counts and the
one before it is kept.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import chunks
from graphloom.session import shared_dir
from graphloom.tables import table

BUCKETS = 64
_ROW = "chunk_id string, content_hash string, version int"


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, target: str) -> dict[int, list[int]]:
    """Of each bucket the batches that wrote it, in order."""
    fs, at = _fs(spark, f"{target}/batch=*/bucket=*")
    found: dict[int, list[int]] = {}
    for status in fs.globStatus(at) or []:
        batch, bucket = map(int, re.search(r"batch=(\d+)/bucket=(\d+)$", status.getPath().toString()).groups())
        found.setdefault(bucket, []).append(batch)
    return {k: sorted(v) for k, v in found.items()}


def _read(spark: SparkSession, target: str, newest: dict[int, int]) -> DataFrame:
    folders = [f"{target}/batch={batch}/bucket={bucket}" for bucket, batch in newest.items()]
    return spark.read.schema(_ROW).parquet(*folders) if folders else spark.createDataFrame([], _ROW)


def current(spark: SparkSession, target: str) -> DataFrame:
    """chunk_id, content_hash, version of the table as it is."""
    return _read(spark, target, {bucket: batches[-1] for bucket, batches in versions(spark, target).items()})


def _merge(spark: SparkSession, target: str):
    bucket = F.pmod(F.xxhash64("chunk_id"), F.lit(BUCKETS)).cast("int").alias("bucket")

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = batch.select("chunk_id", "content_hash", "version").persist()
        touched = [r.bucket for r in new.select(bucket).distinct().collect()]  # BUCKETS at most
        known = versions(spark, target)
        before = {b: [v for v in known.get(b, []) if v < batch_id] for b in touched}
        old = _read(spark, target, {b: v[-1] for b, v in before.items() if v})
        merged = old.unionByName(new).groupBy("chunk_id").agg(F.max_by("content_hash", "version").alias("content_hash"), F.max("version").alias("version"))
        merged.select("*", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch={batch_id}")
        new.unpersist()
        for b, batches in before.items():
            for v in batches[:-1]:
                fs, at = _fs(spark, f"{target}/batch={v}/bucket={b}")
                fs.delete(at, True)

    return merge


def keep_current(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Run what has arrived in ``stream`` (chunk_id, content_hash, version) to its end."""
    running = stream.writeStream.foreachBatch(_merge(stream.sparkSession, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as two arrivals, the second with every fifth text changed: the current content hash of each."""
    at = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "documents")
    body = lambda v: F.when((F.lit(v) == 1) & (F.col("doc_id") % 5 == 0), F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    for version in (0, 1):
        part = rows.select(F.col("doc_id").cast("string").alias("chunk_id"), chunks.content_hash(body(version)).alias("content_hash"), F.lit(version).alias("version"))
        part.write.parquet(f"{at}/in/{version}")
        stream = spark.readStream.schema(_ROW).parquet(f"{at}/in/*")
        keep_current(stream, f"{at}/table", f"{at}/checkpoint")
    return current(spark, f"{at}/table")
