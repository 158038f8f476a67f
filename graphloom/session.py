"""What an operator needs of the session: the folder that executors share, and cuts of the lineage through it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from graphloom.errors import ConfigurationError


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors must share. Only a session on one machine may name none: it
    gets a temporary one."""
    path, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ConfigurationError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"{tempfile.gettempdir()}/graphloom-shared"
        spark.conf.set("spark.checkpoint.dir", path)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that an iteration neither repeats nor loses its past."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly over all cores, for rows that mean more work than their size tells: a small file is one task
    when it is read, and adaptive execution joins small partitions."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
