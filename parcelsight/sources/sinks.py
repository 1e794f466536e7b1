"""Sinks, and staged tables that cut lineage on shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A large processed table, one Parquet file per write task."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_result(df: DataFrame, path: str) -> None:
    """A small report (tens of rows) as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def staging_root(spark: SparkSession) -> str:
    """Folder for staged tables: the cluster's shared checkpoint folder.

    Only a session that names none falls back to a temporary folder, and only
    in local mode, where every task runs on this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="parcelsight-")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: later passes scan only the columns they need.

    The files outlive executors, so a lost executor costs a re-read and not a
    recomputation of the joins behind the table.
    """
    return stage_at(df, label)[0]


#: Rows of a task that a learner passes over; it is bound by computing and not by bytes.
LEARNER_ROWS = 20_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows over enough tasks for a learner, dealt by ``key``.

    Adaptive execution merges partitions by their bytes, and feature vectors are small; an explicit number stays.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // LEARNER_ROWS))
    return df.repartition(tasks, key)


def stage_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """A staged table and its folder."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/parcelsight/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no later read needs, on whatever file system it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
