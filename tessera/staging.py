"""Cutting lineage through the folder that all executors share, and dealing rows to tasks."""

from __future__ import annotations

import atexit
import math
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below spark.checkpoint.dir, or on a local master below a folder of our own where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a folder that all executors share is needed")
        at = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    path = f"{at.rstrip('/')}/tessera-{tag}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended; the folder is left to the cluster's own cleaning
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder once and read back."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a dealt table that one task has at most, and that a task of its own is worth.
MOST_ROWS, LEAST_ROWS = 20_000, 500


def dealt(rows: DataFrame) -> DataFrame:
    """Narrow rows, of which long work is made, dealt to all cores.

    One row group of a table may hold a million rows and is one task, however many cores there are. Tasks are in order of their
    rows, so that what numbers them finds the same order when a task is run again.
    """
    count = rows.count()
    tasks = max(min(math.ceil(count / LEAST_ROWS), 4 * rows.sparkSession.sparkContext.defaultParallelism), math.ceil(count / MOST_ROWS), 1)
    return rows.repartition(tasks).sortWithinPartitions(*rows.columns)
