r"""Windowed counts and line metrics over streams (extensions).

The same transformations run on batches and on streams; a stream's state is bounded by its watermark. A
checkpoint location is the caller's, in shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import text as T


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, events, total): counts by event time; rows later than ``late`` are dropped by a stream only."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def file_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def line_metrics(docs: DataFrame) -> DataFrame:
    """Line metrics of a stream or table of texts; stateless."""
    t = F.col("text")
    return docs.select("doc_id", T.line_count(t).alias("n_lines"), T.blank_lines(t).alias("n_blank"), T.nonempty_lines(t).alias("n_nonempty"))


def write_stream(df: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all that is there as Parquet, then end."""
    return df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(folder)
