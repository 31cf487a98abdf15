"""Streams: file listings kept up to date by micro-batches, and windowed counts of events.

The reference semantics have no unbounded source; these are extensions on top of the
incremental target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylens.operators.incremental import IncrementalTarget, normal_path
from quarrylens.runtime import scratch_path


def keep_current(stream: DataFrame, target: IncrementalTarget, checkpoint: str, transform=None) -> StreamingQuery:
    """Feed a stream of listings (repo, path, hash, listed_at, ...) into a target; a batch that is run again adds nothing.

    The target should be made with ``order="listed_at"``, so that late rows never set a path back.
    """

    def apply(batch: DataFrame, _: int) -> None:
        target.sync(batch.withColumn("path", normal_path(F.col("path"))).withColumn("hash", F.lower("hash")), transform)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) of events by time, over a stream or a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = timed.withWatermark("ts", late) if timed.isStreaming else timed
    counted = marked.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, session_start, n): runs of a user's events with pauses shorter than ``gap``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    counted = timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


def run_stream(spark: SparkSession, path: str, schema, build) -> DataFrame:
    """Read the Parquet files at a place as a stream to its end and return what ``build`` makes of it, from the shared folder."""
    out = scratch_path(spark, "stream")
    source = spark.readStream.schema(schema).parquet(path)
    write = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    build(source).writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
