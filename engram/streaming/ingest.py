"""The fast path as Structured Streaming: append, exact-once materialisation, sessions, daily windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def fast_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends new events and stops when the source is drained; the checkpoint makes a rerun add nothing."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def deduplicated(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """The first event of a (user, content hash) within the watermark; state older than `late` goes."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "content_hash"])


def materialise(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch to `write(batch, id)`; writers key rows by event id, so a replayed batch changes nothing."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a bounded stream to its end into a folder and reads that: a complete result replaces the one before, others lie in a
    folder for each micro-batch, which is written anew if the batch is."""
    kind = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={0 if mode == 'complete' else number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(kind).parquet(f"{folder}/batch=*")
