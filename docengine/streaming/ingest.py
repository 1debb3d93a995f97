"""Streaming forms of upsert and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docengine.operators.vectors import upsert_new
from docengine.plans.staging import exists


def distinct_arrivals(chunks: DataFrame, time: str = "indexed_at", late: str = "2 days") -> DataFrame:
    """Each chunk_id once while redeliveries come within the allowed lateness."""
    return chunks.withWatermark(time, late).dropDuplicatesWithinWatermark(["chunk_id"])


def stream_upsert(chunks: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append the chunks of each batch that the target lacks; a batch that is run again adds nothing."""

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # the target does not exist before the first batch; a read that fails for any other reason must fail here
        known = spark.read.parquet(target).select("chunk_id") if exists(spark, target) else batch.select("chunk_id").limit(0)
        upsert_new(batch, known).write.mode("append").parquet(target)

    return chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_counts(events: DataFrame, user: str = "user_id", time: str = "ts", gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """user, start, end, events of sessions that end after an hour without events."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("events")).select(user, "w.start", "w.end", "events")
