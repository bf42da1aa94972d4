"""Structured Streaming: documents as they arrive, each text once, and counts of status events in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.functions import text as tx
from docloom.functions import tokens as tk


def read_documents(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """New Parquet files of (doc_id, text, source, arrived) in a folder, so many a batch."""
    return spark.readStream.schema("doc_id long, text string, source string, arrived timestamp").option("maxFilesPerTrigger", files).parquet(path)


def fresh_documents(docs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Cleaned documents, each content once within the delay; state older than the delay is dropped."""
    cleaned = docs.withColumn("text", tx.clean_text(F.col("text"))).filter(F.length("text") > 0)
    hashed = cleaned.withColumn("content_hash", tx.content_hash(F.col("text"))).withColumn("tokens", tk.char_tokens(F.col("text")))
    return hashed.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["content_hash"])


def status_counts(events: DataFrame, size: str = "1 hour", delay: str = "30 minutes") -> DataFrame:
    """Counts and sums of events a window and type; late events count until the watermark passes."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def start_ingest(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table until the folder is read; a restart goes on where the checkpoint stands."""
    return docs.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
