"""The life of a document while it is taken in: status events, late ones apart, replays without effect, timeouts.

Status events (doc_id, status, attempt, ts) come as a stream. Each batch is written under its number, over whatever an earlier try of the same batch left, so a replay changes nothing; the current state is the last event of each document over all batches. A batch's watermark comes from the batches before it, which a replay sees alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Statuses by how far they are; a later one of the same time and attempt wins.
ORDER = {"pending": 0, "processing": 1, "failed": 2, "completed": 3, "archived": 4}
EVENTS = "doc_id long, status string, attempt long, ts timestamp"
FINAL = ("completed", "failed", "archived")


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """New Parquet files of status events, so many a batch."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _before(spark: SparkSession, table: str, batch: int):
    """The latest time of the batches before, or null."""
    if not _there(spark, f"{table}/marks"):
        return None
    return spark.read.parquet(f"{table}/marks").filter(F.col("batch") < batch).agg(F.max("latest")).first()[0]


def store_batch(events: DataFrame, batch: int, table: str, delay: str = "1 hour") -> None:
    """Write a batch's events: those behind the watermark (the latest time of the batches before, less the delay) under ``late``, the others, one for each document and attempt, under ``events``.

    Events without a document or time are left out; of unknown statuses nothing is known, so they are left out too. Every folder of the batch is written over, so it can be given again.
    """
    spark = events.sparkSession
    latest = _before(spark, table, batch)
    rows = events.filter(F.col("doc_id").isNotNull() & F.col("ts").isNotNull() & F.col("status").isin(*ORDER)).select("doc_id", "status", F.coalesce("attempt", F.lit(0)).alias("attempt"), "ts")
    behind = F.lit(False) if latest is None else F.col("ts") < F.lit(latest) - F.expr(f"INTERVAL {delay}")
    split = rows.withColumn("late", behind)
    kept = split.filter(~F.col("late")).groupBy("doc_id", "attempt").agg(F.max(F.struct("ts", _rank(), "status")).alias("x")).select("doc_id", "attempt", "x.status", "x.ts")
    kept.write.mode("overwrite").parquet(f"{table}/events/batch={batch}")
    split.filter("late").drop("late").write.mode("overwrite").parquet(f"{table}/late/batch={batch}")
    rows.agg(F.max("ts").alias("latest"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{table}/marks/batch={batch}")


def _rank():
    return F.element_at(F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair]), F.col("status")).alias("rank")


def current(spark: SparkSession, table: str, timeout: str = "6 hours") -> DataFrame:
    """(doc_id, status, attempt, ts, n_events): the last event of each document, by attempt, time and progress. A document still pending or in work that long before the latest time of all has the status ``timed_out``."""
    rows = spark.read.parquet(f"{table}/events")
    now = spark.read.parquet(f"{table}/marks").agg(F.max("latest").alias("now"))
    last = rows.groupBy("doc_id").agg(F.max(F.struct("attempt", "ts", _rank(), "status")).alias("x"), F.count("*").alias("n_events")).select("doc_id", "x.status", "x.attempt", "x.ts", "n_events")
    stuck = ~F.col("status").isin(*FINAL) & (F.col("ts") < F.col("now") - F.expr(f"INTERVAL {timeout}"))
    return last.crossJoin(F.broadcast(now)).select("doc_id", F.when(stuck, "timed_out").otherwise(F.col("status")).alias("status"), "attempt", "ts", "n_events")


def late_counts(spark: SparkSession, table: str) -> DataFrame:
    """(status, n) of late events."""
    return spark.read.parquet(f"{table}/late").groupBy("status").agg(F.count("*").alias("n"))


def start(events: DataFrame, table: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Store a stream of events until it is read; a restart goes on where the checkpoint stands."""
    return events.writeStream.foreachBatch(lambda rows, batch: store_batch(rows, batch, table, delay)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


LIFE = "doc_id long, outcome string, attempts long, seconds double"


def outcomes(events: DataFrame, delay: str = "1 hour", timeout_seconds: int = 6 * 3600) -> DataFrame:
    """(doc_id, outcome, attempts, seconds) as documents end, from state held for each document: completed, failed or archived with the time since its first event, or ``timed_out`` once the watermark is ``timeout_seconds`` past its last one.

    Events of a batch are taken in order of time. State goes with the outcome, so it is bounded by the documents in work.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, last, attempts = state.get
            state.remove()
            yield pd.DataFrame({"doc_id": [key[0]], "outcome": ["timed_out"], "attempts": [attempts], "seconds": [(last - first) / 1e3]})
            return
        rows = pd.concat(list(frames)).sort_values("ts")
        first, last, attempts = state.get if state.exists else (int(rows["ts"].iloc[0].timestamp() * 1e3), 0, 0)
        last = max(last, int(rows["ts"].iloc[-1].timestamp() * 1e3))
        attempts = max(attempts, int(rows["attempt"].fillna(0).max()))
        ended = rows[rows["status"].isin(FINAL)]
        if len(ended):
            if state.exists:
                state.remove()
            end = int(ended["ts"].iloc[-1].timestamp() * 1e3)
            yield pd.DataFrame({"doc_id": [key[0]], "outcome": [ended["status"].iloc[-1]], "attempts": [attempts], "seconds": [(end - first) / 1e3]})
            return
        state.update((first, last, attempts))
        state.setTimeoutTimestamp(max(last + timeout_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    keyed = events.filter("doc_id IS NOT NULL").withWatermark("ts", delay).groupBy("doc_id")
    return keyed.applyInPandasWithState(step, LIFE, "first long, last long, attempts long", "append", GroupStateTimeout.EventTimeTimeout)
