"""Document tables: listings, upserts, deletes, statistics, duplicates, sessions, merging of short documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions import tokens as tk
from docloom.functions import vectors
from docloom.scratch import written


def with_counts(docs: DataFrame, chunks: DataFrame, tenant: str | None = None) -> DataFrame:
    """A tenant's documents with their number of chunks."""
    own = docs if tenant is None else docs.filter(F.col("tenant") == tenant)
    return own.join(chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks")), "doc_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with ``rows`` in place of those of the same keys."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def delete_cascade(docs: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without the documents in ``gone`` (doc_id)."""
    return docs.join(gone.select("doc_id"), "doc_id", "left_anti"), chunks.join(gone.select("doc_id"), "doc_id", "left_anti")


def statistics(docs: DataFrame, *groups: str) -> DataFrame:
    n = F.length("text")
    return docs.groupBy(*groups).agg(
        F.count("*").alias("n_docs"), F.sum(n).alias("total_chars"), F.sum(tk.char_tokens(F.col("text"))).alias("total_tokens"), F.round(F.avg(n), 4).alias("avg_chars"), F.min(n).cast("long").alias("min_chars"), F.max(n).cast("long").alias("max_chars")
    )


def detail_and_total(docs: DataFrame) -> DataFrame:
    """Token totals by language and source, by language, and of all: one pass with grouping sets."""
    rows = docs.select("lang", "source", tk.char_tokens(F.col("text")).alias("tokens"))
    return rows.rollup("lang", "source").agg(F.sum("tokens").alias("total_tokens"), F.count("*").alias("n_docs"), F.grouping_id().cast("long").alias("level"))


def line_statistics(docs: DataFrame) -> DataFrame:
    lines = F.split("text", "\n", -1)
    size = F.transform(lines, F.length)
    return docs.select(
        "doc_id", F.length("text").cast("long").alias("char_count"), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long").alias("word_count"), F.size(lines).cast("long").alias("line_count"),
        F.size(F.filter(lines, lambda x: F.trim(x) == "")).cast("long").alias("empty_lines"), F.array_max(size).cast("long").alias("max_line_length"),
        F.round(F.aggregate(size, F.lit(0), lambda s, x: s + x) / F.size(lines), 6).alias("avg_line_length"),
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(content_hash, n_docs, first_doc) of texts that occur more than once."""
    return docs.groupBy(tx.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).filter("n_docs > 1")


def redundant(pairs: DataFrame, at_least: float = 0.95) -> DataFrame:
    """Pairs (a, b, ea, eb) of vectors whose cosine is at least the threshold."""
    return pairs.withColumn("similarity", F.round(vectors.cosine(F.col("ea"), F.col("eb")), 6)).filter(F.col("similarity") >= at_least).select("a", "b", "similarity")


def recent_sessions(turns: DataFrame, most: int = 20) -> DataFrame:
    """The latest sessions by their last id: (conv_id, n_messages, title); the title is the first 50 characters of the first user message."""
    title = F.min_by(F.when(F.col("role") == "user", F.left(F.trim("text"), F.lit(50))), F.when(F.col("role") == "user", F.col("turn")))
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_messages"), title.alias("title")).orderBy(F.desc("conv_id")).limit(most)


def numbered_messages(turns: DataFrame) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    return turns.select("conv_id", "turn", "role", (F.row_number().over(order) - 1).cast("long").alias("message_index"), F.lag("role").over(order).alias("previous_role"))


def latest_status(events: DataFrame) -> DataFrame:
    """Each user's last event."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("since"), F.count("*").alias("n_events"))


#: No run of short documents is open; else a state is the open run's length so far.
NOTHING = -1


def _ending(rows: pd.DataFrame, least: int) -> pd.DataFrame:
    """A range's first and last group, and for each state before it the state behind it and the place where the run that is open there began (none: before the range)."""
    rows = rows.sort_values("pos")
    groups, sizes, places = rows["group"].tolist(), rows["n"].tolist(), rows["pos"].tolist()
    states, began = np.arange(NOTHING, least), np.full(least + 1, NOTHING)
    for i, n in enumerate(sizes):
        if i and groups[i] != groups[i - 1]:
            states = np.full(least + 1, NOTHING)
        began = np.where(states == NOTHING, places[i], began)
        total = np.maximum(states, 0) + n
        states = np.where((n >= least) | (total >= least), NOTHING, total)
    return pd.DataFrame({"part": rows["part"].iloc[:1], "first": groups[:1], "last": groups[-1:], "states": [states.tolist()], "began": [began.tolist()]})


def _numbered(before: dict[int, tuple[int, int, int]], least: int):
    """A range's rows with their run (range and place of its first row), given the state and the open run before the range."""

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        part = int(rows["part"].iloc[0])
        state, *run = before[part]
        groups, runs = rows["group"].tolist(), []
        for i, (n, pos) in enumerate(zip(rows["n"].tolist(), rows["pos"].tolist(), strict=True)):
            if i and groups[i] != groups[i - 1]:
                state = NOTHING
            if state == NOTHING or n >= least:
                run = [part, pos]
            runs.append(tuple(run))
            total = max(state, 0) + n
            state = NOTHING if n >= least or total >= least else total
        out = rows[["group", "doc_id", "text", "part", "pos", "n"]].copy()
        out["run_part"], out["run_pos"] = zip(*runs, strict=True)
        return out

    return number


def merge_short(docs: DataFrame, least: int = 100, group: str = "source", ranges: int = 0) -> DataFrame:
    """(group, first_doc, n_docs, text): short documents of a group joined in the order of doc_id until they reach the least length; a long one closes the run before it.

    Rows are dealt by ranges of (group, doc_id), so a large group lies in many tasks. How a range ends hangs on the length of the run that is open where it begins, one of ``least`` states: a pass over lengths gives each range's ending for every state, the driver chains these rows, one a range, and a second pass numbers the runs. Texts of short documents alone are then brought together, by run.
    A null text counts as empty. Documents with one doc_id in a group may go in any order.
    """
    spark = docs.sparkSession
    n = max(ranges, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col(group).cast("string").alias("group"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.length(text).cast("long").alias("n"))
    sorted_rows = rows.repartitionByRange(n, "group", "doc_id").sortWithinPartitions("group", "doc_id")
    dealt = written(sorted_rows.withColumn("id", F.monotonically_increasing_id()).select("*", F.spark_partition_id().alias("part"), F.col("id").alias("pos")).drop("id"))
    kinds = "part int, first string, last string, states array<long>, began array<long>"
    ends = dealt.select("part", "pos", "group", "n").groupBy("part").applyInPandas(lambda x: _ending(x, least), kinds).collect()
    before, state, run, current = {}, NOTHING, (0, 0), ()
    for r in sorted(ends, key=lambda r: r["part"]):
        if current != (r["first"],):
            state = NOTHING
        before[r["part"]] = (state, *run)
        began = r["began"][state - NOTHING]
        run = run if began == NOTHING else (r["part"], began)
        state, current = r["states"][state - NOTHING], (r["last"],)
    # Ids pass pandas as text, which keeps nulls and large numbers.
    texts = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))
    numbered = texts.groupBy("part").applyInPandas(_numbered(before, least), "group string, doc_id string, text string, part int, pos long, n long, run_part int, run_pos long")
    numbered = written(numbered.withColumn("doc_id", F.col("doc_id").cast("long")))
    long = numbered.filter(F.col("n") >= least).select("group", F.col("doc_id").alias("first_doc"), F.lit(1).cast("long").alias("n_docs"), "text")
    short = numbered.filter(F.col("n") < least).groupBy("group", "run_part", "run_pos").agg(F.array_sort(F.collect_list(F.struct("part", "pos", "doc_id", "text"))).alias("x"))
    joined = short.select("group", F.get("x.doc_id", F.lit(0)).alias("first_doc"), F.size("x").cast("long").alias("n_docs"), F.array_join("x.text", "\n\n").alias("text"))
    return long.unionByName(joined)
