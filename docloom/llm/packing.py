"""Packing of documents into fixed-length sequences: shortest-pack-first over the length histogram.

Every document becomes the ids of its text and one end id, cut into full pieces and one remainder.
The histogram of remainders has one entry a length, whatever the number of documents; packing places its lengths longest first, each on the packs filled least, and keeps patterns with counts.
Pieces then find their place by their rank among pieces of the same length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import tokens
from docloom.llm.common import materialise, partitions, slices

Pattern = tuple[tuple[int, ...], int]


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns (lengths in order of placing) and how often each is used.

    Lengths go longest first. A length goes on the packs with the fewest ids so far, if it fits there; what fits nowhere opens new packs, and a new pack takes as many pieces of that length as fit.
    Work depends on the number of lengths and patterns, not on the counts.
    """
    filled: dict[int, list[list]] = {}
    levels: list[int] = []

    def put(pattern: tuple[int, ...], used: int, count: int) -> None:
        if used not in filled:
            filled[used] = []
            insort(levels, used)
        for entry in filled[used]:
            if entry[0] == pattern:
                entry[1] += count
                return
        filled[used].append([pattern, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not levels or levels[0] + length > capacity:
                each = capacity // length
                for copies, count in ((each, left // each), (left % each, 1)):
                    if copies and count:
                        put((length,) * copies, length * copies, count)
                break
            used = levels[0]
            entries = filled[used]
            pattern, count = entries[-1]
            taken = min(left, count)
            if taken == count:
                entries.pop()
                if not entries:
                    del filled[used]
                    levels.pop(0)
            else:
                entries[-1][1] -= taken
            put((*pattern, length), used + length, taken)
            left -= taken
    return [(pattern, count) for used in levels for pattern, count in filled[used]]


def places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank of each run of pieces, the run's first sequence and its offset in the sequence."""
    out: dict[int, tuple[list, list, list]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            firsts, sequences, offsets = out.setdefault(length, ([], [], []))
            firsts.append(ranks.get(length, 0))
            sequences.append(sequence)
            offsets.append(offset)
            ranks[length] = ranks.get(length, 0) + count
            offset += length
        sequence += count
    return {k: tuple(np.asarray(x, dtype=np.int64) for x in v) for k, v in out.items()}


def place(found: tuple[np.ndarray, np.ndarray, np.ndarray], rank: int) -> tuple[int, int]:
    at = bisect_right(found[0], rank) - 1
    return int(found[1][at] + rank - found[0][at]), int(found[2][at])


def pieces(docs: DataFrame, capacity: int, end_id: int, path: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The pieces of every document: start, length, crc32 of their ids and the document's number of ids."""
    kept = ("doc_id", *extra)
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", start long, length long, ids_crc32 long, doc_tokens long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for batch in slices(batches):
            counts, ids = encoder.encode(batch["text"])
            ids = ids.astype("<u4", copy=False)
            ends = np.cumsum(counts)
            total = counts + 1
            n = -(-total // capacity)
            row = np.repeat(np.arange(len(n)), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * capacity
            length = np.minimum(capacity, total[row] - start)
            first = (ends - counts)[row] + start
            last = start + length == total[row]  # the last piece holds the end id
            view, tail, crc = memoryview(np.ascontiguousarray(ids)).cast("B"), np.array([end_id], dtype="<u4").tobytes(), zlib.crc32
            sums = [
                crc(tail, crc(view[4 * a : 4 * (a + k - 1)])) if z else crc(view[4 * a : 4 * (a + k)])
                for a, k, z in zip(first.tolist(), length.tolist(), last.tolist(), strict=True)
            ]
            took = [batch[c].take(pa.array(row)) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*took, pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(total[row])],
                names=[*kept, "start", "length", "ids_crc32", "doc_tokens"],
            )

    return docs.select(*kept, "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Pack every document's ids into sequences of at most ``capacity`` ids.

    One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text is its end id alone.
    Rows with the same doc_id are documents of their own; a null doc_id is kept; other columns are ignored. An empty table gives no rows.

    The driver sees the histogram of lengths (``capacity`` entries at most) and the patterns made from it.
    Equal lengths are ranked within parts dealt by a hash, so one frequent length does not meet in one task.
    """
    spark = docs.sparkSession
    parts = max(1, partitions(spark))
    cut = pieces(docs, capacity, end_id, path or tokens.default_path())
    cut = materialise(cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int")))
    groups = materialise(cut.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found = spark.sparkContext.broadcast(places(pack_histogram(histogram, capacity)))
    before = groups.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("own", F.row_number().over(order)).join(before.hint("merge"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("own") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        out = np.zeros((len(lengths), 2), dtype=np.int64)
        for k in np.unique(lengths):
            firsts, sequences, offsets = found.value[int(k)]
            own = np.flatnonzero(lengths == k)
            at = np.searchsorted(firsts, ranks[own], side="right") - 1
            out[own, 0], out[own, 1] = sequences[at] + ranks[own] - firsts[at], offsets[at]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", placed("length", "rank").alias("at")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset"
    )
