"""Sharding by histogram sort: splitters of a total order are found by counting exact bytes, then rows move once.

The order is (hash of the text, doc_id), so equal texts lie side by side. Every round counts the bytes below a bounded list of probe keys in one pass and narrows each splitter's interval, until every splitter lies within the tolerance.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialise, partitions

Key = tuple[int, int]
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _cut(keys: list[Key]):
    """A Spark function: how many of the keys are at or below a row's (hash, id)."""
    whole = np.array([k[0] for k in keys], dtype=np.int64), np.array([k[1] for k in keys], dtype=np.int64)

    @F.pandas_udf("int")
    def cut(h: pd.Series, i: pd.Series) -> pd.Series:
        a, b = h.to_numpy(), i.to_numpy()
        out = np.searchsorted(whole[0], a, side="left")
        for at in np.flatnonzero(np.isin(a, whole[0])):
            out[at] = bisect_right(keys, (int(a[at]), int(b[at])))
        return pd.Series(out.astype(np.int32))

    return cut("__h", "__i") if keys else F.lit(0)


def _bytes_below(keyed: DataFrame, probes: list[Key]) -> list[int]:
    """Exact bytes below each probe key: one aggregation, a row for each probe at most."""
    sums = {r["__bin"]: r["n"] for r in keyed.groupBy(_cut(probes).alias("__bin")).agg(F.sum("__size").alias("n")).collect()}
    out, total = [], 0
    for at in range(len(probes)):
        total += sums.get(at, 0)
        out.append(total)
    return out


def _between(low: Key, high: Key, n: int) -> list[Key]:
    """Up to n keys spread over (low, high]: by hash, or by id within one hash."""
    if high[0] - low[0] > 1:
        step = max(1, (high[0] - low[0]) // (n + 1))
        return sorted({(h, LOW) for k in range(1, n + 1) if low[0] < (h := low[0] + k * step) <= high[0]})
    points = [(low[0], low[1], high[1] if high[0] == low[0] else HIGH)]
    if high[0] > low[0]:
        points.append((high[0], LOW, high[1]))
    out = {(high[0], LOW)} if high[0] > low[0] else set()
    for h, a, b in points:
        step = max(1, (b - a) // (n + 1))
        out |= {(h, x) for k in range(1, n + 1) if (h, x := a + k * step) > low and (h, x) <= high and x <= b}
    return sorted(out)


#: How far a range's splitter may lie from its place, as a share of the range; probes counted in a round at most.
RANGE_TOLERANCE, MOST_PROBES = 0.25, 1 << 18


def find_splitters(keyed: DataFrame, shards: int, tolerance: float, probes_each: int = 24) -> list[Key]:
    """Keys that cut the rows into shards of near-equal bytes, and no group of equal texts if the tolerance allows.

    ``keyed`` has __h, __i and __size. Each splitter's bytes below are within ``tolerance`` of a shard of its target, or the interval can't be narrowed: then one (hash, id) holds more bytes than that.
    """
    total = keyed.agg(F.sum("__size")).first()[0] or 0
    targets = [total * k / shards for k in range(1, shards)]
    spans = [((LOW, LOW), 0, (HIGH, HIGH), total) for _ in targets]
    slack = tolerance * total / shards
    chosen: list[Key | None] = [None] * len(targets)
    while any(c is None for c in chosen):
        probes = sorted({p for c, (a, _, b, _) in zip(chosen, spans, strict=True) if c is None for p in _between(a, b, probes_each)})
        below = _bytes_below(keyed, probes)
        for k, target in enumerate(targets):
            if chosen[k] is not None:
                continue
            low, at_low, high, at_high = spans[k]
            was = spans[k]
            for p, n in zip(probes, below, strict=True):
                if n <= target and p > low:
                    low, at_low = p, n
                if n >= target and p < high:
                    high, at_high = p, n
                    break
            spans[k] = low, at_low, high, at_high
            whole = [(abs(n - target), p) for p, n in ((low, at_low), (high, at_high)) if p[1] == LOW or p[0] == HIGH]
            best = min(whole, default=(slack + 1, None)) if low[0] + 1 < high[0] else min((abs(at_low - target), low), (abs(at_high - target), high))
            if best[0] <= slack:
                chosen[k] = best[1]
            elif spans[k] == was:
                chosen[k] = min((abs(at_low - target), low), (abs(at_high - target), high))[1]
    return sorted(c for c in chosen if c is not None)


def shard_rows(docs: DataFrame, shards: int = 8, tolerance: float = 0.01, parts: int | None = None) -> DataFrame:
    """Put every row in a shard so that shards hold near-equal bytes; all columns stay and size, shard and slot are added.

    A row's size is the UTF-8 bytes of its text (null: none) plus 1. Slots count from 0 in each shard, in the order (hash of the text, doc_id).
    Equal texts lie side by side; a splitter falls inside a group of them only where the group is too large for the tolerance. Rows equal in text and doc_id stay together; a null doc_id orders first and null texts are one group. An empty table gives no rows.
    Every shard is cut into ``parts`` ranges of near-equal bytes, the units of the one exchange; their counts give the slots' offsets. Left out, a range has about a gigabyte, but a shard 16 ranges at least and 4,096 at most, since the driver holds their splitters.
    """
    keyed = docs.withColumns({"__h": F.coalesce(F.xxhash64("text"), F.lit(0)), "__i": F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW + 1)), "__size": _size()})
    keys = materialise(keyed.select("__h", "__i", "__size"))
    if parts is None:
        parts = min(4096, max(16, -(-(keys.agg(F.sum("__size")).first()[0] or 0) // (shards << 30))))
    fine = find_splitters(keys, shards * parts, RANGE_TOLERANCE, max(2, min(24, MOST_PROBES // (shards * parts))))
    edges = find_splitters(keys, shards, tolerance)
    cuts = sorted({*fine, *edges})
    rank = {p: bisect_right(edges, cuts[p - 1]) if p else 0 for p in range(len(cuts) + 1)}
    counts = {r["__range"]: r["n"] for r in keys.groupBy(_cut(cuts).alias("__range")).agg(F.count("*").alias("n")).collect()}
    first, held = [], {}
    for p in range(len(cuts) + 1):
        first.append((p, rank[p], held.get(rank[p], 0)))
        held[rank[p]] = held.get(rank[p], 0) + counts.get(p, 0)
    table = docs.sparkSession.createDataFrame(first, "__range int, __shard int, __first long")
    order = Window.partitionBy("__range").orderBy("__h", "__i")
    out = keyed.withColumn("__range", _cut(cuts)).withColumn("__own", F.row_number().over(order)).join(F.broadcast(table), "__range")
    added = {"size": F.col("__size"), "shard": F.col("__shard"), "slot": F.col("__first") + F.col("__own") - 1}
    return out.select(*[F.col(c) for c in docs.columns if c not in added], *[v.alias(k) for k, v in added.items()])


def _size() -> Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, its files and their rows in slot order: ranges of (shard, slot) are the units, so a shard is written by many tasks."""
    sharded.repartitionByRange(partitions(sharded.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
