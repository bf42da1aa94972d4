"""Trees built from ordered rows: ranks, nearest lower levels, balanced trees and subtree intervals, over groups of any size.

Rows are dealt by ranges of (group, order), so a large group lies in many tasks. A task ranks its rows and finds, with a stack, the nearest row before each that has a lower level. What it leaves on the stack (one row a level at most) and the sizes of its first and last group are all that the next ranges need: the driver chains these few rows a range, and one broadcast row a range completes the rows whose group began before it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from docloom.scratch import written

#: Rows of a bucket of running sums.
BUCKET = 1 << 16


def _sweep(group: str, key: str, level: str, closed: bool):
    """Ranks and nearest lower levels of a range's rows; the range is held in memory as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        n = rows.num_rows
        codes = np.asarray(rows[group].combine_chunks().dictionary_encode("encode").indices)
        new = np.concatenate(([True], codes[1:] != codes[:-1]))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        first = np.repeat(starts, sizes)
        levels = np.asarray(rows[level]).tolist()
        above, depths, lows, stack, low = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64), [0] * n, [], 0
        fresh = new.tolist()
        for i, own in enumerate(levels):
            if fresh[i]:
                stack, low = [], own
            low = min(low, own)
            while stack and (levels[stack[-1]] > own if closed else levels[stack[-1]] >= own):
                stack.pop()
            if stack:
                above[i] = stack[-1]
            depths[i], lows[i] = len(stack), low
            stack.append(i)
        on_stack, edge = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        on_stack[stack] = True
        edge[[starts[-1], 0]] = True
        parent = rows[key].combine_chunks().take(pa.array(np.where(above < 0, 0, above), mask=above < 0))
        extra = {
            "rank": pa.array(np.arange(n) - first), "total": pa.array(np.repeat(sizes, sizes)), "parent": parent, "__depth": pa.array(depths), "__low": pa.array(lows, pa.int64()), "__part": pa.array(np.full(n, TaskContext.get().partitionId(), dtype=np.int32)),
            "__first": pa.array(first == 0), "__last": pa.array(first == starts[-1]), "__held": pa.array(on_stack), "__edge": pa.array(edge),
        }
        for name, column in extra.items():
            rows = rows.append_column(name, column)
        yield from rows.to_batches(max_chunksize=10_000)

    return run


def _chained(ends: list, group: str, key: str, level: str, closed: bool) -> list[tuple]:
    """(part, offset, stack, total of the first group, total of the last group) of every range, from its stack and group sizes."""
    by: dict[int, list] = {}
    for r in ends:
        by.setdefault(r["__part"], []).append(r)
    totals: dict = {}
    out, current, stack, count = [], (), [], 0
    for part in sorted(by):
        rows = sorted(by[part], key=lambda r: r["rank"])
        first = next(r for r in rows if r["__edge"] and r["__first"])
        last = next(r for r in rows if r["__edge"] and r["__last"])
        same = current == (first[group],)
        offset, carried = (count, stack) if same else (0, [])
        out.append([part, offset, carried, first[group], last[group]])
        totals[first[group]] = totals.get(first[group], 0) + first["total"]
        own = [(r[level], r[key]) for r in rows if r["__held"]]
        if first["__last"]:
            low = min(x for x, _ in own)
            stack, count = [x for x in carried if x[0] < low or closed and x[0] == low] + own, offset + first["total"]
        else:
            totals[last[group]] = totals.get(last[group], 0) + last["total"]
            stack, count = own, last["total"]
        current = (last[group],)
    return [(part, offset, carried, totals[a], totals[b]) for part, offset, carried, a, b in out]


def swept(rows: DataFrame, group: str, order: Sequence[str | Column], key: str, level: str, closed: bool = False, ranges: int = 0) -> DataFrame:
    """The rows with ``rank`` (from 0) and ``total`` in their group by ``order``, ``parent``: the key of the nearest row before of a lower level (with ``closed`` of a lower or equal one), null without one, and ``above``: the number of parents one over the other.

    Levels must not be null; the order of rows that tie in ``order`` is not defined. A null group is a group.
    """
    spark, names = rows.sparkSession, rows.columns
    n = max(ranges, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = rows.schema[key].dataType
    schema = StructType(list(rows.schema.fields)).add("rank", LongType()).add("total", LongType()).add("parent", kind).add("__depth", LongType()).add("__low", LongType()).add("__part", IntegerType())
    for flag in ("__first", "__last", "__held", "__edge"):
        schema = schema.add(flag, BooleanType())
    dealt = rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    local = written(dealt.mapInArrow(_sweep(group, key, level, closed), schema))
    ends = local.filter("__held OR __edge").select(group, key, level, "rank", "total", "__part", "__first", "__last", "__held", "__edge").collect()
    types = f"__part int, __offset long, __stack array<struct<level:{rows.schema[level].dataType.simpleString()},key:{kind.simpleString()}>>, __t0 long, __t1 long"
    carry = spark.createDataFrame(_chained(ends, group, key, level, closed), types)
    whole = local.join(F.broadcast(carry), "__part")
    lower = F.filter("__stack", lambda x: (x["level"] <= F.col(level)) if closed else (x["level"] < F.col(level)))
    # Of the rows left by earlier ranges those still count that no row of this one has ended.
    left = F.size(F.filter("__stack", lambda x: (x["level"] <= F.col("__low")) if closed else (x["level"] < F.col("__low"))))
    before = F.when(F.col("__first"), F.get(lower, F.size(lower) - 1)["key"])
    return whole.select(
        *names,
        (F.col("rank") + F.when(F.col("__first"), F.col("__offset")).otherwise(0)).alias("rank"),
        F.when(F.col("__first"), F.col("__t0")).when(F.col("__last"), F.col("__t1")).otherwise(F.col("total")).alias("total"),
        F.coalesce("parent", before).alias("parent"),
        (F.col("__depth") + F.when(F.col("__first"), left).otherwise(0)).alias("above"),
    )


def outline_parents(rows: DataFrame, ranges: int = 0) -> DataFrame:
    """(tree, line, level, parent) of (tree, line, level): in line order, the nearest line before of a lower level."""
    return swept(rows.select("tree", "line", "level"), "tree", ["line"], "line", "level", ranges=ranges).select("tree", "line", "level", "parent")


def depth_first_parents(rows: DataFrame, ranges: int = 0) -> DataFrame:
    """(tree, line, level, parent) of (tree, line, level): as a stack places them that takes rows by level, then by line. So the parent is the last line of the nearest lower level there is; rows of the lowest level are roots, under one made-up root where there are several."""
    return swept(rows.select("tree", "line", "level"), "tree", ["level", "line"], "line", "level", ranges=ranges).select("tree", "line", "level", "parent")


def _descent(rank: Column, total: Column) -> Column:
    """(low, high, above, side, depth) of a rank in the tree whose root is the middle of its range, halves below it likewise."""
    start = F.struct(F.lit(0).cast("long").alias("low"), total.alias("high"), F.lit(None).cast("long").alias("above"), F.lit(None).cast("string").alias("side"), F.lit(0).cast("long").alias("depth"))

    def step(at: Column, _: Column) -> Column:
        middle = at["low"] + F.floor((at["high"] - at["low"]) / 2)
        left = F.struct(at["low"].alias("low"), middle.alias("high"), middle.alias("above"), F.lit("left").alias("side"), (at["depth"] + 1).alias("depth"))
        right = F.struct((middle + 1).alias("low"), at["high"].alias("high"), middle.alias("above"), F.lit("right").alias("side"), (at["depth"] + 1).alias("depth"))
        return F.when(rank < middle, left).when(rank > middle, right).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.floor(F.log2(total)).cast("int")), start, step)


def balanced_parents(rows: DataFrame, ranges: int = 0) -> DataFrame:
    """(tree, line, parent, side, depth) of (tree, line): the balanced binary tree over the lines of a tree in order, the middle one of a range above the middles of its halves.

    A row finds its place by halving its tree's range as often as the tree is deep; only ranks and lines are joined.
    """
    numbered = swept(rows.select("tree", "line", F.lit(0).alias("level")), "tree", ["line"], "line", "level", ranges=ranges).select("tree", "line", "rank", "total")
    placed = written(numbered.withColumn("at", _descent(F.col("rank"), F.col("total"))).select("tree", "line", "rank", "at.above", "at.side", "at.depth"))
    up = placed.select(F.col("tree").alias("__tree"), F.col("rank").alias("__rank"), F.col("line").alias("parent"))
    return placed.join(up, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("above") == F.col("__rank")), "left").select("tree", "line", "parent", "side", "depth")


def rebalanced(nodes: DataFrame, ranges: int = 0) -> DataFrame:
    """:func:`balanced_parents` of a tree's own elements (tree, node, line): made-up nodes, which have no line, go."""
    return balanced_parents(nodes.filter("line IS NOT NULL").select("tree", "line"), ranges)


def subtree_intervals(found: DataFrame, ranges: int = 0) -> DataFrame:
    """(node, depth, first, behind) from the paths of a forest (node, depth, places): a subtree is the nodes of pre-order ranks from ``first`` up to, not with, ``behind``.

    It ends at the next node in pre-order that is no deeper than its root, which is the nearest such row before it in reverse order.
    """
    rows = found.select("node", "depth", "places", F.lit(0).alias("__all"))
    ranked = written(swept(rows, "__all", ["places"], "node", "depth", ranges=ranges).select("__all", "node", "depth", "rank", "total"))
    back = ranked.select("__all", "node", "depth", F.col("rank").alias("at"), (-F.col("rank")).alias("back"), F.col("total").alias("n"))
    ends = swept(back, "__all", ["back"], "at", "depth", closed=True, ranges=ranges)
    return ends.select("node", "depth", F.col("at").alias("first"), F.coalesce("parent", "n").alias("behind"))


def running_sums(rows: DataFrame, at: str, values: dict[str, Column]) -> DataFrame:
    """(at, one column a value): for each place the sum of the values at lower places. Places are whole numbers from 0 on, and dealt in buckets of 65,536; a bucket's start comes from the buckets' sums, a few rows."""
    bucket = F.floor(F.col(at) / BUCKET).alias("__bucket")
    own = rows.select(F.col(at), bucket, *[v.cast("long").alias(k) for k, v in values.items()])
    sums = own.groupBy("__bucket").agg(*[F.sum(k).alias(k) for k in values])
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__bucket", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"__s_{k}") for k in values])
    inside = Window.partitionBy("__bucket").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    local = own.select(at, "__bucket", *[F.coalesce(F.sum(k).over(inside), F.lit(0)).alias(k) for k in values])
    return local.join(starts, "__bucket").select(at, *[(F.col(k) + F.col(f"__s_{k}")).alias(k) for k in values])


def subtree_sums(spans: DataFrame, rows: DataFrame, values: dict[str, Column], key: str = "node") -> DataFrame:
    """(node, one column a value): the sum of each value over every subtree, by differences of running sums at the ends of its interval.

    ``spans`` is the result of :func:`subtree_intervals`, ``rows`` has a row a node. Two joins on ranks, however deep the tree.
    """
    placed = written(spans.join(rows.select(F.col(key).alias("node"), *[v.cast("long").alias(k) for k, v in values.items()]), "node", "left").na.fill(0, list(values)))
    up_to = written(running_sums(placed, "first", {k: F.col(k) for k in values}))
    whole = placed.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(f"__w_{k}") for k in values])
    start = up_to.select(F.col("first"), *[F.col(k).alias(f"__a_{k}") for k in values])
    end = up_to.select(F.col("first").alias("behind"), *[F.col(k).alias(f"__b_{k}") for k in values])
    joined = placed.select("node", "first", "behind").join(start, "first").join(end, "behind", "left").crossJoin(F.broadcast(whole))
    return joined.select("node", *[(F.coalesce(F.col(f"__b_{k}"), F.col(f"__w_{k}")) - F.col(f"__a_{k}")).alias(k) for k in values])


def subtree_kinds(spans: DataFrame, rows: DataFrame, kinds: Sequence[str], key: str = "node", kind: str = "kind") -> DataFrame:
    """(node, kinds): for every subtree how often each kind of node occurs in it, as a map without zeros. ``kinds`` names all of them; a node of another kind, or null, counts nowhere."""
    names = {f"k{i}": F.when(F.col(kind) == k, 1).otherwise(0) for i, k in enumerate(kinds)}
    sums = subtree_sums(spans, rows, names, key)
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"k{i}").alias("value")) for i, k in enumerate(kinds)]), lambda x: x["value"] > 0)
    return sums.select("node", F.map_from_entries(pairs).alias("kinds"))


def subtree_texts(spans: DataFrame, rows: DataFrame, key: str = "node", text: str = "text") -> DataFrame:
    """(node, start, length): where a subtree's text lies in the forest's texts joined by line ends in pre-order. So every subtree's full text is a slice of one ordered text, and none is put together a node at a time."""
    sums = subtree_sums(spans, rows, {"length": F.length(F.coalesce(F.col(text), F.lit(""))) + 1}, key)
    lengths = spans.join(rows.select(F.col(key).alias("node"), (F.length(F.coalesce(F.col(text), F.lit(""))) + 1).alias("own")), "node", "left")
    starts = running_sums(lengths, "first", {"start": F.coalesce("own", F.lit(1))})
    return spans.select("node", "first").join(starts, "first").join(sums, "node").select("node", "start", (F.col("length") - 1).alias("length"))


def with_changes(summaries: DataFrame, found: DataFrame, changed: DataFrame, values: Sequence[str]) -> DataFrame:
    """The summaries (node, one column a value) after some nodes changed (node, one column a value: what is added): the changed nodes' ancestors get new sums, all others pass as they are.

    ``found`` has the paths of the forest; only those of changed nodes are opened, and nothing is summed anew.
    """
    moved = changed.groupBy("node").agg(*[F.sum(F.col(k).cast("long")).alias(k) for k in values])
    up = moved.join(found.select("node", "path"), "node").select(F.explode("path").alias("node"), *values)
    deltas = up.groupBy("node").agg(*[F.sum(k).alias(f"__d_{k}") for k in values])
    return summaries.join(deltas, "node", "left").select("node", *[(F.col(k) + F.coalesce(F.col(f"__d_{k}"), F.lit(0))).alias(k) for k in values])


def node_summary(found: DataFrame, spans: DataFrame) -> DataFrame:
    """(node, depth, height, is_leaf, is_root, child_count, subtree_size, leaf_count, max_child_depth, path_length, sibling_count, balance_factor) of every node of a forest.

    Sizes and leaf counts come from the intervals; the greatest depth below a node from the paths of leaves alone. Balance is the difference of the greatest and the least height among the children, over the greatest; 0 where that is 0, and for leaves. A root has no siblings.
    """
    above = F.get("path", F.size("path") - 2)
    rows = written(found.select("node", "depth", "path", F.when(F.size("path") > 1, above).alias("above")))
    children = rows.filter("above IS NOT NULL").groupBy(F.col("above").alias("node")).agg(F.count("*").alias("child_count"))
    with_children = written(rows.join(children, "node", "left").na.fill(0, ["child_count"]))
    leaves = with_children.filter("child_count = 0")
    deepest = leaves.select(F.explode("path").alias("node"), F.col("depth").alias("d")).groupBy("node").agg(F.max("d").alias("max_child_depth"))
    counts = subtree_sums(spans, with_children, {"leaf_count": F.when(F.col("child_count") == 0, 1).otherwise(0)})
    own = written(with_children.select("node", "depth", "above", "child_count").join(deepest, "node").join(counts, "node").join(spans.select("node", (F.col("behind") - F.col("first")).alias("subtree_size")), "node").withColumn("height", F.col("max_child_depth") - F.col("depth")))
    heights = own.filter("above IS NOT NULL").groupBy(F.col("above").alias("node")).agg(F.min("height").alias("low"), F.max("height").alias("high"), F.count("*").alias("n"))
    siblings = heights.select(F.col("node").alias("above"), (F.col("n") - 1).alias("sibling_count"))
    balance = F.when(F.col("high") > 0, (F.col("high") - F.col("low")) / F.col("high")).otherwise(0.0)
    out = own.join(heights, "node", "left").join(siblings, "above", "left")
    return out.select(
        "node", "depth", "height", (F.col("child_count") == 0).alias("is_leaf"), F.col("above").isNull().alias("is_root"), "child_count", "subtree_size", "leaf_count", "max_child_depth",
        (F.col("depth") + 1).alias("path_length"), F.coalesce("sibling_count", F.lit(0)).alias("sibling_count"), F.round(F.coalesce(balance, F.lit(0.0)), 6).alias("balance_factor"),
    )


def section_texts(docs: DataFrame, found: DataFrame, ranges: int = 0) -> DataFrame:
    """(doc_id, line_number, start, end, content): each element's text with that of all elements below it, a slice of its document from its own line to the next element that is no lower.

    Elements are (doc_id, line_number, start_char, level).
    """
    back = found.select("doc_id", "line_number", F.col("start_char").cast("long").alias("start"), F.col("level").cast("int").alias("level"), (-F.col("line_number")).alias("back"))
    ends = swept(back, "doc_id", ["back"], "start", "level", closed=True, ranges=ranges)
    spans = ends.join(docs.select("doc_id", "text"), "doc_id").withColumn("end", F.coalesce("parent", F.length("text").cast("long")))
    return spans.select("doc_id", "line_number", "start", "end", F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("content"))
