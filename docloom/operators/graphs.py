"""Relationship graphs as tables of edges (source, target, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.scratch import written

#: What a relation is called the other way round; others keep their name.
REVERSE = {"parent_child": "child_parent", "child_parent": "parent_child", "references": "referenced_by", "referenced_by": "references", "follows": "precedes", "precedes": "follows"}
#: Parts into which the chunks of one element are dealt, on the asking and on the other side.
SALTS = 4


def reverse_kind(kind: Column) -> Column:
    out = kind
    for name, other in REVERSE.items():
        out = F.when(kind == name, other).otherwise(out)
    return out


def both_ways(edges: DataFrame) -> DataFrame:
    """The edges, and for bidirectional ones the way back under its own name."""
    back = edges.filter("bidirectional").select(F.col("target").alias("source"), F.col("source").alias("target"), reverse_kind(F.col("kind")).alias("kind"))
    return edges.select("source", "target", "kind").unionByName(back)


def within_hops(edges: DataFrame, starts: DataFrame, hops: int = 2, kinds: list[str] | None = None, ends: DataFrame | None = None) -> DataFrame:
    """(start, node, distance): all nodes that a walk of 1 to ``hops`` edges, either way, leads to from each start, with the fewest edges.

    The start itself is found at distance 2 if it has an edge. Each hop is one join of the nodes just reached; repeats go before the next hop, so walks are never listed. Edges may repeat, and are not brought together to find out. With ``ends`` (node) only these nodes are returned, and the last hop takes edges to them alone.
    """
    used = edges if kinds is None else edges.filter(F.col("kind").isin(kinds))
    step = used.select(F.col("source").alias("a"), F.col("target").alias("b")).union(used.select(F.col("target").alias("a"), F.col("source").alias("b")))
    reached = starts.select(F.col("node").alias("start"), "node")
    out = None
    for hop in range(1, hops + 1):
        taken = step if ends is None or hop < hops else step.join(ends.select(F.col("node").alias("b")), "b", "left_semi")
        reached = reached.join(taken, reached["node"] == taken["a"]).select("start", F.col("b").alias("node")).distinct()
        found = (reached if ends is None or hop == hops else reached.join(ends, "node", "left_semi").select("start", "node")).withColumn("distance", F.lit(hop).cast("long"))
        out = found if out is None else out.unionByName(found)
    return out.groupBy("start", "node").agg(F.min("distance").alias("distance"))


def related_chunks(chunks: DataFrame, refs: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(chunk, related, element, distance): chunks that refer to elements near those of a chunk; a row for each reference, the chunk itself left out."""
    starts = refs.join(chunks.select("chunk"), "chunk", "left_semi").select("chunk", F.col("element").alias("start")).distinct()
    # Of the elements near by only those that a chunk refers to go on, before a row for each chunk is made of them.
    near = within_hops(edges, starts.select(F.col("start").alias("node")).distinct(), hops, ends=refs.select(F.col("element").alias("node")).distinct())
    found = starts.join(near, "start").select("chunk", F.col("node").alias("element"), "distance")
    # An element that many chunks name makes many rows of few: both its sides are dealt over tasks, each part of one meeting each of the other, whatever the size of what goes in.
    n, every = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    part = lambda key: F.pmod(F.xxhash64(key), F.lit(SALTS))
    other = refs.select(F.col("chunk").alias("related"), "element").withColumns({"to": part("related"), "by": every}).repartition(n, "element", "by", "to")
    found = found.withColumns({"by": part("chunk"), "to": every}).repartition(n, "element", "by", "to")
    return found.join(other, ["element", "by", "to"]).filter(F.col("related") != F.col("chunk")).select("chunk", "related", "element", "distance")


def on_cycles(parents: DataFrame) -> DataFrame:
    """(node): the nodes whose way up (node, parent) never ends, on a cycle or below one.

    Each round a node's pointer becomes that of the node it points to, so it spans twice the way; a node whose way ends within it goes. If any way of finite length were left, one of at most the span would be too, so the first round that loses none is the last: rounds follow the logarithm of the longest way.
    """
    known = parents.select("node")
    left = written(parents.filter("parent IS NOT NULL").join(known.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", F.col("parent").alias("up")).distinct())
    n = left.select("node").distinct().count()
    while n:
        left = written(left.join(left.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up")).distinct())
        n, before = left.select("node").distinct().count(), n
        if n == before:
            break
    return left.select("node").distinct()


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(issue, n): missing parents, edges without a node at an end, and self-edges."""
    names = nodes.select(F.col("node").alias("name"))
    orphans = nodes.filter("parent IS NOT NULL").join(names, F.col("parent") == F.col("name"), "left_anti").agg(F.count("*").alias("n")).select(F.lit("missing_parent").alias("issue"), "n")
    open_ends = edges.join(names, F.col("source") == F.col("name"), "left_anti").unionByName(edges.join(names, F.col("source") == F.col("name"), "left_semi").join(names, F.col("target") == F.col("name"), "left_anti"))
    dangling = open_ends.agg(F.count("*").alias("n")).select(F.lit("dangling_edge").alias("issue"), "n")
    loops = edges.filter("source = target").agg(F.count("*").alias("n")).select(F.lit("self_edge").alias("issue"), "n")
    return orphans.unionByName(dangling).unionByName(loops)


def merged(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; of two with one key the second's stays."""
    return second.unionByName(first.join(second.select(key), key, "left_anti"))
