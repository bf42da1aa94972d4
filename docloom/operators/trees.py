"""Trees as tables of nodes (node, parent, ord): closures, orders, measures and edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.scratch import written

#: Nodes of a part of a large forest.
PART = 1 << 17


def paths(nodes: DataFrame) -> DataFrame:
    """(node, root, depth, path, places): each node's way from its root, as nodes and as ordinals.

    A level a round, roots first; a round joins the last level with its children only, so every edge is used once. Nodes that no root reaches (cycles, missing parents) have no row. A node with several parents has a row for each way, but no way comes back to a node that it has passed.
    """
    level = nodes.filter("parent IS NULL").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), F.array("node").alias("path"), F.array("ord").alias("places"))
    out = level
    edges = nodes.filter("parent IS NOT NULL").select(F.col("node").alias("child"), F.col("parent").alias("above"), F.col("ord").alias("place"))
    edges = spread(edges, "above")
    while True:
        level = written(
            level.join(edges, level["node"] == edges["above"]).filter(~F.array_contains("path", F.col("child"))).select(
                F.col("child").alias("node"), "root", (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("child")).alias("path"), F.array_append("places", F.col("place")).alias("places")
            )
        )
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def closure(found: DataFrame) -> DataFrame:
    """(ancestor, node, distance) of every pair, a node with itself included, from :func:`paths`."""
    return found.select("node", F.posexplode("path").alias("pos", "ancestor"), "depth").select("ancestor", "node", (F.col("depth") - F.col("pos")).alias("distance"))


def spread(rows: DataFrame, key: str = "node") -> DataFrame:
    """The rows in as many parts as their number asks for, equal keys together: paths and edges are written so small that a split of a file, or of what is shuffled, holds very many, which would fill a task's memory."""
    parts = -(-rows.count() // PART)
    return rows.repartition(parts, key) if parts > rows.sparkSession.sparkContext.defaultParallelism else rows


def subtree_kinds(found: DataFrame, rows: DataFrame, kinds: Sequence[str], kind: str = "kind") -> DataFrame:
    """(node, one column a kind): for every subtree of a forest from :func:`paths` how many of its nodes are of each kind, by ``rows`` (node, kind), which have a row a node.

    Nodes go up their own paths, which hold all that is needed: nothing is sorted or ranked. Partial sums shrink the rows of a part before they move.
    """
    placed = spread(found.select("node", "path")).join(rows.select("node", kind), "node", "left")
    return placed.select(F.explode("path").alias("node"), kind).groupBy("node").agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def measures(found: DataFrame) -> DataFrame:
    """(node, size, height, n_leaves, n_children) of every subtree of a forest from :func:`paths`.

    Only nodes with children are summed over, each by the rows below it, which partial sums shrink before they move; a node without any is its own subtree. A node with several ways counts once a way.
    """
    found = spread(found.select("node", "depth", "path"))
    below = found.select("depth", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("pos", "node")).select("node", (F.col("depth") - F.col("pos")).alias("distance"))
    inner = below.groupBy("node").agg(F.count("*").alias("n_below"), F.max("distance").alias("height"), F.count_if(F.col("distance") == 1).alias("n_children"))
    leaf = found.join(inner.select("node"), "node", "left_anti")
    leaves = leaf.select(F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("node")).groupBy("node").agg(F.count("*").alias("n_leaves"))
    own = found.groupBy("node").agg(F.count("*").alias("ways"))
    # The leaves are summed only where they are asked for: their keys are distinct, so Spark leaves out the join where the column is not read.
    joined = own.join(inner, "node", "left").join(leaves, "node", "left")
    return joined.select(
        "node", (F.col("ways") + F.coalesce("n_below", F.lit(0))).alias("size"), F.coalesce("height", F.lit(0)).alias("height"),
        F.when(F.col("n_below").isNull(), F.col("ways")).otherwise(F.coalesce("n_leaves", F.lit(0))).alias("n_leaves"), F.coalesce("n_children", F.lit(0)).alias("n_children"),
    )


def preorder(found: DataFrame) -> DataFrame:
    """Order key of a depth-first walk: ordinals compared in turn, a node before its children."""
    return found.select("node", "depth", "places").orderBy("places")


def levelorder(found: DataFrame) -> DataFrame:
    return found.select("node", "depth", "places").orderBy("depth", "places")


def postorder(found: DataFrame, largest: int = 2**31 - 1) -> DataFrame:
    """Children before their parent: the same ordinals, closed by one above all."""
    return found.select("node", "depth", F.array_append("places", F.lit(largest).cast("long")).alias("places")).orderBy("places")


def common_ancestor(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, ancestor, depth): the deepest node on both paths, the nodes themselves included; null in different trees."""
    left = found.select(F.col("node").alias("a"), F.col("path").alias("pa"))
    right = found.select(F.col("node").alias("b"), F.col("path").alias("pb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.filter(F.col("pa"), lambda x, i: F.slice(F.col("pa"), F.lit(1), i + 1) == F.slice(F.col("pb"), F.lit(1), i + 1))
    return both.select("a", "b", F.get(shared, F.size(shared) - 1).alias("ancestor"), (F.size(shared) - 1).cast("long").alias("depth"))


def prune(nodes: DataFrame, found: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes left without the subtrees of ``roots`` (node)."""
    gone = closure(found).join(roots.select(F.col("node").alias("ancestor")), "ancestor", "left_semi").select("node").distinct()
    return nodes.join(gone, "node", "left_anti")


def level_order_parents(rows: DataFrame) -> DataFrame:
    """(line, level, parent): a tree from (line, level): the parent is the last line of the level above, none where that level is missing."""
    last = rows.groupBy("level").agg(F.max("line").alias("parent")).select((F.col("level") + 1).alias("level"), "parent")
    return rows.join(F.broadcast(last), "level", "left").select("line", "level", "parent")


def spread_parents(rows: DataFrame) -> DataFrame:
    """(line, level, parent): the children of a level dealt evenly over the level above, in line order."""
    order = Window.partitionBy("level").orderBy("line")
    numbered = rows.withColumn("at", F.row_number().over(order) - 1)
    sizes = rows.groupBy("level").agg(F.count("*").alias("n"))
    above = numbered.select((F.col("level") + 1).alias("level"), F.col("at").alias("above"), F.col("line").alias("parent"))
    upper = sizes.select((F.col("level") + 1).alias("level"), F.col("n").alias("n_above"))
    placed = numbered.join(F.broadcast(sizes), "level").join(F.broadcast(upper), "level", "left")
    placed = placed.withColumn("above", F.floor(F.col("at") * F.col("n_above") / F.col("n")).cast("int"))
    return placed.join(above, ["level", "above"], "left").select("line", "level", "parent")


def statistics(found: DataFrame, of: DataFrame) -> DataFrame:
    """One row for the forest: nodes, leaves, depth, mean branching of inner nodes and balance; ``of`` is the result of :func:`measures`."""
    joined = found.select("node", "depth").join(of, "node")
    return joined.agg(
        F.count("*").alias("n_nodes"), F.count_if(F.col("n_children") == 0).alias("n_leaves"), F.max("depth").alias("max_depth"),
        F.round(F.avg(F.when(F.col("n_children") > 0, F.col("n_children"))), 6).alias("avg_branching"),
        F.round(F.floor(F.log2(F.count("*"))) / F.greatest(F.lit(1), F.max("depth")), 6).alias("balance"),
    )


def common_prefix(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, ancestors): the nodes, from the root on, that the paths of all of a group's nodes (group, node) share."""
    lists = groups.join(found.select("node", "path"), "node").groupBy("group").agg(F.min("path").alias("a"), F.max("path").alias("b"))
    # What the least and the greatest path share, all between them share.
    shared = F.filter(F.col("a"), lambda x, i: F.slice(F.col("a"), F.lit(1), i + 1) == F.slice(F.col("b"), F.lit(1), i + 1))
    return lists.select("group", shared.alias("ancestors"))


def appended(first: DataFrame, second: DataFrame, root: int) -> DataFrame:
    """Both forests under a new root, the second behind the first."""
    def under(nodes: DataFrame, place: int) -> DataFrame:
        return nodes.select("node", F.coalesce("parent", F.lit(root).cast("long")).alias("parent"), F.when(F.col("parent").isNull(), F.col("ord") + place).otherwise(F.col("ord")).alias("ord"))

    top = first.limit(1).select(F.lit(root).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("ord"))
    return top.unionByName(under(first, 0)).unionByName(under(second, 1 << 32))


def split(nodes: DataFrame, condition) -> tuple[DataFrame, DataFrame]:
    """The nodes that meet a condition and the others; a node whose parent is on the other side becomes a root."""
    def rebuilt(part: DataFrame) -> DataFrame:
        own = part.select(F.col("node").alias("own"))
        return part.join(own, part["parent"] == own["own"], "left").select("node", F.col("own").alias("parent"), "ord")

    return rebuilt(nodes.filter(condition)), rebuilt(nodes.filter(~condition))
