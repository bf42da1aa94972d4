"""Trees as nested JSON and back, of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import builders
from docloom.scratch import written


def export_nested(rows: DataFrame, fields: list[str], ranges: int = 0) -> DataFrame:
    """(tree, json) of (tree, line, level, fields): each tree's rows as an array of nested objects with ``line``, the fields and ``children``.

    A row's parent is the nearest line before of a lower level. In line order the text of a row depends on its depth and the next one's alone: it opens its children's list or closes as many objects as the depth falls. So a tree is one ordered concatenation, whatever its depth; nothing is nested level by level.
    Null fields are left out; a null tree is a tree; no row gives no text.
    """
    placed = builders.swept(rows.select("tree", "line", "level", *fields), "tree", ["line"], "line", "level", ranges=ranges)
    order = Window.partitionBy("tree").orderBy("line")
    placed = placed.withColumn("next", F.lead("above").over(order))
    own = F.to_json(F.struct("line", *fields))
    opened = F.concat(F.expr("left(own, length(own) - 1)"), F.lit(',"children":['))
    falls = (F.col("above") - F.coalesce("next", F.lit(0))).cast("int")
    closed = F.concat(opened, F.lit("]}"), F.repeat(F.lit("]}"), F.greatest(F.lit(0), falls)))
    piece = F.when(F.col("next") > F.col("above"), opened).otherwise(F.concat(closed, F.when(F.col("next").isNotNull(), ",").otherwise("")))
    pieces = placed.withColumn("own", own).select("tree", "line", piece.alias("piece"))
    joined = pieces.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("line", "piece"))).alias("x"))
    return joined.select("tree", F.concat(F.lit("["), F.array_join("x.piece", ""), F.lit("]")).alias("json"))


def import_nested(docs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(tree, line, parent, depth, ord, fields) of (tree, json): every object of every level, with the line of the object around it and its place among its siblings.

    Each round opens the children of the level before, so rounds are as many as levels and no depth is fixed. A text that is no JSON array gives one row with a null line and depth -1.
    """
    kinds = [f"try_variant_get(node, '$.{k}', '{t}') AS {k}" for k, t in fields.items()]
    parsed = docs.select("tree", F.try_parse_json("json").alias("v"))
    bad = parsed.filter("v IS NULL OR schema_of_variant(v) NOT LIKE 'ARRAY%'")
    level = parsed.filter("v IS NOT NULL AND schema_of_variant(v) LIKE 'ARRAY%'").select("tree", F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("depth"), F.expr("cast(v AS array<variant>)").alias("nodes"))
    out = bad.selectExpr("tree", "cast(NULL AS long) AS line", "cast(NULL AS long) AS parent", "-1L AS depth", "0L AS ord", *[f"cast(NULL AS {t}) AS {k}" for k, t in fields.items()])
    while True:
        level = level.select("tree", "parent", "depth", F.posexplode("nodes").alias("ord", "node"))
        level = written(level.selectExpr("tree", "try_variant_get(node, '$.line', 'long') AS line", "parent", "depth", "cast(ord AS long) AS ord", *kinds, "to_json(try_variant_get(node, '$.children', 'variant')) AS children"))
        if level.isEmpty():
            return out
        out = out.unionByName(level.drop("children"))
        level = level.filter("children IS NOT NULL AND children <> '[]'").select("tree", F.col("line").alias("parent"), (F.col("depth") + 1).alias("depth"), F.expr("cast(parse_json(children) AS array<variant>)").alias("nodes"))


def grafted(nodes: DataFrame, subtree: DataFrame, parent: int) -> DataFrame:
    """The forest (node, parent, ord) with the roots of a subtree (node, parent, ord) behind the last child of ``parent``; unchanged where that node is not there, or where the subtree holds a node that is.

    So no node gets two parents and no ring can arise.
    """
    there = nodes.filter(F.col("node") == parent).select(F.lit(1).alias("there"))
    clash = subtree.join(nodes.select("node"), "node", "left_semi").limit(1).select(F.lit(1).alias("clash"))
    last = nodes.filter(F.col("parent") == parent).agg((F.coalesce(F.max("ord"), F.lit(-1)) + 1).alias("from"))
    rows = subtree.select("node", "parent", "ord").join(F.broadcast(there), how="left_semi", on=F.lit(True)).join(F.broadcast(clash), how="left_anti", on=F.lit(True)).crossJoin(F.broadcast(last))
    root = F.col("parent").isNull()
    return nodes.select("node", "parent", "ord").unionByName(rows.select("node", F.when(root, F.lit(parent).cast("long")).otherwise(F.col("parent")).alias("parent"), F.when(root, F.col("ord") + F.col("from")).otherwise(F.col("ord")).alias("ord")))


def bulk_inserted(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The tree (tree, node, parent, line) with rows (tree, node, line, wanted) put in: under the wanted node if it is in the tree, else under the node of the nearest line before, else under the tree's root, which is its root of the least line; ``inserted`` tells them apart.

    The nearest line comes from one sort of a tree's nodes and rows together, not from a join of lines with lines. Rows are hung on nodes of the tree alone, never on each other, so no ring can arise. A row whose node is in its tree already is left out; in a tree without nodes rows are roots.
    """
    known = nodes.select("tree", "node")
    fresh = rows.join(known, ["tree", "node"], "left_anti").dropDuplicates(["tree", "node"])
    wanted = known.select(F.col("tree").alias("__t"), F.col("node").alias("__n"))
    asked = fresh.join(wanted, (F.col("tree") == F.col("__t")) & (F.col("wanted") == F.col("__n")), "left").select("tree", "node", "line", F.col("__n").alias("found"))
    roots = nodes.filter("parent IS NULL").groupBy("tree").agg(F.min_by("node", F.struct("line", "node")).alias("root"))
    both = nodes.select("tree", "line", F.lit(0).alias("side"), F.col("node").alias("own"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("found")).unionByName(
        asked.select("tree", "line", F.lit(1).alias("side"), F.lit(None).cast("long").alias("own"), "node", "found")
    )
    before = F.last("own", ignorenulls=True).over(Window.partitionBy("tree").orderBy("line", "side", "own").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hung = both.withColumn("near", F.when(F.col("line").isNotNull(), before)).filter("side = 1").join(roots, "tree", "left")
    placed = hung.select("tree", "node", F.coalesce("found", "near", "root").alias("parent"), "line", F.lit(True).alias("inserted"))
    return nodes.select("tree", "node", "parent", "line", F.lit(False).alias("inserted")).unionByName(placed)
