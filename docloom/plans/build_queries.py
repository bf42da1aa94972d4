"""Trees built from ordered rows, and what their subtrees hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import builders, structure, trees
from docloom.plans.base import registry, table
from docloom.plans.chunk_queries import NUMBERED, legal
from docloom.plans.graph_queries import CLOSURE, CUSTOMER, LEVELS, NATION, ORDERS, found, levels, nodes

QUERIES, SQL, query = registry()


@query(f"WITH {LEVELS}, m AS (SELECT level, max(line) AS line FROM rows GROUP BY level) SELECT line, level, (SELECT arg_max(m.line, m.level) FROM m WHERE m.level < rows.level) AS parent FROM rows")
def tree_build_depth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.depth_first_parents(levels(spark, sf_dir).withColumn("tree", F.lit(0))).select("line", "level", "parent")


_ELEMENTS = NUMBERED.replace("SELECT doc_id, CASE WHEN regexp_matches(value", "SELECT doc_id, line_number, CASE WHEN regexp_matches(value", 1)


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.elements(legal(spark, sf_dir))


@query(f"{_ELEMENTS} SELECT a.doc_id, a.line_number, a.level::INT AS level, max(b.line_number) AS parent_line FROM k a LEFT JOIN k b ON b.doc_id = a.doc_id AND b.line_number < a.line_number AND b.level < a.level GROUP BY ALL")
def outline_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outline(spark, sf_dir).select(F.col("doc_id").alias("tree"), F.col("line_number").alias("line"), F.col("level").cast("int").alias("level"))
    return builders.outline_parents(rows).select(F.col("tree").alias("doc_id"), F.col("line").alias("line_number"), "level", F.col("parent").alias("parent_line"))


SECTIONS = _ELEMENTS.replace("e AS (SELECT *,", "starts AS (SELECT doc_id, line_number, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_number, unnest(string_split(text, chr(10))) AS line FROM legal)), e AS (SELECT *,", 1)


@query(
    f"""{SECTIONS}, n AS (SELECT k.doc_id, k.line_number, k.level, s.start FROM k JOIN starts s USING (doc_id, line_number)), x AS (SELECT a.doc_id, a.line_number, a.start, min(b.start) AS stop FROM n a LEFT JOIN n b ON b.doc_id = a.doc_id AND b.line_number > a.line_number AND b.level <= a.level GROUP BY ALL)
    SELECT x.doc_id, line_number, start::BIGINT AS start, coalesce(stop, length(text))::BIGINT AS "end", sha256(substring(text, start::BIGINT + 1, (coalesce(stop, length(text)) - start)::BIGINT)) AS content_sha256 FROM x JOIN legal ON legal.doc_id = x.doc_id"""
)
def section_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = legal(spark, sf_dir)
    return builders.section_texts(texts, structure.elements(texts)).select("doc_id", "line_number", "start", "end", F.sha2("content", 256).alias("content_sha256"))


BALANCED = """WITH RECURSIVE r AS (SELECT {tree} AS tree, {line} AS line, row_number() OVER (PARTITION BY {tree} ORDER BY {line}) - 1 AS i, count(*) OVER (PARTITION BY {tree}) AS n FROM {rows}),
h AS (SELECT DISTINCT tree, 0::BIGINT AS lo, n AS hi, NULL::BIGINT AS above, NULL::VARCHAR AS side, 0::BIGINT AS depth FROM r
UNION ALL SELECT tree, CASE s.side WHEN 'left' THEN lo ELSE lo + (hi - lo) // 2 + 1 END, CASE s.side WHEN 'left' THEN lo + (hi - lo) // 2 ELSE hi END, lo + (hi - lo) // 2, s.side, depth + 1
FROM h, (VALUES ('left'), ('right')) s(side) WHERE CASE s.side WHEN 'left' THEN (hi - lo) // 2 > 0 ELSE lo + (hi - lo) // 2 + 1 < hi END)
SELECT r.tree, r.line, p.line AS parent, side, depth FROM h JOIN r ON r.tree = h.tree AND r.i = h.lo + (h.hi - h.lo) // 2 LEFT JOIN r p ON p.tree = h.tree AND p.i = h.above"""


@query(BALANCED.format(tree="c_nationkey", line="c_custkey", rows="customer"))
def tree_build_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.balanced_parents(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("tree"), F.col("c_custkey").alias("line")))


@query(BALANCED.format(tree="o_custkey % 7", line="o_orderkey", rows="(SELECT * FROM orders WHERE o_orderstatus <> 'P')"))
def tree_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as elements; those in status P stand for made-up nodes."""
    line = F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey"))
    return builders.rebalanced(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("tree"), F.col("o_orderkey").alias("node"), line.alias("line")))


#: Pre-order ranks, and sizes from the closure.
INTERVALS = f"""{CLOSURE}, z AS (SELECT ancestor AS node, count(*) AS size FROM c GROUP BY ancestor), i AS (SELECT p.node, p.depth, row_number() OVER (ORDER BY places) - 1 AS first, z.size FROM p JOIN z USING (node))"""


def spans_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ways = found(spark, sf_dir)
    return ways, builders.written(builders.subtree_intervals(ways))


@query(f"{INTERVALS} SELECT node, depth, first, first + size AS behind FROM i")
def subtree_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(spark, sf_dir)[1]


_KIND = f"CASE WHEN node < {NATION} THEN 'region' WHEN node < {CUSTOMER} THEN 'nation' WHEN node < {ORDERS} THEN 'customer' ELSE 'order' END"


def kind_of(node: Column) -> Column:
    return F.when(node < NATION, "region").when(node < CUSTOMER, "nation").when(node < ORDERS, "customer").otherwise("order")


@query(f"{CLOSURE}, t AS (SELECT ancestor, {_KIND} AS kind, count(*) AS n FROM c GROUP BY ancestor, kind) SELECT ancestor AS node, string_agg(kind || ':' || n, ',' ORDER BY kind) AS kinds FROM t GROUP BY ancestor")
def subtree_type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By paths, as trees of few levels are: intervals would rank all nodes first."""
    names = ["customer", "nation", "order", "region"]
    rows = nodes(spark, sf_dir).select("node", kind_of(F.col("node")).alias("kind"))
    kinds = trees.subtree_kinds(found(spark, sf_dir), rows, names)
    return kinds.select("node", F.array_join(F.filter(F.array(*[F.when(F.col(k) > 0, F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))) for k in names]), lambda x: x.isNotNull()), ",").alias("kinds"))


NAMES = f"""t AS (SELECT r_regionkey::BIGINT AS node, r_name AS text FROM region UNION ALL SELECT {NATION} + n_nationkey, n_name FROM nation UNION ALL SELECT {CUSTOMER} + c_custkey, c_name FROM customer UNION ALL SELECT {ORDERS} + o_orderkey, o_orderpriority FROM orders)"""


@query(
    f"""{INTERVALS}, {NAMES}, o AS (SELECT node, coalesce(sum(length(text) + 1) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM i JOIN t USING (node)),
    s AS (SELECT c.ancestor AS node, (sum(length(text) + 1) - 1)::BIGINT AS length FROM c JOIN t USING (node) GROUP BY c.ancestor) SELECT node, start, length FROM o JOIN s USING (node)"""
)
def subtree_text_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, spans = spans_of(spark, sf_dir)
    named = [("region", "r_regionkey", 0, "r_name"), ("nation", "n_nationkey", NATION, "n_name"), ("customer", "c_custkey", CUSTOMER, "c_name"), ("orders", "o_orderkey", ORDERS, "o_orderpriority")]
    texts = [table(spark, sf_dir, t).select((F.col(k).cast("long") + add).alias("node"), F.col(x).alias("text")) for t, k, add, x in named]
    return builders.subtree_texts(spans, texts[0].unionByName(texts[1]).unionByName(texts[2]).unionByName(texts[3]))


SUMMARY = f"""{INTERVALS}, h AS (SELECT ancestor AS node, max(depth) AS most FROM c GROUP BY ancestor), n AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
lf AS (SELECT c.ancestor AS node, count(*) AS leaves FROM c ANTI JOIN n ON n.node = c.node GROUP BY c.ancestor), ch AS (SELECT x.parent AS node, min(h.most - p.depth) AS low, max(h.most - p.depth) AS high FROM nodes x JOIN h ON h.node = x.node JOIN p ON p.node = x.node WHERE x.parent IS NOT NULL GROUP BY x.parent)
SELECT i.node, i.depth, h.most - i.depth AS height, n.n IS NULL AS is_leaf, x.parent IS NULL AS is_root, coalesce(n.n, 0) AS child_count, i.size AS subtree_size, lf.leaves AS leaf_count, h.most AS max_child_depth, i.depth + 1 AS path_length, coalesce(sb.n - 1, 0) AS sibling_count,
round(CASE WHEN ch.high > 0 THEN (ch.high - ch.low) / ch.high ELSE 0 END::DOUBLE, 6) AS balance_factor FROM i JOIN h USING (node) JOIN nodes x USING (node) JOIN lf USING (node) LEFT JOIN n USING (node) LEFT JOIN ch USING (node) LEFT JOIN n sb ON sb.node = x.parent"""


@query(SUMMARY)
def tree_node_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways, spans = spans_of(spark, sf_dir)
    return builders.node_summary(ways, spans)


@query(
    f"""{CLOSURE}, t AS (SELECT {ORDERS} + o_orderkey AS node, round(o_totalprice * 100)::BIGINT AS cents FROM orders) SELECT ancestor AS node, sum(coalesce(cents, 0) + CASE WHEN c.node >= {ORDERS} AND c.node % 10 = 0 THEN 100 ELSE 0 END)::BIGINT AS cents FROM c LEFT JOIN t USING (node) GROUP BY ancestor"""
)
def subtree_sums_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order values summed up the tree, then one unit of money added to every tenth order."""
    ways, spans = spans_of(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey").cast("long") + ORDERS).alias("node"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    before = builders.subtree_sums(spans, orders, {"cents": F.col("cents")})
    changed = orders.filter("node % 10 = 0").select("node", F.lit(100).alias("cents"))
    return builders.with_changes(before, ways, changed, ["cents"])
