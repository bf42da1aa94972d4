"""Trees and graphs made from the star tables: region - nation - customer - orders as a tree, part - supplier as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import graphs, trees
from docloom.plans.base import registry, table

QUERIES, SQL, query = registry()

#: Offsets that keep the numbers of the levels apart.
NATION, CUSTOMER, ORDERS = 1_000, 1_000_000, 10_000_000_000

NODES = f"""nodes AS (SELECT r_regionkey::BIGINT AS node, NULL::BIGINT AS parent, r_regionkey::BIGINT AS ord FROM region UNION ALL SELECT {NATION} + n_nationkey, n_regionkey, n_nationkey FROM nation
UNION ALL SELECT {CUSTOMER} + c_custkey, {NATION} + c_nationkey, c_custkey FROM customer UNION ALL SELECT {ORDERS} + o_orderkey, {CUSTOMER} + o_custkey, o_orderkey FROM orders)"""
PATHS = f"""WITH RECURSIVE {NODES}, p AS (SELECT node, node AS root, 0::BIGINT AS depth, [node] AS path, [ord] AS places FROM nodes WHERE parent IS NULL
UNION ALL SELECT n.node, p.root, p.depth + 1, list_append(p.path, n.node), list_append(p.places, n.ord) FROM nodes n JOIN p ON n.parent = p.node)"""
CLOSURE = f"""{PATHS}, c AS (SELECT node, unnest(path) AS ancestor, depth, unnest(generate_series(0, depth)) AS pos FROM p)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def level(name: str, key: str, add: int, parent, above: int) -> DataFrame:
        up = F.lit(None).cast("long") if parent is None else F.col(parent).cast("long") + above
        return table(spark, sf_dir, name).select((F.col(key).cast("long") + add).alias("node"), up.alias("parent"), F.col(key).cast("long").alias("ord"))

    return (
        level("region", "r_regionkey", 0, None, 0).unionByName(level("nation", "n_nationkey", NATION, "n_regionkey", 0))
        .unionByName(level("customer", "c_custkey", CUSTOMER, "c_nationkey", NATION)).unionByName(level("orders", "o_orderkey", ORDERS, "o_custkey", CUSTOMER))
    )


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.paths(nodes(spark, sf_dir))


@query(f"{PATHS} SELECT node, root, depth FROM p")
def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("node", "root", "depth")


@query(f"{CLOSURE} SELECT ancestor AS node, count(*) AS size, max(depth - pos) AS height FROM c GROUP BY ancestor")
def tree_height_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.measures(found(spark, sf_dir)).select("node", "size", "height")


@query(f"{PATHS} SELECT node FROM p WHERE node NOT IN (SELECT parent FROM nodes WHERE parent IS NOT NULL)")
def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.measures(found(spark, sf_dir)).filter("n_children = 0").select("node")


@query(f"{PATHS} SELECT node, array_to_string(path, '/') AS way FROM p")
def graph_path_to_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("way"))


@query(f"{PATHS} SELECT node, depth, array_to_string(places, '.') AS place FROM p")
def tree_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.preorder(found(spark, sf_dir)).select("node", "depth", F.array_join(F.transform("places", lambda x: x.cast("string")), ".").alias("place"))


@query(f"{PATHS} SELECT node, depth, array_to_string(places, '.') AS place FROM p")
def tree_levelorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.levelorder(found(spark, sf_dir)).select("node", "depth", F.array_join(F.transform("places", lambda x: x.cast("string")), ".").alias("place"))


@query(f"{PATHS} SELECT node, depth, array_to_string(places, '.') || '.2147483647' AS place FROM p")
def tree_postorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.postorder(found(spark, sf_dir)).select("node", "depth", F.array_join(F.transform("places", lambda x: x.cast("string")), ".").alias("place"))


@query(
    f"""{PATHS}, q AS (SELECT {ORDERS} + o_orderkey AS a, {ORDERS} + o_orderkey + 1 AS b FROM orders) SELECT a, b, list_max(list_intersect(x.path, y.path)) AS ancestor, len(list_intersect(x.path, y.path)) - 1 AS depth FROM q JOIN p x ON x.node = a JOIN p y ON y.node = b"""
)
def tree_lca(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").select((F.col("o_orderkey").cast("long") + ORDERS).alias("a")).withColumn("b", F.col("a") + 1)
    return trees.common_ancestor(found(spark, sf_dir), pairs)


@query(f"{CLOSURE} SELECT count(*) AS n FROM nodes WHERE node NOT IN (SELECT node FROM c WHERE ancestor IN (SELECT {NATION} + n_nationkey FROM nation WHERE n_nationkey % 5 = 0))")
def tree_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "nation").filter("n_nationkey % 5 = 0").select((F.col("n_nationkey").cast("long") + NATION).alias("node"))
    return trees.prune(nodes(spark, sf_dir), found(spark, sf_dir), gone).agg(F.count("*").alias("n"))


@query(
    f"""{PATHS}, k AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent) SELECT count(*) AS n_nodes, count(*) FILTER (k.n IS NULL) AS n_leaves, max(depth) AS max_depth, round(avg(k.n), 6) AS avg_branching,
    round(floor(log2(count(*))) / greatest(1, max(depth)), 6) AS balance FROM p LEFT JOIN k USING (node)"""
)
def tree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = found(spark, sf_dir)
    return trees.statistics(ways, trees.measures(ways))


LEVELS = "rows AS (SELECT p_partkey AS line, floor(log2(p_partkey + 1))::INT AS level FROM part)"


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line"), F.floor(F.log2(F.col("p_partkey") + 1)).cast("int").alias("level"))


@query(f"WITH {LEVELS}, m AS (SELECT level + 1 AS level, max(line) AS parent FROM rows GROUP BY level) SELECT line, level, parent FROM rows LEFT JOIN m USING (level)")
def tree_build_level_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.level_order_parents(levels(spark, sf_dir))


@query(
    f"""WITH {LEVELS}, n AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY line) - 1 AS at, count(*) OVER (PARTITION BY level) AS n FROM rows)
    SELECT a.line, a.level, b.line AS parent FROM n a LEFT JOIN n b ON b.level = a.level - 1 AND b.at = a.at * b.n // a.n"""
)
def tree_build_breadth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.spread_parents(levels(spark, sf_dir))


EDGES = "edges AS (SELECT DISTINCT l_partkey AS source, 1000000000 + l_suppkey AS target, l_returnflag AS kind FROM lineitem)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_partkey").alias("source"), (F.col("l_suppkey") + 1_000_000_000).alias("target"), F.col("l_returnflag").alias("kind"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).distinct()


HOPS = """s AS (SELECT DISTINCT source AS a, target AS b FROM edges WHERE kind = 'R' UNION SELECT DISTINCT target, source FROM edges WHERE kind = 'R'), h1 AS (SELECT p_partkey AS start, b AS node FROM part JOIN s ON a = p_partkey WHERE p_partkey % 50 = 0),
h2 AS (SELECT DISTINCT start, b AS node FROM h1 JOIN s ON a = node)"""


@query(f"WITH {EDGES}, {HOPS} SELECT start, node, min(distance)::BIGINT AS distance FROM (SELECT DISTINCT start, node, 1 AS distance FROM h1 UNION ALL SELECT start, node, 2 FROM h2) GROUP BY start, node")
def graph_k_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("node"))
    return graphs.within_hops(links(spark, sf_dir), starts, 2, ["R"])


@query(
    f"""WITH {EDGES}, s AS (SELECT DISTINCT source AS a, target AS b FROM edges UNION SELECT DISTINCT target, source FROM edges), r AS (SELECT c_custkey AS chunk, c_custkey % 97 AS element FROM customer)
    SELECT x.chunk, y.chunk AS related, y.element, 2::BIGINT AS distance FROM (SELECT DISTINCT r.chunk, s2.b AS element FROM r JOIN s s1 ON s1.a = r.element JOIN s s2 ON s2.a = s1.b) x JOIN r y ON x.element = y.element AND x.chunk <> y.chunk"""
)
def graph_related_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk"), (F.col("c_custkey") % 97).alias("element"))
    return graphs.related_chunks(refs.select("chunk"), refs, links(spark, sf_dir), 2)


@query("SELECT p_partkey AS node FROM part WHERE p_partkey % 10 IN (0, 1, 2)")
def graph_cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each ten parts, 0 to 2 point in a ring and the others at the next one up to nine, which points nowhere."""
    n = F.col("p_partkey")
    up = F.when(n % 10 == 0, n + 1).when(n % 10 == 1, n + 1).when(n % 10 == 2, n - 2).when(n % 10 < 9, n + 1)
    return graphs.on_cycles(table(spark, sf_dir, "part").select(n.alias("node"), up.alias("parent")))


@query(
    f"""WITH {EDGES}, e AS (SELECT source, target, CASE kind WHEN 'R' THEN 'parent_child' WHEN 'A' THEN 'follows' ELSE 'similar' END AS kind, source % 2 = 0 AS two_way FROM edges)
    SELECT source, target, kind FROM e UNION ALL SELECT target, source, CASE kind WHEN 'parent_child' THEN 'child_parent' WHEN 'follows' THEN 'precedes' ELSE kind END FROM e WHERE two_way"""
)
def graph_reverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("kind") == "R", "parent_child").when(F.col("kind") == "A", "follows").otherwise("similar")
    return graphs.both_ways(edges(spark, sf_dir).withColumn("kind", kind).withColumn("bidirectional", F.col("source") % 2 == 0))


@query(
    f"""WITH {EDGES}, n AS (SELECT p_partkey AS node, p_partkey + 1 AS parent FROM part WHERE p_partkey % 10 <> 5 UNION ALL SELECT 1000000000 + s_suppkey, NULL FROM supplier)
    SELECT 'missing_parent' AS issue, count(*) AS n FROM n WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM n) UNION ALL SELECT 'dangling_edge', count(*) FROM edges WHERE source NOT IN (SELECT node FROM n) OR target NOT IN (SELECT node FROM n)
    UNION ALL SELECT 'self_edge', count(*) FROM edges WHERE source = target"""
)
def graph_validate_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").filter("p_partkey % 10 <> 5").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") + 1).alias("parent"))
    suppliers = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("node"), F.lit(None).cast("long").alias("parent"))
    return graphs.problems(parts.unionByName(suppliers), edges(spark, sf_dir))


@query("SELECT coalesce(b.p_partkey, a.p_partkey) AS id, CASE WHEN b.p_partkey IS NOT NULL THEN 'second' ELSE 'first' END AS origin FROM (SELECT * FROM part WHERE p_partkey % 3 < 2) a FULL JOIN (SELECT * FROM part WHERE p_partkey % 3 > 0) b ON a.p_partkey = b.p_partkey")
def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return graphs.merged(part.filter("id % 3 < 2").withColumn("origin", F.lit("first")), part.filter("id % 3 > 0").withColumn("origin", F.lit("second")), "id")


@query(
    f"""SELECT n_nationkey::BIGINT AS "group", CASE WHEN count(c_custkey) = 1 THEN n_regionkey || '/' || ({NATION} + n_nationkey) || '/' || ({CUSTOMER} + max(c_custkey)) ELSE n_regionkey || '/' || ({NATION} + n_nationkey) END AS ancestors
    FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey"""
)
def graph_common_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("group"), (F.col("c_custkey").cast("long") + CUSTOMER).alias("node"))
    out = trees.common_prefix(found(spark, sf_dir), groups)
    return out.select("group", F.array_join(F.transform("ancestors", lambda x: x.cast("string")), "/").alias("ancestors"))

