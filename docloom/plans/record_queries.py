"""Records of documents, chunks and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import records
from docloom.plans.base import registry, table
from docloom.plans.build_queries import kind_of
from docloom.plans.chunk_queries import PLACED, WINDOWS, windows
from docloom.plans.graph_queries import CLOSURE, CUSTOMER, NATION, NODES, ORDERS, PATHS, found, nodes
from docloom.plans.lookup_queries import elements, parents

QUERIES, SQL, query = registry()


@query(
    "SELECT doc_id, 'lang:' || upper(lang) || ',n:' || n_chars || ',source:' || source AS merged, array_to_string(list_sort(CASE WHEN lang = 'en' THEN ['en', source] ELSE ['en', source, lang] END), ',') AS added, CASE WHEN lang = 'en' THEN source ELSE source || ',' || lang END AS removed FROM documents"
)
def maps_and_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    first = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")
    second = F.create_map(F.lit("lang"), F.upper("lang"), F.lit("n"), F.col("n_chars").cast("string"))
    pairs = F.array_sort(F.map_entries(records.merged_maps(first, second)))
    merged = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    given = F.array(F.lit("en"), F.col("source"))
    both = records.added(given, F.col("lang"))
    return docs.select("doc_id", merged.alias("merged"), F.array_join(F.array_sort(both), ",").alias("added"), F.array_join(records.removed(both, F.lit("en")), ",").alias("removed"))


_EXTRA = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in records.COSTLY)


@query(rf"""SELECT doc_id, (floor(greatest(1, length(text) // 3) * 1.1::DOUBLE) + {_EXTRA})::BIGINT AS fallback, greatest(1, length(text) // 3) AS plain, length(text) // 4 + length('{{"lang":"' || lang || '","source":"' || source || '"}}') // 4 AS with_metadata FROM documents""")
def token_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", records.fallback_tokens(text).alias("fallback"), records.fallback_tokens(text, legal=False).alias("plain"), records.tokens_with_metadata(text, F.struct("lang", "source")).alias("with_metadata"))


@query("SELECT p_partkey, CASE WHEN length(p_name) >= 41 THEN p_name ELSE repeat(' ', ((41 - length(p_name)) // 2 + (41 - length(p_name)) % 2)::INT) || p_name || repeat(' ', ((41 - length(p_name)) // 2)::INT) END AS line, p_size > 0 AND p_size < 25 AS valid FROM part")
def centred_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", records.centred(F.col("p_name"), 41).alias("line"), records.valid_sizes(F.col("p_size"), F.lit(25)).alias("valid"))


@query(f"{WINDOWS} SELECT lang, count(*) AS n_chunks, round(avg(length(content)), 4) AS avg_length, min(length(content)) AS min_length, max(length(content)) AS max_length, count(DISTINCT source) AS n_sources, array_to_string(list_sort(list(DISTINCT source))[1:3], ',') AS first_sources FROM c JOIN documents USING (doc_id) GROUP BY lang")
def chunk_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.lit("/a/b/"), "source").alias("source"))
    return records.chunk_overview(windows(spark, sf_dir).join(docs, "doc_id"), "lang").withColumn("first_sources", F.array_join("first_sources", ","))


@query("SELECT doc_id, sha256(text) AS text_sha256, len(string_split(text, chr(10))) AS n_chunks FROM documents WHERE text IS NOT NULL")
def chunks_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's lines as chunks, put together again."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "content"))
    return records.rejoined(lines).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "n_chunks")


@query(
    f"""{PLACED}, o AS (SELECT a.doc_id, a.line_number, a.level, max(b.line_number) AS parent FROM sc a LEFT JOIN sc b ON b.doc_id = a.doc_id AND b.line_number < a.line_number AND b.level < a.level GROUP BY ALL)
    SELECT doc_id, count(*) AS total_elements, count(*) FILTER (parent IS NULL) AS n_roots, max(level)::BIGINT AS max_depth FROM o GROUP BY doc_id"""
)
def hierarchy_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.hierarchy_totals(elements(spark, sf_dir).join(parents(spark, sf_dir), ["doc_id", "line_number"]))


@query(f"WITH {NODES}, small AS (SELECT * FROM nodes WHERE node < {CUSTOMER}) SELECT node, coalesce(parent, -1) AS parent, ord FROM small UNION ALL SELECT -1, NULL, 0")
def tree_synthetic_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.rooted(nodes(spark, sf_dir).filter(F.col("node") < CUSTOMER), -1)


@query(f"WITH {NODES} SELECT parent, node FROM nodes WHERE parent IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parent ORDER BY ord, node) = 3")
def tree_child_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.child_at(nodes(spark, sf_dir), 2)


@query(f"{CLOSURE} SELECT ancestor, count(*) AS n_customers, arg_min(c.node, p.places) AS first_customer FROM c JOIN p USING (node) WHERE ancestor < {CUSTOMER} AND node >= {CUSTOMER} AND node < {ORDERS} GROUP BY ancestor")
def tree_descendants_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers below each region and nation, with the first in pre-order."""
    ways = found(spark, sf_dir).filter(kind_of(F.col("node")) == "customer").select("node", "places", F.explode(F.slice("path", 1, 2)).alias("ancestor"))
    return ways.groupBy("ancestor").agg(F.count("*").alias("n_customers"), F.min_by("node", "places").alias("first_customer"))


@query(
    f"""{PATHS}, s AS (SELECT node, parent, CASE WHEN node % 7 = 0 THEN 9 WHEN parent IS NULL THEN 0 WHEN node < {CUSTOMER} THEN 1 WHEN node < {ORDERS} THEN 2 ELSE 3 END AS depth, CASE WHEN node % 11 = 0 THEN -1 ELSE node END AS line FROM nodes)
    SELECT s.node, 'wrong_depth' AS violation FROM s JOIN p USING (node) WHERE s.depth <> p.depth UNION ALL SELECT s.node, 'before_parent' FROM s JOIN s u ON u.node = s.parent WHERE s.line < u.line"""
)
def tree_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with a stored depth, wrong for every seventh, and a line, wrong for every eleventh."""
    node = F.col("node")
    depth = F.when(node % 7 == 0, 9).when(F.col("parent").isNull(), 0).when(node < CUSTOMER, 1).when(node < ORDERS, 2).otherwise(3)
    stored = nodes(spark, sf_dir).select("node", "parent", depth.alias("depth"), F.when(node % 11 == 0, -1).otherwise(node).alias("line"))
    return records.tree_violations(found(spark, sf_dir), stored)


@query(
    """WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'not in any text at all' ELSE substring(text, length(text) // 3 + 1, 50) END AS answer FROM documents)
    SELECT doc_id AS case_id, doc_id, strpos(text, answer) - 1 AS start, strpos(text, answer) - 1 + length(answer) AS "end", answer FROM d WHERE answer <> '' AND strpos(text, answer) > 0"""
)
def corrected_test_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    answer = F.when(F.col("doc_id") % 3 == 0, "not in any text at all").otherwise(F.expr("substring(text, length(text) div 3 + 1, 50)"))
    return records.corrected_cases(docs.select(F.col("doc_id").alias("case_id"), "doc_id", answer.alias("answer")), docs)


@query(f"WITH {NODES} SELECT parent, node FROM nodes WHERE parent >= {NATION} AND parent < {CUSTOMER} AND node >= {CUSTOMER} AND node < {ORDERS}")
def tree_children_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nodes(spark, sf_dir)
    return rows.filter((kind_of(F.col("parent")) == "nation") & (kind_of(F.col("node")) == "customer")).select("parent", "node")
