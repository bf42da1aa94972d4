"""Queries over whole texts and whole trees: sections, spans, answers, nested exports, inserts and rule reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions import tokens as tk
from docloom.operators import chunks, evaluate, nested
from docloom.plans.base import registry, table
from docloom.plans.build_queries import _ELEMENTS, outline
from docloom.plans.chunk_queries import LEGAL, legal
from docloom.plans.graph_queries import CUSTOMER, NATION, NODES, nodes
from docloom.plans.scalar_queries import _strip_tags_sql
from docloom.plans.search_queries import WORDS
from docloom.sources import dataset

QUERIES, SQL, query = registry()


@query(
    rf"""{LEGAL}, p AS (SELECT doc_id, string_split_regex(text, '(?i)\n\s*(?:section|§)\s*\d+') AS parts FROM legal), x AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS section, unnest(parts) AS part FROM p)
    SELECT doc_id, section, length(part) // 4 AS tokens, CASE WHEN length(part) > 50 THEN left(part, 50) || '...' ELSE part END AS preview FROM x"""
)
def section_tokens_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.section_tokens(legal(spark, sf_dir))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a page of markdown: its source as title, and a heading of the second level over each of its lines but the first."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n"), F.replace("text", F.lit("\n"), F.concat(F.lit("\n## "), F.col("lang"), F.lit("\n")))).alias("text"))


@query(
    r"""WITH l AS (SELECT doc_id, source, lang, generate_subscripts(string_split(text, chr(10)), 1) AS section, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, section, CASE WHEN section = 1 THEN 1 ELSE 2 END::BIGINT AS level, CASE WHEN section = 1 THEN source ELSE lang END AS title, regexp_replace(line, '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS content FROM l"""
)
def chunk_by_headings_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.by_headings(marked(spark, sf_dir))
    return found.withColumn("section", F.col("section") + 1 - F.min("section").over(_per_doc()))


def _per_doc():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id")


ITEMS = "t AS (SELECT doc_id, text, doc_id % (SELECT max(item_id) + 1 FROM benchmark) AS item_id FROM documents)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with the benchmark item that its number falls on."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("expected"))
    n = items.agg((F.max("item_id") + 1).alias("n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").crossJoin(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n"))
    return docs.join(items, "item_id").select("doc_id", "item_id", "text", "expected")


@query(f"WITH {ITEMS} SELECT t.doc_id, item_id, round(len(list_intersect({WORDS.format('b.text')}, {WORDS.format('t.text')})) / len({WORDS.format('b.text')}), 6) AS overlap FROM t JOIN benchmark b USING (item_id)")
def word_overlap_of_all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("doc_id", "item_id", evaluate.word_overlap(F.col("expected"), F.col("text")).alias("overlap"))


@query(
    f"""WITH {ITEMS}, s AS (SELECT doc_id, text, item_id, least(length(text) // 2, 5000) AS a, least(length(text), length(text) // 2 + 60) AS z FROM t)
    SELECT s.doc_id AS case_id, s.doc_id, coalesce(substring(s.text, a + 1, z - a), b.text) AS truth, substring(s.text, a + 1, z - a) = b.text AS agrees FROM s JOIN benchmark b USING (item_id)"""
)
def ground_truth_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    cases = asked(spark, sf_dir).select(F.col("doc_id").alias("case_id"), "doc_id", F.least(F.floor(n / 2), F.lit(5000)).cast("int").alias("start_char"), F.least(n, F.floor(n / 2) + 60).cast("int").alias("end_char"), "expected")
    return evaluate.span_text(cases, table(spark, sf_dir, "documents"))


@query(
    f"""WITH s AS (SELECT page_id AS doc_id, {_strip_tags_sql()} AS text FROM pages WHERE html IS NOT NULL), o AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first_doc FROM s)
    SELECT doc_id, CASE WHEN text = '' THEN 'failed' WHEN first_doc < doc_id THEN 'duplicate' ELSE 'completed' END AS status, length(text) // 4 AS tokens, sha256(text) AS text_sha256 FROM o"""
)
def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as taken in: stripped, hashed, its tokens counted; failed without text, duplicate behind the first page of the same text.

    The first page of a text comes from one sum by its hash, and only hashes and numbers move.
    """
    pages = table(spark, sf_dir, "pages").filter("html IS NOT NULL").select(F.col("page_id").alias("doc_id"), tx.strip_tags(F.col("html")).alias("text"))
    rows = pages.select("doc_id", tk.char_tokens(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("text_sha256"), (F.col("text") == "").alias("empty"))
    first = rows.groupBy(F.col("text_sha256").alias("__h")).agg(F.min("doc_id").alias("first_doc"))
    status = F.when(F.col("empty"), "failed").when(F.col("first_doc") < F.col("doc_id"), "duplicate").otherwise("completed")
    return rows.join(first, F.col("text_sha256") == F.col("__h")).select("doc_id", status.alias("status"), "tokens", "text_sha256")


#: Parents and depths in an outline; the nearest line above of a lower level.
OUTLINE = f"""{_ELEMENTS.replace("WITH legal", "WITH RECURSIVE legal", 1)}, o AS (SELECT a.doc_id, a.line_number, a.t, max(b.line_number) AS parent FROM (SELECT DISTINCT ON (doc_id, line_number) * FROM k) a LEFT JOIN k b ON b.doc_id = a.doc_id AND b.line_number < a.line_number AND b.level < a.level GROUP BY ALL),
d AS (SELECT doc_id, line_number, t, parent, 0::BIGINT AS depth FROM o WHERE parent IS NULL UNION ALL SELECT o.doc_id, o.line_number, o.t, o.parent, d.depth + 1 FROM o JOIN d ON d.doc_id = o.doc_id AND d.line_number = o.parent)"""


def _outline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline(spark, sf_dir).select(F.col("doc_id").alias("tree"), F.col("line_number").alias("line"), F.col("level").cast("int").alias("level"), F.col("numbering_type").alias("system"))


@query(f"{OUTLINE} SELECT doc_id, line_number, parent AS parent_line, depth, row_number() OVER (PARTITION BY doc_id, parent ORDER BY line_number) - 1 AS ord, t AS system FROM d")
def hierarchy_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's outline exported as nested JSON and read back."""
    texts = nested.export_nested(_outline_rows(spark, sf_dir), ["system"])
    back = nested.import_nested(texts, {"system": "string"})
    return back.select(F.col("tree").alias("doc_id"), F.col("line").alias("line_number"), F.col("parent").alias("parent_line"), "depth", "ord", "system")


@query(f"{OUTLINE} SELECT doc_id, count(*) AS n_objects, max(depth) + 1 AS levels FROM d GROUP BY doc_id")
def hierarchy_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects and levels of every document's nested JSON, counted in the text itself."""
    texts = nested.export_nested(_outline_rows(spark, sf_dir), ["system"])
    marks = F.regexp_extract_all("json", F.lit(r'"children":\[|\]'), F.lit(0))
    deep = F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, m: F.when(m == "]", F.struct((a["now"] - 1).alias("now"), a["most"].alias("most"))).otherwise(F.struct((a["now"] + 1).alias("now"), F.greatest(a["most"], a["now"] + 1).alias("most"))))
    return texts.select(F.col("tree").alias("doc_id"), F.regexp_count("json", F.lit('"line":')).cast("long").alias("n_objects"), deep["most"].cast("long").alias("levels"))


GRAFT = 7_000_000_000


@query(
    f"""WITH {NODES}, small AS (SELECT * FROM nodes WHERE node < {CUSTOMER}), sub AS (SELECT {GRAFT} + s_suppkey AS node, CASE WHEN s_suppkey % 10 <> 0 AND s_suppkey - s_suppkey % 10 >= (SELECT min(s_suppkey) FROM supplier) THEN {GRAFT} + s_suppkey - s_suppkey % 10 END AS parent, s_suppkey::BIGINT AS ord FROM supplier)
    SELECT node, parent, ord FROM small UNION ALL SELECT node, coalesce(parent, {NATION}), CASE WHEN parent IS NULL THEN ord + coalesce((SELECT max(ord) FROM small WHERE parent = {NATION}), -1) + 1 ELSE ord END FROM sub"""
)
def tree_graft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, ten under one, hung on the first nation."""
    s = F.col("s_suppkey").cast("long")
    rows = table(spark, sf_dir, "supplier").select(s.alias("s"))
    low = rows.agg(F.min("s").alias("low"))
    tens = F.col("s") - F.col("s") % 10
    sub = rows.crossJoin(F.broadcast(low)).select((F.col("s") + GRAFT).alias("node"), F.when((F.col("s") % 10 != 0) & (tens >= F.col("low")), tens + GRAFT).alias("parent"), F.col("s").alias("ord"))
    return nested.grafted(nodes(spark, sf_dir).filter(F.col("node") < CUSTOMER), sub, NATION)


@query(
    """WITH tree AS (SELECT c_nationkey AS tree, c_custkey AS node, c_custkey * 10 AS line FROM customer), root AS (SELECT tree, min(node) AS root FROM tree GROUP BY tree),
    new AS (SELECT o_custkey % 25 AS tree, 1000000000 + o_orderkey AS node, o_orderkey % 20000 AS line, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS wanted FROM orders)
    SELECT new.tree, new.node, coalesce(w.node, (SELECT max(t.node) FROM tree t WHERE t.tree = new.tree AND t.line <= new.line), root) AS parent FROM new LEFT JOIN tree w ON w.tree = new.tree AND w.node = new.wanted LEFT JOIN root ON root.tree = new.tree"""
)
def tree_bulk_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders put into the trees of customers by nation: under the wanted customer, else by the nearest line, else under the root."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("tree"), F.col("c_custkey").alias("node"), (F.col("c_custkey") * 10).alias("line"))
    roots = customer.groupBy("tree").agg(F.min("node").alias("root"))
    tree = customer.join(F.broadcast(roots), "tree").select("tree", "node", F.when(F.col("node") != F.col("root"), F.col("root")).alias("parent"), "line")
    orders = table(spark, sf_dir, "orders")
    rows = orders.select((F.col("o_custkey") % 25).alias("tree"), (F.col("o_orderkey") + 1_000_000_000).alias("node"), (F.col("o_orderkey") % 20_000).alias("line"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("wanted"))
    return nested.bulk_inserted(tree, rows).filter("inserted").select("tree", "node", "parent")


@query(
    """SELECT unnest(['error', 'error', 'warning', 'warning']) AS severity, unnest(['has_id', 'has_text', 'length_agrees', 'known_language']) AS rule, count(*) AS n_rows,
    unnest([count(*) FILTER (doc_id IS NULL), count(*) FILTER (trim(coalesce(text, ''), ' ') = ''), count(*) FILTER (n_chars IS DISTINCT FROM length(text) OR text IS NULL), count(*) FILTER (coalesce(lang NOT IN ('en', 'de'), true))]) AS n_broken FROM documents"""
)
def document_rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "has_id": ("error", F.col("doc_id").isNotNull()),
        "has_text": ("error", F.trim("text") != ""),
        "length_agrees": ("warning", F.col("n_chars") == F.length("text")),
        "known_language": ("warning", F.col("lang").isin("en", "de")),
    }
    return dataset.rule_report(table(spark, sf_dir, "documents"), rules)
