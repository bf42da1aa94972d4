"""Look-ups over outlines, and what their numbering tells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import builders, outline, structure
from docloom.plans.base import registry, table
from docloom.plans.chunk_queries import PLACED, legal

QUERIES, SQL, query = registry()


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.elements(legal(spark, sf_dir))


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements(spark, sf_dir).select(F.col("doc_id").alias("tree"), F.col("line_number").alias("line"), F.col("level").cast("int").alias("level"))
    return builders.outline_parents(rows).select(F.col("tree").alias("doc_id"), F.col("line").alias("line_number"), F.col("parent").alias("parent_line"))


@query(f"{PLACED} SELECT doc_id, line_number, element_type, title FROM sc WHERE element_type IN ('section', 'subsection') AND contains(lower(title), 'terms')")
def elements_by_type_and_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.find_elements(elements(spark, sf_dir), outline.SECTIONS, text="Terms").select("doc_id", "line_number", "element_type", "title")


@query(f"{PLACED} SELECT doc_id, line_number, level::BIGINT AS level, title FROM sc WHERE level = 0")
def elements_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.find_elements(elements(spark, sf_dir), level=0).select("doc_id", "line_number", "level", "title")


@query(f"{PLACED} SELECT doc_id, value AS full_number, min(line_number) AS line_number FROM sc WHERE value IN ('1.1', '2.2', 'V') GROUP BY doc_id, value")
def element_by_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = elements(spark, sf_dir).select("doc_id", F.col("value").alias("full_number"), "line_number")
    wanted = numbers.select("doc_id").distinct().withColumn("full_number", F.explode(F.array(F.lit("1.1"), F.lit("2.2"), F.lit("V"))))
    return outline.first_numbered(numbers, wanted)


@query("SELECT o_custkey AS doc_id, o_orderkey % 5 AS line_number, arg_max(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS node FROM orders GROUP BY 1, 2")
def node_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nodes of their customer's outline at five lines, registered by date."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 5).alias("line_number"), F.col("o_orderkey").alias("node"), F.col("o_orderdate").alias("registered"))
    return outline.at_line(rows)


@query(
    f"""{PLACED.replace("WITH legal", "WITH RECURSIVE legal", 1)}, o AS (SELECT a.doc_id, a.line_number, a.value, max(b.line_number) AS parent FROM sc a LEFT JOIN sc b ON b.doc_id = a.doc_id AND b.line_number < a.line_number AND b.level < a.level GROUP BY ALL),
    d AS (SELECT doc_id, line_number, value AS full_number, [value] AS path FROM o WHERE parent IS NULL UNION ALL SELECT o.doc_id, o.line_number, d.full_number || '.' || o.value, list_append(d.path, o.value) FROM o JOIN d ON d.doc_id = o.doc_id AND d.line_number = o.parent)
    SELECT doc_id, line_number, full_number, array_to_string(path, '/') AS path FROM d"""
)
def full_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outline.full_numbers(elements(spark, sf_dir), parents(spark, sf_dir))
    return rows.select("doc_id", "line_number", "full_number", F.array_join("path", "/").alias("path"))


@query(f"{PLACED}, t8 AS (SELECT unnest(['article', 'chapter', 'clause', 'heading', 'list_item', 'paragraph', 'section', 'subsection']) AS element_type) SELECT d.doc_id, t8.element_type, count(sc.line_number) AS n FROM (SELECT DISTINCT doc_id FROM sc) d CROSS JOIN t8 LEFT JOIN sc ON sc.doc_id = d.doc_id AND sc.element_type = t8.element_type GROUP BY d.doc_id, t8.element_type")
def element_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.type_counts(elements(spark, sf_dir))


@query(f"{PLACED}, x AS (SELECT doc_id, confidence AS c FROM sc UNION ALL SELECT doc_id, 0.8 FROM sc WHERE value IS NOT NULL) SELECT doc_id, count(*) AS n_scores, round(avg(c), 6) AS confidence FROM x GROUP BY doc_id")
def structure_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = elements(spark, sf_dir).withColumn("number_confidence", F.when(F.col("value").isNotNull(), outline.BASE_CONFIDENCE))
    return outline.structure_confidence(scored)


_PARTS = (
    PLACED
    + r""", rv AS (SELECT *, list_transform(string_split(upper(value), ''), lambda c: CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 END) AS v FROM sc WHERE value IS NOT NULL),
pn AS (SELECT doc_id, line_number, t, CASE WHEN t = 'decimal' THEN list_transform(string_split(value, '.'), lambda x: x::BIGINT) WHEN t LIKE 'roman%' THEN [list_sum(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN v[i] < coalesce(v[i + 1], 0) THEN -v[i] ELSE v[i] END))::BIGINT] WHEN t LIKE 'letter%' THEN [(ord(upper(value)) - 64)::BIGINT] ELSE [] END AS parts FROM rv)"""
)


@query(f"{_PARTS} SELECT doc_id, t AS numbering_type, greatest(len(parts) - 1, 0) AS level, count(*) AS n FROM pn GROUP BY ALL")
def numbering_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.numbering_distribution(elements(spark, sf_dir))


@query(
    f"""{_PARTS}, f AS (SELECT doc_id, count(*) AS n_numbers, count(DISTINCT t) AS n_types, max(greatest(len(parts) - 1, 0)) + 1 AS depth, count(DISTINCT greatest(len(parts) - 1, 0)) AS n_levels, round(avg((len(parts) <= 1)::INT), 6) AS top_share FROM pn GROUP BY doc_id),
    q AS (SELECT *, len(parts) - 1 AS lv, parts[1:len(parts) - 1] AS head, parts[1] AS v FROM pn WHERE len(parts) > 0), h AS (SELECT q.*, lv > 0 AND NOT EXISTS (SELECT 1 FROM q p WHERE p.doc_id = q.doc_id AND p.parts = q.head) AS orphan FROM q),
    s AS (SELECT doc_id, v - lag(v) OVER (PARTITION BY doc_id, lv, head ORDER BY v, line_number) AS step FROM h WHERE NOT orphan), a AS (SELECT doc_id, count(*) FILTER (step > 1) AS n_gaps, count(*) FILTER (step = 0) AS n_duplicates FROM s GROUP BY doc_id),
    o AS (SELECT doc_id, count(DISTINCT lv) FILTER (orphan) AS n_issues FROM h GROUP BY doc_id), z AS (SELECT f.*, coalesce(n_gaps, 0) AS n_gaps, coalesce(n_duplicates, 0) AS n_duplicates, coalesce(n_issues, 0) AS n_issues FROM f LEFT JOIN a USING (doc_id) LEFT JOIN o USING (doc_id)),
    w AS (SELECT *, list_filter([CASE WHEN n_gaps + n_duplicates + n_issues > 0 OR n_types > 3 THEN 'Numbering sequence validation failed' END, CASE WHEN n_gaps > 0 THEN 'Found ' || n_gaps || ' gaps in numbering' END, CASE WHEN n_duplicates > 0 THEN 'Found ' || n_duplicates || ' duplicate numbers' END,
    CASE WHEN n_issues > 0 THEN 'Found ' || n_issues || ' structural issues' END, CASE WHEN depth > 5 THEN 'Deep hierarchy detected (' || depth || ' levels) - consider restructuring' END, CASE WHEN n_types > 3 THEN 'Multiple numbering types detected - ensure consistency' END, CASE WHEN n_levels > 1 AND top_share < 0.3 THEN 'Consider adding more top-level sections' END], lambda x: x IS NOT NULL) AS given FROM z)
    SELECT doc_id, n_numbers, n_types, depth, top_share, n_gaps, n_duplicates, n_issues, array_to_string(CASE WHEN len(given) > 0 THEN given ELSE ['Numbering structure appears well-organized'] END, '; ') AS advice FROM w"""
)
def numbering_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.numbering_advice(elements(spark, sf_dir)).withColumn("advice", F.array_join("advice", "; "))


@query(
    f"""{PLACED}, o AS (SELECT a.doc_id, a.line_number, a.title, max(b.line_number) AS parent FROM sc a LEFT JOIN sc b ON b.doc_id = a.doc_id AND b.line_number < a.line_number AND b.level < a.level GROUP BY ALL)
    SELECT doc_id, parent AS source, line_number AS target, 'parent_child' AS kind, true AS bidirectional, 0.95::DOUBLE AS confidence, 0.9::DOUBLE AS similarity FROM o WHERE parent IS NOT NULL"""
)
def edges_from_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements(spark, sf_dir).select("doc_id", F.col("line_number").alias("element"), F.col("title").alias("text"), "line_number")
    over = rows.select("doc_id", F.col("line_number").alias("parent_line"), F.col("text").alias("parent_text"))
    given = rows.join(parents(spark, sf_dir), ["doc_id", "line_number"]).join(over, ["doc_id", "parent_line"], "left")
    return outline.edges_from_parents(given)


@query(
    r"""WITH RECURSIVE s AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS piece, length(unnest(x)) // 4 AS m FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\s\x0b]+', '\1' || chr(1), 'g'), chr(1)), lambda p: trim(p, ' ')), lambda p: length(p) >= 2) AS x FROM documents)),
    walk AS (SELECT doc_id, i, 1::BIGINT AS g, CASE WHEN m >= 20 OR m >= 60 THEN 0 ELSE m END AS total, m < 20 AS open FROM s WHERE i = 0
    UNION ALL SELECT s.doc_id, s.i, CASE WHEN open AND s.m < 20 THEN g ELSE g + 1 END, CASE WHEN s.m >= 20 THEN 0 WHEN open THEN total + s.m ELSE s.m END, s.m < 20 AND CASE WHEN open THEN total + s.m ELSE s.m END < 60 FROM walk JOIN s ON s.doc_id = walk.doc_id AND s.i = walk.i + 1),
    j AS (SELECT s.doc_id, g, count(*) AS n_merged, string_agg(piece, chr(10) || chr(10) ORDER BY s.i) AS content FROM s JOIN walk USING (doc_id, i) GROUP BY s.doc_id, g),
    p AS (SELECT *, CASE WHEN n_merged = 1 THEN greatest(1, ceil((length(content) // 4) / 100.0))::BIGINT ELSE 1 END AS parts FROM j), q AS (SELECT *, ceil(length(content) / parts)::BIGINT AS width, unnest(range(0, parts)) AS part FROM p)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, part) - 1 AS chunk_index, substring(content, part * width + 1, width) AS content, n_merged, length(substring(content, part * width + 1, width)) // 4 AS tokens FROM q"""
)
def chunk_sizes_optimised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as chunks, brought to sizes from 20 to 100 tokens."""
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("chunk_index", "content"))
    return outline.optimised_sizes(pieces, 20, 60, 100, ends=" ")


@query(
    """WITH a AS (SELECT p_size AS tree, p_partkey * 2 AS line, p_partkey % 5 AS level, 0 AS origin FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_size AS tree, p_partkey + 1 AS line, p_partkey % 3 AS level, 1 AS origin FROM part WHERE p_partkey % 3 = 0)
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY line, origin, level) - 1 AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b)"""
)
def trees_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    first = part.filter(k % 2 == 0).select(F.col("p_size").alias("tree"), (k * 2).alias("line"), (k % 5).alias("level"))
    second = part.filter(k % 3 == 0).select(F.col("p_size").alias("tree"), (k + 1).alias("line"), (k % 3).alias("level"))
    return outline.interleaved(first, second)
