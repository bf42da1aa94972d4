"""Queries over the lines of texts and single rows of chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import WHITE
from docloom.operators import lines
from docloom.plans.base import registry, table

QUERIES, SQL, query = registry()


def _strip(x: str) -> str:
    """DuckDB's trim of all white space; the SQL names each code point."""
    return f"trim({x}, {' || '.join(f'chr({ord(c)})' for c in WHITE)})"


#: Written from the rules: which lines are headings, items or paragraphs.
LINES = f"""l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_number, unnest(string_split(text, chr(10))) AS raw FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, line_number, {_strip('raw')} AS line FROM l),
u AS (SELECT *, regexp_matches(line, '\\p{{Lu}}') AND NOT regexp_matches(line, '\\p{{Ll}}') AS upper, lower(line) AS low FROM b WHERE line <> ''),
h AS (SELECT *, length(line) <= 100 AND NOT (line LIKE '%.' AND length(line) > 50) AND regexp_matches(left(line, 1), '\\p{{Lu}}')
AND (low LIKE '%chapter%' OR low LIKE '%section%' OR low LIKE '%introduction%' OR low LIKE '%conclusion%' OR low LIKE '%abstract%' OR (upper AND length(line) > 3)) AS heading FROM u),
k AS (SELECT *, CASE WHEN heading THEN 'heading' WHEN regexp_matches(left(line, 1), '\\p{{Nd}}') AND (contains(left(line, 5), '.') OR contains(left(line, 5), ')')) THEN 'numbered' WHEN left(line, 1) IN ('•', '◦', '▪', '▫', '‣', '⁃', '-', '*') THEN 'bulleted' WHEN length(line) > 20 THEN 'paragraph' END AS kind,
CASE WHEN upper OR low LIKE '%chapter%' OR low LIKE '%part%' THEN 1 WHEN low LIKE '%section%' OR low LIKE '%introduction%' OR low LIKE '%conclusion%' THEN 2 ELSE 3 END AS level FROM h)"""


@query(
    f"""WITH {LINES} SELECT d.doc_id, count(*) FILTER (kind = 'heading') AS n_headings, count(*) FILTER (kind = 'heading' AND level = 1) AS n_top, count(*) FILTER (kind IN ('numbered', 'bulleted')) AS n_items, count(*) FILTER (kind = 'paragraph') AS n_paragraphs
    FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id"""
)
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_kinds(table(spark, sf_dir, "documents"))


@query(f"WITH {LINES} SELECT doc_id, line_number, kind, CASE WHEN kind = 'heading' THEN level END::BIGINT AS level, sha256(line) AS title_sha256 FROM k WHERE kind IS NOT NULL")
def line_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_elements(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "line_number", "kind", "level", F.sha2("title", 256).alias("title_sha256"))


STRUCTURE = f"""s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {_strip('p')}), lambda p: length(p) > 50) AS long,
len(regexp_extract_all(text, '(?m)^#{{1,6}}\\s+.+$')) AS n_marked, len(regexp_extract_all(text, '(?m)^\\s*[-*+]\\s+.+$|^\\s*\\d+\\.\\s+.+$')) AS n_listed FROM documents WHERE text IS NOT NULL)"""


@query(
    f"""WITH {STRUCTURE} SELECT doc_id, n_marked, len(long) AS n_long, n_listed, n_marked > 0 AS has_headings, len(long) > 2 AS has_paragraphs, n_listed > 0 AS has_lists, round(coalesce(list_sum(list_transform(long, lambda p: length(p))), 0) / greatest(1, len(long)), 6) AS avg_long FROM s"""
)
def split_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", *[c.alias(k) for k, c in lines.split_structure(F.col("text")).items()])


@query(f"WITH {STRUCTURE} SELECT doc_id, CASE WHEN n_marked > 0 THEN 'headings' WHEN len(long) > 2 THEN 'paragraphs' ELSE 'basic' END AS plan FROM s")
def split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", lines.split_plan(F.col("text")).alias("plan"))


@query(
    """WITH d AS (SELECT doc_id, text, substring(text, length(text) // 2 + 1, 30) AS passage FROM documents WHERE length(text) > 1)
    SELECT doc_id, strpos(text, passage) - 1 AS start, strpos(text, passage) - 1 + length(passage) AS "end", trim(substring(text, strpos(text, passage), length(passage)), ' ') = trim(passage, ' ') AS valid FROM d"""
)
def passage_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("length(text) > 1")
    docs = docs.select("doc_id", "text", F.expr("substring(text, length(text) div 2 + 1, 30) AS passage"))
    return docs.select("doc_id", *[c.alias(k) for k, c in lines.passage_positions(F.col("text"), F.col("passage")).items()])


@query("SELECT doc_id, round(strlen(text)::DOUBLE * 1000 / 1048576.0, 1) AS megabytes FROM documents")
def file_size_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", lines.megabytes(F.octet_length("text").cast("double") * 1000).alias("megabytes"))


@query("SELECT conv_id, role, text FROM conversations WHERE turn = 1")
def chunk_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("turn = 1").select("conv_id", "role", "text")


@query("SELECT conv_id, max(turn)::BIGINT + 1 AS next_index FROM conversations GROUP BY conv_id")
def next_chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn").cast("long") + 1).alias("next_index"))
