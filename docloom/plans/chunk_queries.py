"""Chunking and structure over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import numbering
from docloom.functions import tokens as tk
from docloom.operators import chunks, quality, spans, structure
from docloom.plans.base import registry, table

QUERIES, SQL, query = registry()

WINDOWS = """WITH w AS (SELECT doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 1000) / 800.0))::BIGINT)) AS chunk_index FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, chunk_index, chunk_index * 800 AS start_char, substring(text, chunk_index * 800 + 1, 1000) AS content FROM w)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.fixed_windows(table(spark, sf_dir, "documents"), 250, 50)


@query(f"{WINDOWS} SELECT doc_id, chunk_index, start_char, start_char + length(content) AS end_char, sha256(content) AS content_hash FROM c")
def chunk_fixed_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir).select("doc_id", "chunk_index", "start_char", "end_char", F.sha2("content", 256).alias("content_hash"))


@query(
    f"{WINDOWS} SELECT count(*) AS total_chunks, sum(length(content))::BIGINT AS total_chars, round(avg(length(content)), 4) AS avg_chars, min(length(content)) AS min_chars, max(length(content)) AS max_chars, sum(length(content) // 4)::BIGINT AS total_tokens FROM c"
)
def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.summary(windows(spark, sf_dir))


@query(
    f"""{WINDOWS}, s AS (SELECT length(content) // 4 AS s FROM c) SELECT count(*) AS total_chunks, sum(s)::BIGINT AS total_tokens, round(avg(s), 4) AS average, min(s) AS minimum, max(s) AS maximum,
    count(*) FILTER (s BETWEEN 150 AND 240) AS within_target, count(*) FILTER (s < 50) AS too_small, count(*) FILTER (s >= 50 AND s < 150) AS small_but_acceptable, count(*) FILTER (s > 250) AS too_large, count(*) FILTER (s > 240 AND s <= 250) AS large_but_acceptable,
    list_sort(list(s))[count(*) // 2 + 1] AS median, round(count(*) FILTER (s BETWEEN 150 AND 240) * 100 / count(*), 4) AS efficiency FROM s"""
)
def chunk_size_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.size_report(windows(spark, sf_dir), tk.char_tokens(F.col("content")), 50, (150, 240), 250)


@query()
def chunk_split_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.split_large(table(spark, sf_dir, "documents"))


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.split_recursive(table(spark, sf_dir, "documents"))


@query()
def chunk_semantic_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.pack_sentences(table(spark, sf_dir, "documents"), 200)


@query()
def chunk_paragraph_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return chunks.pack_paragraphs(docs, 1500, overlap=True)


@query("SELECT d.doc_id, 0::BIGINT AS section, 0::BIGINT AS level, '' AS title, d.source AS content FROM documents d UNION ALL SELECT doc_id, 1, 2, lang, 'n ' || n_chars FROM documents")
def chunk_by_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("source", F.lit("\n## "), "lang", F.lit("\nn "), F.col("n_chars").cast("string"))
    return chunks.by_headings(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))


LEGAL = """WITH legal AS (SELECT doc_id, 'ARTICLE ' || (['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX'])[doc_id % 20 + 1] || chr(10) || chr(10) || 'Section ' || (doc_id % 9 + 1) || '.' || (doc_id % 4 + 1)
|| ' General Terms' || chr(10) || chr(10) || '(a) ' || string_split(text, chr(10))[1] || chr(10) || chr(10) || 'Pursuant to Section ' || (doc_id % 9 + 1) || ', subject to § ' || (doc_id % 7 + 1) || '.2' || chr(10) || chr(10) || coalesce(text, '') AS text FROM documents)"""


def legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.legal_view(table(spark, sf_dir, "documents"))


@query(f"{LEGAL} SELECT doc_id, sha256(text) AS text_hash FROM legal")
def legal_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legal(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("text_hash"))


def _pattern_sql() -> str:
    parts = []
    for category, names in structure.PATTERNS.items():
        for name, pattern in names.items():
            found = f"len(regexp_extract_all(text, '{structure.pattern_flags(name)}{pattern}'))"
            if name == "whitespace_only":  # of a run of blank lines the last one counts by itself if it is empty; empty matches differ between engines
                blank, line = "NOT regexp_matches({}, '\\S')".format, "string_split(text, chr(10))"
                first = f"(i = 1 OR NOT coalesce({blank('x[i - 1]')}, false))"
                last = f"(x[i] = '' AND i > 1 AND {blank('x[i - 1]')} AND (i = len(x) OR NOT {blank('x[i + 1]')}))"
                found = f"list_sum(list_transform([{line}], lambda x: list_sum(list_transform(range(1, len(x) + 1), lambda i: ({blank('x[i]')} AND {first})::INT + {last}::INT))))"
            parts.append(f"SELECT '{category}' AS category, '{name}' AS pattern, count(*) FILTER ({found} > 0) AS n_docs, sum({found})::BIGINT AS n_matches FROM legal")
    return LEGAL + " UNION ALL ".join(parts)


@query(_pattern_sql())
def pattern_counts_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.pattern_counts(legal(spark, sf_dir))


ELEMENTS = (
    LEGAL
    + r""", l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_number, trim(unnest(string_split(text, chr(10)))) AS title FROM legal),
e AS (SELECT *, CASE WHEN regexp_matches(title, '(?i)^article\s+([IVXLCDM]+|\d+)\b') THEN 'article' WHEN regexp_matches(title, '(?i)^chapter\s+([IVXLCDM]+|\d+)\b') THEN 'chapter' WHEN regexp_matches(title, '(?i)^section\s+\d+(\.\d+)*\b') THEN 'section'
WHEN regexp_matches(title, '^§\s*\d+') THEN 'section' WHEN regexp_matches(title, '^\([A-Za-z0-9]+\)') THEN 'list_item' END AS element_type,
coalesce(nullif(regexp_extract(title, '(?i)^(?:article|chapter)\s+([IVXLCDM]+|\d+)\b', 1), ''), nullif(regexp_extract(title, '(?i)^section\s+(\d+(?:\.\d+)*)', 1), ''), nullif(regexp_extract(title, '^§\s*(\d+(?:\.\d+)*)', 1), ''), nullif(regexp_extract(title, '^\(([A-Za-z0-9]+)\)', 1), '')) AS value FROM l)"""
)


@query(f"{ELEMENTS} SELECT doc_id, line_number, element_type, value FROM e WHERE element_type IS NOT NULL")
def structure_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.elements(legal(spark, sf_dir)).select("doc_id", "line_number", "element_type", "value")


@query()
def heading_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.with_parents(structure.elements(legal(spark, sf_dir))).drop("parts")


@query()
def line_format_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.format_headings(legal(spark, sf_dir))


@query()
def numbering_validate_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.sequence_gaps(structure.elements(legal(spark, sf_dir)))


@query(
    """WITH n AS (SELECT p_brand AS b, p_size AS s FROM part), d AS (SELECT b, s, s - lag(s) OVER (PARTITION BY b ORDER BY s) AS step FROM n) SELECT b AS brand, count(*) AS n_numbers, count(*) FILTER (step = 0) AS n_duplicates, count(*) FILTER (step > 1) AS n_gaps FROM d GROUP BY b"""
)
def numbering_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.lit(0).alias("doc_id"), F.col("p_brand").alias("element_type"), F.array(F.col("p_size").cast("int")).alias("parts"))
    return structure.sequence_gaps(rows).select(F.col("element_type").alias("brand"), "n_numbers", "n_duplicates", "n_gaps")


@query("SELECT a.p_partkey AS child, b.p_partkey AS parent FROM part a JOIN part b ON b.p_partkey = a.p_partkey // 10 AND b.p_partkey > 0")
def numbering_parent_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.split(F.col("p_partkey").cast("string"), ""), lambda c: c != "")
    rows = table(spark, sf_dir, "part").select("p_partkey", parts.alias("parts"))
    above = rows.select(F.col("p_partkey").alias("parent"), F.col("parts").alias("head"))
    below = rows.filter(F.size("parts") > 1).withColumn("head", F.expr("slice(parts, 1, size(parts) - 1)"))
    joined = below.join(above, "head").filter(numbering.is_parent(F.col("head"), F.col("parts")))
    return joined.select(F.col("p_partkey").alias("child"), "parent")


HALVES = """h AS (SELECT doc_id, 0 AS element, 0 AS es, length(text) // 3 AS ee FROM documents UNION ALL SELECT doc_id, 1, length(text) // 3, length(text) FROM documents),
o AS (SELECT c.doc_id, c.chunk_index, h.element, least(ee, start_char + length(content)) - greatest(es, start_char) AS overlap, es FROM c JOIN h ON c.doc_id = h.doc_id AND es < start_char + length(content) AND ee > start_char)"""


def thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, n = F.floor(F.length("text") / 3), F.length("text").cast("long")
    spans_of = F.array(F.struct(F.lit(0).alias("element"), F.lit(0).cast("long").alias("start_char"), cut.alias("end_char")), F.struct(F.lit(1).alias("element"), cut.alias("start_char"), n.alias("end_char")))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(spans_of).alias("x")).select("doc_id", "x.*")


@query(f"{WINDOWS}, {HALVES} SELECT doc_id, chunk_index, arg_max(element, overlap * 1000000 - es)::INT AS element, max(overlap) AS overlap FROM o GROUP BY doc_id, chunk_index")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.best_overlap(windows(spark, sf_dir), thirds(spark, sf_dir))


@query(f"{WINDOWS} SELECT c.doc_id, chunk_index, 1::BIGINT AS n_violations FROM c JOIN documents d USING (doc_id) WHERE length(d.text) // 3 > start_char AND length(d.text) // 3 < start_char + length(content)")
def boundary_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.length("text") / 3).alias("pos"), F.lit(True).alias("is_section"), F.lit(1).alias("level"))
    return spans.boundary_violations(windows(spark, sf_dir), marks)


@query(f"{WINDOWS} SELECT c.doc_id, chunk_index, CASE WHEN length(d.text) > 3000 THEN least(start_char // 2500 + 1, greatest(1, length(d.text) // 2500 + 1)) END AS page FROM c JOIN documents d USING (doc_id)")
def page_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    return windows(spark, sf_dir).join(lengths, "doc_id").select("doc_id", "chunk_index", spans.estimated_page(F.col("start_char"), F.col("n")).alias("page"))


@query(f"{WINDOWS} SELECT 'blank_text' AS name, count(*) AS n FROM c WHERE trim(content) = '' HAVING count(*) > 0")
def validate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(quality.check_chunks(windows(spark, sf_dir)))


@query(f"{WINDOWS} SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS seq FROM c WHERE length(trim(content)) >= 100")
def chunk_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.size_filter(windows(spark, sf_dir)).select("doc_id", "chunk_index", "seq")


@query(
    r"""WITH t AS (SELECT doc_id, 'head' || chr(10) || 'Section 1 ' || source || chr(10) || '§ 2 ' || lang AS text FROM documents), p AS (SELECT doc_id, string_split_regex(text, '(?i)\n\s*(?:section|§)\s*\d+') AS parts FROM t),
    x AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS section, unnest(parts) AS part FROM p) SELECT doc_id, section, length(part) // 4 AS tokens, CASE WHEN length(part) > 50 THEN left(part, 50) || '...' ELSE part END AS preview FROM x"""
)
def section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("head\nSection 1 "), "source", F.lit("\n§ 2 "), "lang")
    return chunks.section_tokens(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))


@query(
    f"""{WINDOWS} SELECT d.lang AS kind, count(*) AS n_chunks, count(*) FILTER (length(content) < 500) AS n_small, count(*) FILTER (length(content) BETWEEN 500 AND 1499) AS n_medium, count(*) FILTER (length(content) >= 1500) AS n_large,
    sum(length(content) // 4)::BIGINT AS total_tokens FROM c JOIN documents d USING (doc_id) GROUP BY d.lang"""
)
def chunk_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return chunks.distribution(windows(spark, sf_dir).join(docs, "doc_id"), F.col("lang"))


@query()
def chunk_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = legal(spark, sf_dir)
    found = structure.elements(texts).select("doc_id", F.col("start_char").alias("pos"))
    return chunks.hierarchical(texts.select("doc_id", "text"), found)


@query()
def heading_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.headings(legal(spark, sf_dir))


NUMBERED = ELEMENTS + r""", k AS (SELECT doc_id, CASE WHEN regexp_matches(value, '^\d+(\.\d+)*$') THEN 'decimal' WHEN regexp_matches(value, '^[IVXLCDM]+$') THEN 'roman_upper' WHEN regexp_matches(value, '^[ivxlcdm]+$') THEN 'roman_lower' WHEN regexp_matches(value, '^[A-Z]$') THEN 'letter_upper'
WHEN regexp_matches(value, '^[a-z]$') THEN 'letter_lower' ELSE 'mixed' END AS t, CASE WHEN element_type IN ('article', 'chapter') THEN 0 WHEN element_type = 'section' THEN len(string_split(value, '.')) ELSE 3 END AS level FROM e WHERE element_type IS NOT NULL)"""


@query(f"{NUMBERED} SELECT doc_id, count(*) AS n_numbers, max(level) + 1 AS depth, round(avg(level), 6) AS avg_level, count(DISTINCT t) AS n_types, min(t) AS main_type FROM k GROUP BY doc_id")
def numbering_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.numbering_statistics(structure.elements(legal(spark, sf_dir)))


@query(f"SELECT category, count(*) AS n_patterns, count(*) FILTER (n_matches > 0) AS n_used, sum(n_matches)::BIGINT AS n_matches FROM ({_pattern_sql()}) GROUP BY category")
def pattern_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.coverage(structure.pattern_counts(legal(spark, sf_dir)))


@query()
def pattern_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.pattern_positions(legal(spark, sf_dir))


#: Elements with numbering, place and confidence, and their parents; written from the rules.
PLACED = NUMBERED.replace("SELECT doc_id, CASE WHEN regexp_matches(value", "SELECT doc_id, line_number, title, element_type, value, CASE WHEN regexp_matches(value", 1) + r""", st AS (SELECT doc_id, line_number, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char
FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_number, unnest(string_split(text, chr(10))) AS line FROM legal)),
sc AS (SELECT k.*, start_char, round(least(1.0, CASE WHEN element_type = 'list_item' THEN 0.5 ELSE 0.8 END + CASE WHEN t = 'decimal' THEN 0.2 ELSE 0 END + CASE WHEN length(title) < 10 THEN 0.1 WHEN length(title) > 100 THEN -0.2 ELSE 0 END), 4)::DOUBLE AS confidence FROM k JOIN st USING (doc_id, line_number))"""

FORMATTED = r"""fl AS (SELECT doc_id, line_number, line, lag(line) OVER w AS before, lead(line) OVER w AS after FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_number, unnest(string_split(text, chr(10))) AS line FROM legal) WINDOW w AS (PARTITION BY doc_id ORDER BY line_number)),
fb AS (SELECT *, trim(line, ' ') AS title, trim(coalesce(after, ''), ' ') AS under, length(line) - length(ltrim(line, ' ')) AS lead_n, length(line) - length(rtrim(line, ' ')) AS trail_n FROM fl),
fm AS (SELECT doc_id, line_number, title, regexp_matches(title, '\p{Lu}') AND NOT regexp_matches(title, '\p{Ll}') AS is_caps, regexp_matches(title, '\p{Lu}') AND NOT regexp_matches(title, '\p{L}\p{Lu}') AND NOT regexp_matches(title, '(^|\P{L})\p{Ll}') AS is_title_case,
lead_n > 4 AND abs(lead_n - trail_n) <= 2 AS is_centered, regexp_matches(under, '^(-+|=+|_+|~+|\*+)$') AND abs(length(under) - length(title)) <= 2 AS is_underlined, trim(coalesce(before, ''), ' ') = '' AND under = '' AS is_standalone FROM fb WHERE length(title) BETWEEN 1 AND 200),
ff AS (SELECT *, round(least(0.9, 0.2 + is_caps::INT * 0.3 + is_title_case::INT * 0.2 + is_centered::INT * 0.2 + is_underlined::INT * 0.3 + is_standalone::INT * 0.1), 4)::DOUBLE AS confidence FROM fm WHERE is_caps OR is_title_case OR is_centered OR is_underlined)"""

SQL["heading_final"] = f"""{PLACED} SELECT a.doc_id, a.line_number, a.start_char, a.title, a.element_type, a.value, a.t AS numbering_type, a.level::BIGINT AS level, a.confidence, max(b.line_number) AS parent_line
FROM sc a LEFT JOIN sc b ON b.doc_id = a.doc_id AND b.line_number < a.line_number AND b.level < a.level GROUP BY ALL"""

SQL["line_format_headings"] = f"{LEGAL}, {FORMATTED} SELECT * FROM ff"

SQL["heading_candidates"] = f"""{PLACED}, {FORMATTED}, both_kinds AS (SELECT doc_id, line_number, title, 'structure' AS origin, confidence FROM sc UNION ALL SELECT doc_id, line_number, title, 'format', confidence FROM ff)
SELECT doc_id, line_number, title, origin, confidence FROM both_kinds WHERE confidence >= 0.3 QUALIFY row_number() OVER (PARTITION BY doc_id, line_number ORDER BY confidence DESC, origin DESC) = 1"""

SQL["numbering_validate_gaps"] = (
    PLACED
    + r""", rv AS (SELECT *, list_transform(string_split(upper(value), ''), lambda c: CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 END) AS v FROM k),
fn AS (SELECT doc_id, element_type, CASE WHEN t = 'decimal' THEN split_part(value, '.', 1)::BIGINT WHEN t LIKE 'roman%' THEN list_sum(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN v[i] < coalesce(v[i + 1], 0) THEN -v[i] ELSE v[i] END))::BIGINT WHEN t LIKE 'letter%' THEN (ord(upper(value)) - 64)::BIGINT END AS f FROM rv),
gs AS (SELECT *, f - lag(f) OVER (PARTITION BY doc_id, element_type ORDER BY f) AS step FROM fn WHERE f IS NOT NULL) SELECT doc_id, element_type, count(*) AS n_numbers, count(*) FILTER (step = 0) AS n_duplicates, count(*) FILTER (step > 1) AS n_gaps FROM gs GROUP BY doc_id, element_type"""
)


def _packs_sql(pieces: str, size: int, carry: int, glue: str) -> str:
    """Packs by a walk over a document's pieces (doc_id, i, piece, m)."""
    kept = "m1" if carry == 1 else "m1 + CASE WHEN walk.i - 1 >= start THEN m2 ELSE 0 END"
    return f"""WITH RECURSIVE pieces AS ({pieces}), ps AS (SELECT *, coalesce(lag(m) OVER w, 0) AS m1, coalesce(lag(m, 2) OVER w, 0) AS m2, lead(i) OVER w IS NULL AS ends FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
walk AS (SELECT doc_id, i, 0::BIGINT AS start, m::BIGINT AS total, ends, NULL::BIGINT AS c_start, NULL::BIGINT AS c_n, NULL::BIGINT AS c_size FROM ps WHERE i = 0
UNION ALL SELECT ps.doc_id, ps.i, CASE WHEN total + ps.m > {size} THEN greatest(start, ps.i - {carry}) ELSE start END, CASE WHEN total + ps.m > {size} THEN {kept} + ps.m ELSE total + ps.m END, ps.ends,
CASE WHEN total + ps.m > {size} THEN start END, CASE WHEN total + ps.m > {size} THEN ps.i - start END, CASE WHEN total + ps.m > {size} THEN total END FROM walk JOIN ps ON ps.doc_id = walk.doc_id AND ps.i = walk.i + 1),
packs AS (SELECT doc_id, c_start AS start, c_n AS n, c_size AS size FROM walk WHERE c_start IS NOT NULL UNION ALL SELECT doc_id, start, i - start + 1, total FROM walk WHERE ends)
SELECT k.doc_id, row_number() OVER (PARTITION BY k.doc_id ORDER BY k.start, k.n) - 1 AS chunk_index, string_agg(p.piece, {glue} ORDER BY p.i) AS content, k.n AS n_pieces, k.size FROM packs k JOIN pieces p ON p.doc_id = k.doc_id AND p.i >= k.start AND p.i < k.start + k.n GROUP BY k.doc_id, k.start, k.n, k.size"""


SQL["chunk_paragraph_pack"] = _packs_sql(
    "SELECT doc_id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS piece, length(unnest(x)) AS m FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda p: trim(p, ' ')), lambda p: p <> '') AS x FROM documents)", 1500, 1, "chr(10) || chr(10)"
)
SQL["chunk_semantic_pack"] = _packs_sql(
    r"SELECT doc_id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS piece, length(unnest(x)) // 4 AS m FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\s\x0b]+', '\1' || chr(1), 'g'), chr(1)), lambda p: trim(p, ' ')), lambda p: length(p) >= 11) AS x FROM documents)", 200, 2, "' '"
)

SQL["chunk_split_large"] = r"""WITH RECURSIVE w AS (SELECT doc_id, text, 0::BIGINT AS chunk_index, 0::BIGINT AS s, CASE WHEN length(text) <= 4000 THEN NULL ELSE substring(text, 1, 4000) END AS win FROM documents WHERE length(text) > 0
UNION ALL SELECT doc_id, text, chunk_index + 1, n, CASE WHEN n + 4000 >= length(text) THEN NULL ELSE substring(text, n + 1, 4000) END FROM (SELECT *, greatest(s + 1, s + size - 200) AS n FROM (SELECT *, CASE WHEN a > 2800 THEN a + 2 WHEN b > 2800 THEN b + 2 WHEN c > 2800 THEN c + 2 ELSE 4000 END AS size FROM
(SELECT *, CASE WHEN contains(win, '. ') THEN 4000 - strpos(reverse(win), ' .') - 1 ELSE -1 END AS a, CASE WHEN contains(win, '.' || chr(10)) THEN 4000 - strpos(reverse(win), chr(10) || '.') - 1 ELSE -1 END AS b, CASE WHEN contains(win, chr(10) || chr(10)) THEN 4000 - strpos(reverse(win), chr(10) || chr(10)) - 1 ELSE -1 END AS c FROM w WHERE win IS NOT NULL))) WHERE n < length(text)),
e AS (SELECT *, CASE WHEN contains(win, '. ') THEN 4000 - strpos(reverse(win), ' .') - 1 ELSE -1 END AS a, CASE WHEN contains(win, '.' || chr(10)) THEN 4000 - strpos(reverse(win), chr(10) || '.') - 1 ELSE -1 END AS b, CASE WHEN contains(win, chr(10) || chr(10)) THEN 4000 - strpos(reverse(win), chr(10) || chr(10)) - 1 ELSE -1 END AS c FROM w)
SELECT doc_id, chunk_index, s AS start_char, CASE WHEN win IS NULL THEN substring(text, s + 1) ELSE substring(text, s + 1, CASE WHEN a > 2800 THEN a + 2 WHEN b > 2800 THEN b + 2 WHEN c > 2800 THEN c + 2 ELSE 4000 END) END AS content FROM e"""
