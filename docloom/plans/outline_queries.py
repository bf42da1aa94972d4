"""Multi-line headings and splitting by a text's own separators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import WHITE
from docloom.operators import chunks, multiline, separators, structure
from docloom.plans.base import registry, table
from docloom.plans.chunk_queries import NUMBERED, legal

QUERIES, SQL, query = registry()

_BARE = " || ".join(f"chr({ord(c)})" for c in WHITE)

#: A line at a time: the walk holds how many lines the heading before still covers. Cased letters are those with a capital or small form.
MULTILINE = rf"""WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS raw FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, i, raw, trim(raw, {_BARE}) AS line FROM l),
c AS (SELECT *, regexp_matches(line, '[\p{{Lu}}\p{{Lt}}]') AND NOT regexp_matches(line, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}][\p{{Lu}}\p{{Lt}}]') AND NOT regexp_matches(line, '(^|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}])\p{{Ll}}') AS title, regexp_matches(line, '\p{{Lu}}') AND NOT regexp_matches(line, '[\p{{Ll}}\p{{Lt}}]') AS upper FROM b),
k AS (SELECT *, line <> '' AND length(line) <= 80 AS fits, line <> '' AND length(line) < 50 AND (title OR upper) AS starts, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c),
m AS (SELECT *, 1 + coalesce(lead(fits) OVER w, false)::INT + (coalesce(lead(fits) OVER w, false) AND coalesce(lead(fits, 2) OVER w, false))::INT AS n FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, i, n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM m WHERE starts),
walk AS (SELECT doc_id, r, i, n, true AS taken, i + n AS free FROM s WHERE r = 1 UNION ALL SELECT s.doc_id, s.r, s.i, s.n, s.i >= walk.free, CASE WHEN s.i >= walk.free THEN s.i + s.n ELSE walk.free END FROM walk JOIN s ON s.doc_id = walk.doc_id AND s.r = walk.r + 1),
g AS (SELECT w.doc_id, w.i, w.n, min(m.start) AS start, max(m.start + length(m.raw)) AS "end", string_agg(m.line, ' ' ORDER BY m.i) AS title, bool_and(m.title) AS titles, bool_and(m.upper) AS uppers FROM walk w JOIN m ON m.doc_id = w.doc_id AND m.i >= w.i AND m.i < w.i + w.n WHERE w.taken AND w.n > 1 GROUP BY w.doc_id, w.i, w.n)
SELECT g.doc_id, g.i + 1 AS line_number, g.n::BIGINT AS n_lines, g.start::BIGINT AS start, g."end"::BIGINT AS "end", g.title, (least(8, 4 + CASE WHEN titles THEN 2 WHEN uppers THEN 3 ELSE 0 END + coalesce(b.line = '', false)::INT) / 10)::DOUBLE AS confidence
FROM g LEFT JOIN b ON b.doc_id = g.doc_id AND b.i = g.i + g.n WHERE length(g.title) <= 200"""


@query(MULTILINE)
def multiline_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiline.multiline_headings(table(spark, sf_dir, "documents"))


def _array(values) -> str:
    return "[" + ", ".join("'" + v.replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


#: Separators per document, from the same elements as the numbering queries.
RANKED = NUMBERED.replace("SELECT doc_id, CASE WHEN regexp_matches(value", "SELECT doc_id, line_number, element_type, value, CASE WHEN regexp_matches(value", 1) + f""", own AS (SELECT doc_id, level, unnest(list_concat(CASE WHEN value IS NULL THEN [] WHEN element_type = 'chapter' THEN list_transform(['CHAPTER ', 'Chapter ', ''], lambda x: x || value) WHEN element_type = 'article' THEN list_transform(['ARTICLE ', 'Article ', ''], lambda x: x || value)
WHEN element_type = 'section' THEN list_transform(['SECTION ', 'Section ', 'Sec. ', ''], lambda x: x || value) ELSE [] END, CASE element_type WHEN 'chapter' THEN ['CHAPTER ', 'Chapter '] WHEN 'article' THEN ['ARTICLE ', 'Article '] WHEN 'section' THEN ['SECTION ', 'Section ', 'Sec. ', '§ '] ELSE [] END)) AS lead FROM k),
tiers AS (SELECT DISTINCT doc_id, 0 AS tier, level::BIGINT AS level, '' AS system, -length(lead) AS a, chr(10) || chr(10) || lead AS separator FROM own
UNION ALL SELECT DISTINCT doc_id, 1, NULL, t, pos, sep FROM k JOIN (VALUES {', '.join(f"('{name}', {i}, {_array([x])}[1])" for name, leads in separators.NUMBERING_LEADS.items() for i, x in enumerate([chr(10) * 2 + y for y in leads] + list(separators.INLINE_LEADS.get(name, ()))))}) v(system, pos, sep) ON v.system = k.t WHERE value IS NOT NULL
UNION ALL SELECT doc_id, 2, NULL, '', pos, sep FROM (SELECT DISTINCT doc_id FROM own) d, (VALUES {', '.join(f"({i}, {_array([x])}[1])" for i, x in enumerate(separators.LEGAL_SEPARATORS))}) v(pos, sep)),
firsts AS (SELECT * FROM tiers QUALIFY row_number() OVER (PARTITION BY doc_id, separator ORDER BY tier, level, system, a) = 1)"""


@query(f"{RANKED} SELECT doc_id, tier, level, row_number() OVER (PARTITION BY doc_id ORDER BY tier, level, system, a, separator) - 1 AS place, separator FROM firsts")
def dynamic_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.ranked_separators(structure.elements(legal(spark, sf_dir)))


@query(f"{RANKED} SELECT tier, level, count(*) AS n_separators, count(DISTINCT separator) AS n_distinct, count(DISTINCT doc_id) AS n_docs FROM firsts GROUP BY tier, level")
def separator_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = separators.ranked_separators(structure.elements(legal(spark, sf_dir)))
    return ranked.groupBy("tier", "level").agg(F.count("*").alias("n_separators"), F.count_distinct("separator").alias("n_distinct"), F.count_distinct("doc_id").alias("n_docs"))


@query()
def chunk_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = legal(spark, sf_dir)
    return separators.split_dynamic(texts, structure.elements(texts))


CUTS = """WITH d AS (SELECT doc_id, text, length(text) // 3 AS third FROM documents WHERE text <> ''), w AS (SELECT doc_id, text, third, unnest(generate_series(0, greatest(0, ceil((length(text) - 1000) / 800.0))::BIGINT)) AS chunk_index FROM d),
c AS (SELECT doc_id, third, chunk_index, chunk_index * 800 AS s, substring(text, chunk_index * 800 + 1, 1000) AS content FROM w), p AS (SELECT *, third > s AND third < s + length(content) AS cut FROM c),
x AS (SELECT doc_id, chunk_index, 0 AS part, s AS start_char, CASE WHEN cut THEN left(content, third - s) ELSE content END AS content FROM p UNION ALL SELECT doc_id, chunk_index, 1, third, substring(content, third - s + 1) FROM p WHERE cut)"""


@query(f"{CUTS} SELECT doc_id, chunk_index, part, start_char, sha256(trim(content, {_BARE})) AS content_sha256 FROM x WHERE trim(content, {_BARE}) <> ''")
def chunk_boundary_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marks = docs.select("doc_id", F.floor(F.length("text") / 3).alias("start_char"), F.lit("section").alias("element_type"), F.lit(1).alias("level"))
    cut = separators.cut_at_elements(chunks.fixed_windows(docs, 250, 50), marks)
    return cut.select("doc_id", "chunk_index", "part", "start_char", F.sha2("content", 256).alias("content_sha256"))
