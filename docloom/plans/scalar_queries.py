"""Text, token and numbering functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import numbering as nb
from docloom.functions import text as tx
from docloom.functions import tokens as tk
from docloom.operators import corpus
from docloom.plans.base import registry, table

QUERIES, SQL, query = registry()

LINES = "string_split(text, chr(10))"
CLEAN = rf"regexp_replace(array_to_string(list_transform({LINES}, lambda x: regexp_replace(regexp_replace(x, '[\s\x0b\x{{85}}\p{{Z}}\x1c-\x1f]+', ' ', 'g'), '^ | $', '', 'g')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')"


@query(rf"SELECT doc_id, sha256(regexp_replace({CLEAN}, '^\s+|\s+$', '', 'g')) AS clean_hash, length(regexp_replace({CLEAN}, '^\s+|\s+$', '', 'g')) AS n_clean FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = tx.clean_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", clean.alias("clean")).select("doc_id", F.sha2("clean", 256).alias("clean_hash"), F.length("clean").cast("long").alias("n_clean"))


@query("SELECT doc_id, contains(text, '#') OR contains(text, '**') OR contains(text, '__') OR contains(text, '```') OR contains(text, '---') AS is_markdown FROM documents")
def markdown_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.is_markdown(F.col("text")).alias("is_markdown"))


def _strip_dangerous_sql() -> str:
    out = "html"
    for tag in tx.DANGEROUS_TAGS:
        out = f"regexp_replace(regexp_replace({out}, '(?is)<{tag}[^>]*>.*?</{tag}[^>]*>', '', 'g'), '(?is)</?{tag}[^>]*>', '', 'g')"
    return out


@query(f"SELECT page_id, sha256({_strip_dangerous_sql()}) AS safe_hash FROM pages")
def html_dangerous_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(tx.strip_dangerous(F.col("html")), 256).alias("safe_hash"))


def _strip_tags_sql() -> str:
    out = "html"
    for pattern in ("(?is)<!--.*?-->", "(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?s)<[^>]*>"):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{sign}')"
    return rf"trim(regexp_replace({out}, '[\s\x0b]+', ' ', 'g'))"


@query(f"SELECT page_id, sha256({_strip_tags_sql()}) AS text_hash, length({_strip_tags_sql()}) AS n_chars FROM pages")
def html_tag_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = tx.strip_tags(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", text.alias("t")).select("page_id", F.sha2("t", 256).alias("text_hash"), F.length("t").cast("long").alias("n_chars"))


@query("SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(html, '</[^>]*>', '', 'g'), '<[^>]*$', ''), '^[^<]*>', '')) AS rest_hash FROM pages")
def html_malformed_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(tx.strip_malformed(F.col("html")), 256).alias("rest_hash"))


@query("SELECT event_id, event_type AS kind, upper(event_type) AS title, user_id::VARCHAR AS user_id FROM events")
def metadata_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.create_map(F.lit(" Kind "), F.concat(F.lit(" "), "event_type"), F.lit("My Title"), F.upper("event_type"), F.lit("empty"), F.lit("  "), F.lit("User ID"), F.col("user_id").cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", tx.clean_map(raw).alias("m"))
    return rows.select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["my_title"].alias("title"), F.col("m")["user_id"].alias("user_id"))


@query("SELECT event_id, length(props) AS n_props, json_extract_string(props, '$.k') AS k FROM events")
def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.length("props").cast("long").alias("n_props"), F.get_json_object("props", "$.k").alias("k"))


SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 2)"


@query(f"SELECT doc_id, len({SENTENCES}) AS n_sentences, sha256(array_to_string({SENTENCES}, '|')) AS sentences_hash FROM documents")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tx.sentences(F.col("text"), ends=tx.SPACES)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n_sentences"), F.sha2(F.array_join(found, "|"), 256).alias("sentences_hash"))


@query(
    rf"""SELECT doc_id, length(text) AS char_count, len(list_filter(string_split_regex(text, '[\s\x0b]+'), lambda w: w <> '')) AS word_count, len({LINES}) AS line_count, len(list_filter({LINES}, lambda x: trim(x) = '')) AS empty_lines,
    list_max(list_transform({LINES}, lambda x: length(x))) AS max_line_length, round(list_sum(list_transform({LINES}, lambda x: length(x))) / len({LINES}), 6) AS avg_line_length FROM documents"""
)
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.line_statistics(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, length(text) // 4 AS tokens, round((length(text) // 4) / 1000 * 0.0001, 6) AS cost, greatest(100, length(text) // 4 // 10) AS chunk_size FROM documents")
def token_count_char4(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tk.char_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens"), tk.cost(tokens).alias("cost"), tk.optimal_chunk_size(tokens).alias("chunk_size"))


def _legal_sql() -> str:
    out = "length(text) // 4"
    for pattern, weight in tk.LEGAL_PATTERNS:
        out += f" {'+' if weight > 0 else '-'} floor(len(regexp_extract_all(text, '{pattern}')) * {abs(weight)})::BIGINT"
    return out


@query(f"SELECT doc_id, {_legal_sql()} AS tokens FROM (SELECT doc_id, text || ' 12 Fed. 34 Section 4.2 pursuant to Acme Inc. Roe v. Wade' AS text FROM documents)")
def token_legal_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" 12 Fed. 34 Section 4.2 pursuant to Acme Inc. Roe v. Wade")).alias("text"))
    return docs.select("doc_id", tk.legal_tokens(F.col("text"), tk.char_tokens(F.col("text"))).alias("tokens"))


@query("SELECT p_partkey AS id, greatest(50, least(200, floor(p_size * 40 * (CASE WHEN p_partkey % 2 = 0 THEN 0.15 ELSE 0.125 END))))::BIGINT AS overlap FROM part")
def optimal_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tk.optimal_overlap(F.col("p_size") * 40, F.col("p_partkey") % 2 == 0).alias("overlap"))


@query("SELECT doc_id, sha256(text) AS content_hash, sha256(text || ':' || doc_id || ':' || source) AS chunk_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"), tx.chunk_hash(F.col("text"), F.col("doc_id"), F.col("source")).alias("chunk_hash"))


ROMAN_SQL = "".join(
    f"{' || ' if k else ''}(['" + "','".join(digits + ("",) * (10 - len(digits))) + f"'])[n // {10 ** (3 - k)} % 10 + 1]" for k, digits in enumerate(reversed(nb.ROMAN_DIGITS))
)


@query(f"SELECT n, {ROMAN_SQL} AS roman, n::INT AS back FROM (SELECT p_partkey % 3999 + 1 AS n, p_partkey FROM part)")
def numbering_roman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 3999 + 1).alias("n"))
    return rows.withColumn("roman", nb.int_to_roman(F.col("n"))).withColumn("back", nb.roman_to_int(F.col("roman")))


@query("SELECT p_partkey AS id, chr((p_partkey % 26 + 65)::INT) AS letter, (p_partkey % 26 + 1)::INT AS back FROM part")
def numbering_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), nb.int_to_letter(F.col("p_partkey") % 26 + 1).alias("letter"))
    return rows.withColumn("back", nb.letter_to_int(F.col("letter")))


@query(
    """SELECT p_partkey AS id, p_size || '.' || p_partkey % 7 || '.' AS label, 1 AS level, p_size::INT AS primary_number, p_partkey % 7 AS second_number, '§ ' || p_size AS as_section,
    CASE WHEN p_size <= 26 THEN chr(p_size + 96) ELSE p_size::VARCHAR END AS as_letter FROM part"""
)
def numbering_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit("."))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), label.alias("label")).withColumn("parts", nb.normalise(nb.kind_of(F.col("label")), F.col("label")))
    first = F.get("parts", F.lit(0))
    return rows.select(
        "id", "label", nb.level(F.col("parts")).alias("level"), first.alias("primary_number"), F.get("parts", F.lit(1)).cast("long").alias("second_number"),
        nb.convert(first, F.lit("section_symbol")).alias("as_section"), nb.convert(first, F.lit("letter_lower")).alias("as_letter"),
    )


@query(
    """SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(o_orderdate, '%b %-d, %Y') AS shown, greatest(10, least(90, o_custkey % 100)) AS clamped, floor(log2(o_orderkey + 1))::BIGINT AS bits FROM orders"""
)
def date_math_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format("o_orderdate", "MMM d, yyyy").alias("shown"),
        F.greatest(F.lit(10), F.least(F.lit(90), F.col("o_custkey") % 100)).alias("clamped"), F.floor(F.log2(F.col("o_orderkey") + 1)).alias("bits"),
    )


@query(
    """SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'word' WHEN 2 THEN 'text' WHEN 3 THEN 'text' END AS loader,
    CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'word' WHEN 2 THEN 'text' ELSE 'unknown' END AS file_type, CASE WHEN length(url) > 30 THEN left(url, 30) || '...' ELSE url END AS preview FROM pages"""
)
def file_type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in (".PDF", ".docx", ".md", ".json", ".exe")]), (F.col("page_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("dir.a/file "), F.col("page_id").cast("string"), ext)
    return table(spark, sf_dir, "pages").select("page_id", tx.safe_name(F.col("url")).alias("base"), tx.loader(path).alias("loader"), tx.file_type(path).alias("file_type"), tx.preview(F.col("url"), 30).alias("preview"))


@query("SELECT doc_id, 1.0::DOUBLE AS score, length(text) AS n FROM documents")
def decoding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.decoding_score(F.col("text")).cast(T.DoubleType()).alias("score"), F.length("text").cast("long").alias("n"))


@query()
def markdown_html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = tx.clean_markdown_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(clean, 256).alias("clean_hash"), F.length(clean).cast("long").alias("n_chars"))
