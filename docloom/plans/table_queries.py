"""Document tables, sessions, duplicates and relational plumbing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import corpus, evaluate, quality, search, spans
from docloom.plans.base import registry, table
from docloom.sources import files
from docloom.streaming import ingest

QUERIES, SQL, query = registry()


@query("SELECT d.doc_id, d.source AS tenant, count(c.conv_id) AS n_chunks FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id WHERE d.source = 'src1' GROUP BY d.doc_id, d.source")
def list_documents_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("tenant"))
    return corpus.with_counts(docs, table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")), "src1")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE lang END AS lang FROM documents UNION ALL SELECT item_id + 1000000000, 'new' FROM benchmark")
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    changed = docs.filter("doc_id % 4 = 0").select("doc_id", F.lit("new").alias("lang"))
    added = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("doc_id"), F.lit("new").alias("lang"))
    return corpus.upsert(docs, changed.unionByName(added), ["doc_id"])


@query("SELECT 'documents' AS name, count(*) AS n FROM documents WHERE source <> 'src2' UNION ALL SELECT 'chunks', count(*) FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src2')")
def delete_cascade_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    left, chunks = corpus.delete_cascade(docs, table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")), docs.filter("source = 'src2'"))
    return left.agg(F.count("*").alias("n")).select(F.lit("documents").alias("name"), "n").unionByName(chunks.agg(F.count("*").alias("n")).select(F.lit("chunks").alias("name"), "n"))


@query(
    "SELECT lang, source, count(*) AS n_docs, sum(length(text))::BIGINT AS total_chars, sum(length(text) // 4)::BIGINT AS total_tokens, round(avg(length(text)), 4) AS avg_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars FROM documents GROUP BY lang, source"
)
def doc_stats_by_lang_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.statistics(table(spark, sf_dir, "documents"), "lang", "source")


@query("SELECT lang, source, sum(length(text) // 4)::BIGINT AS total_tokens, count(*) AS n_docs, grouping_id(lang, source)::BIGINT AS level FROM documents GROUP BY ROLLUP (lang, source)")
def doc_detail_and_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.detail_and_total(table(spark, sf_dir, "documents"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.exact_duplicates(table(spark, sf_dir, "documents"))


@query(
    """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
    WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.3"""
)
def near_dup_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every vector to every other, whatever the labels."""
    return search.links(table(spark, sf_dir, "embeddings"), 0.3)


@query(
    """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
    WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.3"""
)
def near_dup_cosine_all_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of the same query set to the whole table, whatever the labels."""
    rows = table(spark, sf_dir, "embeddings")
    return search.within_each(rows.filter("vec_id % 50 = 0"), rows, 0.3).select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"), "similarity")


@query(
    """WITH near AS (SELECT a.vec_id, b.vec_id AS other FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
    WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.95)
    SELECT e.vec_id, count(near.other) AS n_links, coalesce(min(near.other) < e.vec_id, false) AS redundant FROM embeddings e LEFT JOIN near ON near.vec_id = e.vec_id WHERE e.vec_id % 50 = 0 GROUP BY e.vec_id"""
)
def redundancy_filter_095(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector of the query set its links to the whole table, and whether an earlier vector makes it redundant."""
    rows = table(spark, sf_dir, "embeddings")
    return search.redundancy(rows.filter("vec_id % 50 = 0"), rows, 0.95)


@query(
    """SELECT conv_id, count(*) AS n_messages, arg_min(left(trim(text), 50), turn) FILTER (role = 'user') AS title FROM conversations GROUP BY conv_id ORDER BY conv_id DESC LIMIT 20"""
)
def sessions_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.recent_sessions(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS message_index, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_role FROM conversations")
def append_message_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.numbered_messages(table(spark, sf_dir, "conversations"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS since, count(*) AS n_events FROM events GROUP BY user_id")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.latest_status(table(spark, sf_dir, "events"))


@query(
    """WITH RECURSIVE o AS (SELECT source, doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
    walk AS (SELECT source, i, 1::BIGINT AS g, CASE WHEN n >= 400 THEN 0 ELSE n END AS total, n < 400 AS open FROM o WHERE i = 1
    UNION ALL SELECT o.source, o.i, CASE WHEN open AND o.n < 400 THEN g ELSE g + 1 END, CASE WHEN o.n >= 400 THEN 0 WHEN open THEN total + o.n ELSE o.n END, o.n < 400 AND CASE WHEN open THEN total + o.n ELSE o.n END < 400 FROM walk JOIN o ON o.source = walk.source AND o.i = walk.i + 1)
    SELECT o.source AS "group", min(o.doc_id) AS first_doc, count(*) AS n_docs, string_agg(o.text, chr(10) || chr(10) ORDER BY o.doc_id) AS text FROM o JOIN walk USING (source, i) GROUP BY o.source, g"""
)
def merge_short_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.merge_short(table(spark, sf_dir, "documents"), 400)


@query("SELECT 'wrong_length' AS name, count(*) AS n FROM documents WHERE n_chars <> length(text) HAVING count(*) > 0 UNION ALL SELECT 'no_text', count(*) FROM documents WHERE trim(text) = '' HAVING count(*) > 0")
def validate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumns({"filename": F.concat(F.lit("doc"), "doc_id"), "file_type": F.lit("text"), "status": F.lit("completed")})
    return quality.report(quality.check_documents(docs))


@query("SELECT a.event_id, a.user_id, (SELECT max(b.event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.event_id <= a.event_id) AS last_mark FROM events a")
def page_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    marks = events.filter("event_type = 'purchase'").select("user_id", "event_id", F.col("event_id").alias("last_mark"))
    return spans.last_before(events.select("event_id", "user_id"), marks, "user_id", "event_id", "last_mark")


@query("SELECT CASE WHEN page_id % 4 = 3 THEN 'unsupported' WHEN page_id % 7 = 0 THEN 'empty' ELSE 'valid' END AS class, count(*) AS n, sum(CASE WHEN page_id % 7 = 0 THEN 0 ELSE length(html) END)::BIGINT AS bytes FROM pages GROUP BY 1")
def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".docx", ".txt", ".exe")]), (F.col("page_id") % 4 + 1).cast("int"))
    listed = table(spark, sf_dir, "pages").select(F.concat(F.lit("f"), F.col("page_id").cast("string"), ext).alias("path"), F.when(F.col("page_id") % 7 == 0, 0).otherwise(F.length("html")).cast("long").alias("length"))
    return files.classify_files(listed)


@query("SELECT count(*) AS n_files, sum(length(html))::BIGINT AS bytes, round(sum(length(html)) / 1048576 * 2 * 1.5, 6) AS seconds FROM pages")
def estimate_processing_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "pages").select(F.concat(F.lit("f"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("path"), F.length("html").cast("long").alias("length"))
    return files.estimate_seconds(listed)


@query(
    "SELECT n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_items FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
)
def join_agg_nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("nation")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n_items"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_join_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("id"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def semi_join_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "lineitem").filter("l_quantity > 49")
    return table(spark, sf_dir, "orders").join(large, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.col("o_orderkey").alias("id"))


@query("SELECT id, nation, rank FROM (SELECT c_custkey AS id, c_nationkey AS nation, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey))::INT AS rank FROM customer) WHERE rank <= 3")
def window_rank_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("rank", F.row_number().over(order)).filter("rank <= 3").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), "rank")


@query(
    "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS histogram FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id"
)
def histogram_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    return maps.select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("histogram"))


@query("SELECT event_id, event_type, value, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "event_type", "value", "props")).alias("j"))
    back = packed.select(F.from_json("j", "event_id long, event_type string, value double, props string").alias("r")).select("r.*")
    return back.select("event_id", "event_type", "value", F.from_json("props", "k long")["k"].alias("k"))


@query(
    """SELECT suite, case_id FROM (SELECT item_id % 4 AS suite, item_id AS case_id, row_number() OVER (PARTITION BY item_id % 4 ORDER BY item_id) AS n FROM benchmark WHERE item_id IN (SELECT doc_id FROM documents)) WHERE n <= 10 ORDER BY suite, case_id LIMIT 20"""
)
def benchmark_first_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 4).alias("suite"), F.col("item_id").alias("case_id"), F.col("item_id").alias("doc_id"))
    return evaluate.first_cases(cases, table(spark, sf_dir, "documents")).select("suite", "case_id")


@query("SELECT p_partkey AS id, (row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size > 25 THEN 1 ELSE 0 END, p_size, p_partkey))::INT AS place FROM part")
def numbering_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in order of level, then of their parts compared in turn."""
    parts = F.when(F.col("p_size") > 25, F.array("p_size", F.col("p_partkey").cast("int"))).otherwise(F.array("p_size"))
    rows = table(spark, sf_dir, "part").withColumn("parts", parts)
    order = Window.partitionBy("p_brand").orderBy(F.size("parts"), "parts", "p_partkey")
    return rows.select(F.col("p_partkey").alias("id"), F.row_number().over(order).alias("place"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def status_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming counts, run over the whole table as a batch."""
    counts = ingest.status_counts(table(spark, sf_dir, "events"))
    return counts.select(F.col("window.start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT page_id AS doc_id, 'stored' AS status FROM pages WHERE length(html) > 0")
def ingest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stripped, cleaned and hashed as an ingest step would store them."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), tx.clean_text(tx.strip_tags(F.col("html"))).alias("text"))
    return pages.withColumn("content_hash", tx.content_hash(F.col("text"))).filter("content_hash IS NOT NULL").select("doc_id", F.lit("stored").alias("status"))
