"""Search: nearest neighbours, confidence, snippets, contexts, retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import evaluate, search
from docloom.plans.base import registry, table

QUERIES, SQL, query = registry()

COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the document of the same number as chunk; its source is the tenant."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.col("source").alias("tenant"))
    return table(spark, sf_dir, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id"))


@query(f"SELECT e.vec_id, round({COS}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY round({COS}, 9) DESC, vec_id LIMIT 10")
def knn_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = search.nearest(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10)
    return top.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(
    f"SELECT e.vec_id, d.source AS tenant, round({COS}, 6) AS similarity, length(d.text) AS n_chars FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id, "
    f"(SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE d.source = 'src1' ORDER BY round({COS}, 9) DESC, vec_id LIMIT 10"
)
def knn_tenant_join_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k by vector first, with the tenant's name alone; then the texts of those few."""
    docs = table(spark, sf_dir, "documents")
    owners = docs.select(F.col("doc_id").alias("vec_id"), F.col("source").alias("tenant"))
    top = search.nearest(table(spark, sf_dir, "embeddings").join(owners, "vec_id"), first_vector(spark, sf_dir), 10, tenant="src1")
    few = top.select("vec_id", "tenant", F.round("similarity", 6).alias("similarity"))
    texts = docs.select(F.col("doc_id").alias("vec_id"), F.length("text").cast("long").alias("n_chars"))
    return texts.join(F.broadcast(few), "vec_id").select("vec_id", "tenant", "similarity", "n_chars")


@query(
    f"SELECT vec_id, similarity FROM (SELECT e.vec_id, round({COS}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY round({COS}, 9) DESC, vec_id LIMIT 20) WHERE similarity >= 0.2"
)
def knn_threshold_after_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = search.nearest(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 20, threshold=0.2)
    return top.select("vec_id", F.round("similarity", 6).alias("similarity"))


BATCH = f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round({COS}, 9) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)"""


@query(f"{BATCH} SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 5")
def knn_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search.nearest_each(rows.filter("vec_id % 50 = 0"), rows, 5).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    "SELECT doc_id, round(least(1.0, 0.8 * (CASE doc_id % 3 WHEN 0 THEN 1.1 WHEN 1 THEN 0.9 ELSE 1.0 END) * (CASE WHEN length(text) < 50 THEN 0.8 WHEN length(text) > 500 THEN 1.05 ELSE 1.0 END)), 6)::DOUBLE AS confidence FROM documents"
)
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("doc_id") % 3 == 0, "completed").when(F.col("doc_id") % 3 == 1, "processing").otherwise("failed")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(search.confidence(F.lit(0.8), status, F.col("text")), 6).alias("confidence"))


@query(
    """SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN instr(left(text, 200), ' ') > 0 AND 200 - instr(reverse(left(text, 200)), ' ') > 160
    THEN left(text, 200 - instr(reverse(left(text, 200)), ' ')::INT) || '...' ELSE left(text, 200) || '...' END AS snippet FROM documents"""
)
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


RANKED = f"""{BATCH}, h AS (SELECT r.query_id, r.rank, r.similarity, 'doc' || d.doc_id AS filename, d.doc_id % 9 + 1 AS page, left(d.text, 300) AS content FROM r JOIN documents d ON d.doc_id = r.vec_id WHERE rank <= 5)"""


@query(
    f"""{RANKED} SELECT query_id, string_agg(CASE WHEN rank <= 3 THEN '[Source ' || rank || ': ' || filename || ', Page ' || page || ']' || chr(10) || content END, chr(10) || chr(10) ORDER BY rank) AS context,
    count(*) AS n_hits, least(round(avg(similarity) * 1.2, 6), 0.95)::DOUBLE AS confidence FROM h GROUP BY query_id"""
)
def rag_context_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    hits = search.nearest_each(rows.filter("vec_id % 50 = 0"), rows, 5)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("filename"), (F.col("doc_id") % 9 + 1).alias("page"), F.left("text", F.lit(300)).alias("content"))
    return search.answer_context(hits.join(docs, hits["vec_id"] == docs["doc_id"]), ["query_id"])


METRICS = f"""{BATCH}, t AS (SELECT q.vec_id AS query_id, e.vec_id FROM embeddings e JOIN embeddings q ON e.label = q.label WHERE q.vec_id % 50 = 0),
m AS (SELECT q.query_id, (SELECT count(*) FROM r WHERE r.query_id = q.query_id AND rank <= 10) AS n_retrieved, (SELECT count(*) FROM t WHERE t.query_id = q.query_id) AS n_truth,
(SELECT count(*) FROM r JOIN t USING (query_id, vec_id) WHERE r.query_id = q.query_id AND rank <= 10) AS n_hits FROM (SELECT DISTINCT query_id FROM r) q)
"""


@query(
    METRICS
    + """SELECT query_id, n_retrieved, n_truth, n_hits, round(n_hits / n_retrieved, 6) AS precision, round(n_hits / n_truth, 6) AS recall, round(CASE WHEN n_hits > 0 THEN 2.0 * n_hits / (n_retrieved + n_truth) ELSE 0 END, 6)::DOUBLE AS f1,
    CASE WHEN n_hits = n_truth THEN 1.0 ELSE 0.0 END::DOUBLE AS exact_match FROM m"""
)
def eval_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 50 = 0")
    found = search.nearest_each(asked, rows, 10).select("query_id", F.col("vec_id").cast("string").alias("item"))
    labels = rows.select(F.col("vec_id").cast("string").alias("item"), "label")
    return evaluate.label_metrics(found, labels, asked.select(F.col("vec_id").alias("query_id"), "label"))


@query(
    METRICS
    + """SELECT count(*) AS n_cases, round(avg(n_hits / n_retrieved), 6) AS avg_precision, round(avg(n_hits / n_truth), 6) AS avg_recall, round(avg(CASE WHEN n_hits > 0 THEN 2.0 * n_hits / (n_retrieved + n_truth) ELSE 0 END), 6) AS avg_f1,
    round(avg(CASE WHEN n_hits = n_truth THEN 1.0 ELSE 0.0 END), 6) AS avg_exact_match, round(avg((n_hits > 0)::INT), 6) AS success_rate FROM m"""
)
def eval_benchmark_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.benchmark_report(eval_retrieval_metrics(spark, sf_dir))


WORDS = r"list_filter(list_distinct(string_split_regex(lower({}), '[ \t\n\r\f\v]+')), lambda w: w <> '')"


@query(f"SELECT b.item_id, round(len(list_intersect({WORDS.format('b.text')}, {WORDS.format('d.text')})) / len({WORDS.format('b.text')}), 6) AS overlap FROM benchmark b JOIN documents d ON b.item_id = d.doc_id")
def eval_word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("expected")).join(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("item_id") == F.col("doc_id"))
    return pairs.select("item_id", evaluate.word_overlap(F.col("expected"), F.col("text")).alias("overlap"))


@query(
    """WITH k AS (SELECT item_id AS case_id, unnest(list_distinct(list_filter(string_split(text, ' '), lambda w: length(w) > 4))) AS keyword FROM (SELECT item_id, replace(text, chr(10), ' ') AS text FROM benchmark))
    SELECT case_id, count(*) AS n_keywords, count(*) FILTER (contains(lower(text), lower(keyword))) AS n_found, round(count(*) FILTER (contains(lower(text), lower(keyword))) / count(*), 6) AS coverage FROM k JOIN documents ON doc_id = case_id GROUP BY case_id"""
)
def eval_keyword_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.filter(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), lambda w: F.length(w) > 4))
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.expr("1").alias("one"), words.alias("keywords")).drop("one")
    return evaluate.keyword_coverage(cases.withColumn("keywords", F.col("keywords")), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), "text"))


@query(
    """SELECT b.item_id AS case_id, b.item_id % 50 AS doc_id, coalesce(substring(d.text, (b.item_id % 7 + 1)::INT, 40), b.text) AS truth, substring(d.text, (b.item_id % 7 + 1)::INT, 40) = b.text AS agrees
    FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id % 50"""
)
def gt_span_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("item_id") % 7).cast("int")
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), (F.col("item_id") % 50).alias("doc_id"), start.alias("start_char"), (start + 40).alias("end_char"), F.col("text").alias("expected"))
    return evaluate.span_text(cases, table(spark, sf_dir, "documents"))
