"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import centroids, conversation_repair, decontamination, fingerprints, hmm, license_scan, line_dedup, materialisation, near_dedup, packing, sharding, toxicity, url_filter
from docloom.llm.common import doc_number
from docloom.llm.turn_and_centroid_sql import CENTROIDS_SQL, REPAIR_SQL

#: The rules of the URL contract: verdict, host, start of the path.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir).select("doc_id", "text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contaminated(table(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, URL_RULES, url_filter.content_labels(pages))


def op5_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir).select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    out = sharding.shard_rows(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialisation.materialised_order(table(spark, sf_dir))


def op7_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir)).select("doc_id", "class_id", "n_docs", "is_first")


def op8_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(table(spark, sf_dir), F.pmod(doc_number(), F.lit(7)) == 2)


def op9_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir).select("doc_id", "text")
    held_out = F.pmod(doc_number(), F.lit(4)) == 2
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_documents(table(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_all(conversations, conversation_repair.damage(conversations))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_order_minhash": op1_order_minhash,
        "op2_line_dedup": op2_line_dedup,
        "op3_template_decontamination": op3_template_decontamination,
        "op4_url_rules": op4_url_rules,
        "op5_histogram_shards": op5_histogram_shards,
        "op6_training_order": op6_training_order,
        "op7_bag_minhash": op7_bag_minhash,
        "op8_hidden_markov": op8_hidden_markov,
        "op9_packed_sequences": op9_packed_sequences,
        "op10_toxicity": op10_toxicity,
        "op11_license_scan": op11_license_scan,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_centroid_clusters": op13_centroid_clusters,
    }


LINES_SQL = """WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM split),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS newest FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (newest IS NOT NULL AND doc_id <> newest) AS n_dropped,
sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (newest IS NULL OR doc_id = newest), '')) AS kept_sha256 FROM k LEFT JOIN g USING (key) GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    """Line dedup, conversation repair and centroid clustering: the other methods (hash order, models, packing, a tokenizer, rarities) have no SQL form."""
    return {"op2_line_dedup": LINES_SQL, "op12_conversation_repair": REPAIR_SQL, "op13_centroid_clusters": CENTROIDS_SQL}
