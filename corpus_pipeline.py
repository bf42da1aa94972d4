"""A training-data pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontamination, line_dedup, near_dedup, packing, toxicity
from docloom.llm.common import materialise
from docloom.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject. It learns from the labelled rows of this stage's input."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.train(docs, labels)
    return toxicity.score(docs.select(*COLUMNS), machine).filter("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that at least three documents hold; n_chars follows the text."""
    ship(spark)
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    ship(spark)
    return near_dedup.keep_one(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.find_contaminated(docs, benchmark).select(F.col("doc_id").alias("__found")).distinct()
    return docs.select(*COLUMNS).join(found, F.col("doc_id").eqNullSafe(F.col("__found")), "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces in sequences of at most 2048 ids."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
