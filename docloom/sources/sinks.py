"""Writing document and chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions import vectors


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Append chunks with unit vectors and content hashes."""
    chunks.withColumns({"embedding": vectors.unit(F.col("embedding")), "chunk_hash": tx.chunk_hash(F.col("content"), F.col("chunk_index"), F.col("filename"))}).write.mode("append").parquet(path)


def write_metadata(docs: DataFrame, path: str) -> None:
    """One JSON line a document, without its text."""
    docs.drop("text").write.mode("overwrite").json(path)


def write_results(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)
