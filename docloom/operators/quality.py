"""Checks of documents and chunks: what rejects a row and what only warns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names taken without a warning.
FILE_TYPES = ("pdf", "word", "text", "markdown", "html")
STATUSES = ("processing", "completed", "failed", "pending", "archived")


def _named(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a null condition breaks its rule."""
    flags = [F.when(F.coalesce(ok, F.lit(False)), F.lit(None).cast("string")).otherwise(name) for name, ok in rules.items()]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def check_chunks(chunks: DataFrame) -> DataFrame:
    """Adds ``violations`` (blank text, bad index, bad span) and ``warnings`` (length other than the span's)."""
    rules = {"blank_text": F.trim("content") != "", "bad_index": F.col("chunk_index") >= 0, "bad_start": F.col("start_char") >= 0, "bad_span": F.col("end_char") > F.col("start_char")}
    return chunks.withColumns({"violations": _named(rules), "warnings": _named({"span_length": F.length("content") == F.col("end_char") - F.col("start_char")})})


def check_documents(docs: DataFrame) -> DataFrame:
    """Adds ``violations`` (no name, no text, wrong length) and ``warnings`` (unknown type or status)."""
    rules = {"no_name": F.trim("filename") != "", "no_text": F.trim("text") != "", "wrong_length": F.col("n_chars") == F.length("text")}
    known = {"file_type": F.lower("file_type").isin(*FILE_TYPES), "status": F.lower("status").isin(*STATUSES)}
    return docs.withColumns({"violations": _named(rules), "warnings": _named(known)})


def report(checked: DataFrame, column: str = "violations") -> DataFrame:
    """(name, n) of what was found."""
    return checked.select(F.explode(column).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
