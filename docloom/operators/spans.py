"""Joins on places in a text: overlaps, boundaries inside chunks, last page before a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Characters of a stretch of text; spans meet only within one.
STRETCH = 2000


def _stretches(start: Column, end: Column) -> Column:
    """Numbers of the stretches that a span has characters in."""
    return F.sequence(F.floor(start / STRETCH), F.floor((end - 1) / STRETCH))


def best_overlap(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, element, overlap): the element that shares most characters with a chunk, the earlier of equals; touching spans share none.

    Both sides are dealt to stretches of the text and meet there only, so a document of many chunks and elements costs their number and not its square. A pair that meets in several stretches counts once.
    """
    e = elements.select("doc_id", "element", F.col("start_char").alias("es"), F.col("end_char").alias("ee")).filter("ee > es").withColumn("stretch", F.explode(_stretches(F.col("es"), F.col("ee"))))
    c = chunks.filter(F.col("end_char") > F.col("start_char")).withColumn("stretch", F.explode(_stretches(F.col("start_char"), F.col("end_char"))))
    pairs = c.join(e, ["doc_id", "stretch"]).filter((F.col("es") < F.col("end_char")) & (F.col("ee") > F.col("start_char")))
    shared = F.least("ee", "end_char") - F.greatest("es", "start_char")
    return pairs.groupBy("doc_id", "chunk_index").agg(F.max_by("element", F.struct(shared, -F.col("es"))).alias("element"), F.max(shared).alias("overlap"))


def inside(chunks: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, pos): places (doc_id, pos) strictly inside a chunk (doc_id, chunk_index, start_char, end_char).

    A place lies in one stretch of the text, and a chunk meets those of its own stretches.
    """
    b = marks.select("doc_id", "pos", F.floor(F.col("pos") / STRETCH).alias("stretch"))
    c = chunks.filter(F.col("end_char") > F.col("start_char")).select("doc_id", "chunk_index", "start_char", "end_char", F.explode(_stretches(F.col("start_char"), F.col("end_char"))).alias("stretch"))
    return c.join(b, ["doc_id", "stretch"]).filter((F.col("pos") > F.col("start_char")) & (F.col("pos") < F.col("end_char"))).select("doc_id", "chunk_index", "pos")


def boundary_violations(chunks: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, n_violations): boundaries strictly inside a chunk; those of subsections only down to level 2."""
    found = inside(chunks, boundaries.filter(F.col("is_section") | (F.col("level") <= 2)))
    return found.groupBy("doc_id", "chunk_index").agg(F.count("*").alias("n_violations"))


def last_before(rows: DataFrame, marks: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """As-of join: for each row the value of the last mark of its key at or before its place.

    Rows and marks are sorted once by key and place and the last mark is carried forward; no row meets more than its own key's order.
    """
    kept = [c for c in rows.columns]
    both = rows.select(*kept, F.lit(1).alias("__row"), F.lit(None).cast(marks.schema[value].dataType).alias("__value")).unionByName(
        marks.select(key, at, F.lit(0).alias("__row"), F.col(value).alias("__value")), allowMissingColumns=True
    )
    order = Window.partitionBy(key).orderBy(at, "__row").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__value", ignorenulls=True).over(order)).filter("__row = 1").select(*kept, value)


def estimated_page(start, length, per: int = 2500, least: int = 3000):
    """Page by characters: none for short texts, else one a ``per`` characters up to the text's number of pages."""
    pages = F.greatest(F.lit(1), F.floor(length / per) + 1)
    return F.when(length > least, F.least(F.floor(start / per) + 1, pages)).cast("long")
