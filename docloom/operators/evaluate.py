"""Retrieval and answer metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(retrieved: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, n_retrieved, n_truth, n_hits, precision, recall, f1, exact_match) from (query_id, item) tables, as sets.

    Items are trimmed, blank ones left out. A quotient without a divisor is 0; exact match is 1 if there is truth and all of it is found.
    """
    def items(df: DataFrame) -> DataFrame:
        return df.select("query_id", F.trim("item").alias("item")).filter("item <> ''").distinct()

    r, t = items(retrieved).withColumn("r", F.lit(1)), items(truth).withColumn("t", F.lit(1))
    both = r.join(t, ["query_id", "item"], "full").groupBy("query_id").agg(F.count("r").alias("n_retrieved"), F.count("t").alias("n_truth"), F.count_if(F.col("r").isNotNull() & F.col("t").isNotNull()).alias("n_hits"))
    return _scored(both)


def label_metrics(retrieved: DataFrame, labels: DataFrame, asked: DataFrame) -> DataFrame:
    """:func:`retrieval_metrics` where the truth of a query (query_id, label) is every item of its label (item, label): sizes of labels are counted once and a retrieved item is right if its label is, so no list of true items is made.

    Items are trimmed, blank ones left out; an item has one label; queries that retrieved nothing have a row.
    """
    names = labels.select(F.trim("item").alias("item"), "label").filter("item <> ''").distinct()
    sizes = names.groupBy("label").agg(F.count("*").alias("n_truth"))
    found = retrieved.select("query_id", F.trim("item").alias("item")).filter("item <> ''").distinct().join(names.withColumnRenamed("label", "__own"), "item", "left")
    hits = found.join(asked.select("query_id", "label"), "query_id").groupBy("query_id").agg(F.count("*").alias("n_retrieved"), F.count_if(F.col("__own") == F.col("label")).alias("n_hits"))
    both = asked.select("query_id", "label").join(sizes, "label", "left").drop("label").join(hits, "query_id", "left").na.fill(0, ["n_truth", "n_retrieved", "n_hits"])
    return _scored(both.select("query_id", "n_retrieved", "n_truth", "n_hits"))


def _scored(both: DataFrame) -> DataFrame:
    """Precision, recall, F1 and exact match from counts."""
    p, c = share(F.col("n_hits"), F.col("n_retrieved")), share(F.col("n_hits"), F.col("n_truth"))
    scored = both.withColumns({"precision": p, "recall": c})
    f1 = share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    exact = F.when((F.col("n_truth") > 0) & (F.col("n_hits") == F.col("n_truth")), 1.0).otherwise(0.0)
    rounded = {c: F.round(c, 6) for c in ("precision", "recall")}
    return scored.withColumns({"f1": F.round(f1, 6), "exact_match": exact}).withColumns(rounded)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def benchmark_report(metrics: DataFrame, *groups: str) -> DataFrame:
    names = ("precision", "recall", "f1", "exact_match")
    return metrics.groupBy(*groups).agg(F.count("*").alias("n_cases"), *[F.round(F.avg(n), 6).alias(f"avg_{n}") for n in names], F.round(F.avg((F.col("n_hits") > 0).cast("double")), 6).alias("success_rate"))


def words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), r"\s+")), lambda w: w != "")


def word_overlap(expected: Column, answer: Column) -> Column:
    """Share of the expected answer's distinct words that the answer has."""
    return F.round(share(F.size(F.array_intersect(words(expected), words(answer))).cast("double"), F.size(words(expected))), 6)


def keyword_coverage(cases: DataFrame, texts: DataFrame) -> DataFrame:
    """(case_id, n_keywords, n_found, coverage): how many of a case's keywords its own text contains, case ignored. Cases and texts meet on case_id."""
    rows = cases.select("case_id", F.explode("keywords").alias("keyword")).join(texts, "case_id")
    found = F.lower("text").contains(F.lower("keyword"))
    return rows.groupBy("case_id").agg(F.count("*").alias("n_keywords"), F.count_if(found).alias("n_found")).withColumn("coverage", F.round(F.col("n_found") / F.col("n_keywords"), 6))


def span_text(cases: DataFrame, corpus: DataFrame) -> DataFrame:
    """Ground-truth text cut from the corpus by span (code points), the expected text where the document is missing."""
    joined = cases.join(corpus.select("doc_id", "text"), "doc_id", "left")
    cut = F.substring("text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    return joined.select("case_id", "doc_id", F.coalesce(cut, F.col("expected")).alias("truth"), (cut == F.col("expected")).alias("agrees"))


def first_cases(cases: DataFrame, corpus: DataFrame, each: int = 10, most: int = 20) -> DataFrame:
    """Of (suite, case_id, doc_id), the first ``each`` of a suite whose document exists, ``most`` in all, in the order of suite and case."""
    from pyspark.sql import Window

    there = cases.join(corpus.select("doc_id"), "doc_id", "left_semi")
    ranked = there.withColumn("__n", F.row_number().over(Window.partitionBy("suite").orderBy("case_id")))
    return ranked.filter(F.col("__n") <= each).drop("__n").orderBy("suite", "case_id").limit(most)


def quick_scores(cases: DataFrame) -> DataFrame:
    """(case_id, relevance): the share of the truth's words in the retrieved text where there is a truth, else the mean similarity, at most 1."""
    return cases.select("case_id", F.when(F.col("truth").isNotNull(), F.least(F.lit(1.0), word_overlap(F.col("truth"), F.col("retrieved")))).otherwise(F.round("similarity", 6)).alias("relevance"))
