"""Checks of an evaluation data set: a corpus of text files and benchmark files of test cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

FOUND = "severity string, file string, case_id long, finding string"
#: What makes a data set unusable, and what a case lacks.
MISSING, NOT_JSON, NO_CASES = "dataset_missing", "not_json", "no_test_cases"
CASE_FIELDS = ("query", "ground_truth")


def _has_files(spark: SparkSession, path: str, pattern: str) -> bool:
    """Whether a folder holds a file of that name, in whatever store it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return False
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return not files.select("path").limit(1).isEmpty()


def dataset_status(spark: SparkSession, corpus: str, benchmarks: str) -> dict[str, bool]:
    """Whether the corpus holds text files and the benchmarks JSON files, and so whether an evaluation can run."""
    out = {"corpus_ready": _has_files(spark, corpus, "*.txt"), "benchmarks_ready": _has_files(spark, benchmarks, "*.json")}
    return out | {"ready": all(out.values())}


def check_benchmarks(spark: SparkSession, benchmarks: str) -> tuple[DataFrame, Observation]:
    """(severity, file, case_id, finding) of what is wrong with benchmark files, one scan; the observation has n_files and n_cases once the rows have been read.

    Errors: a file that is no JSON object (``not_json``) or has no list of test cases (``no_test_cases``). Warnings: a case without its query or ground truth (``missing_query``, ``missing_ground_truth``), cases counted from 0; a null counts as there.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(benchmarks)
    parsed = files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), F.expr("try_parse_json(decode(content, 'UTF-8'))").alias("v"))
    kind = F.expr("schema_of_variant(v)")
    cases = F.expr("try_cast(try_variant_get(v, '$.test_cases', 'variant') AS array<variant>)")
    rows = parsed.select("file", (F.col("v").isNotNull() & kind.startswith("OBJECT")).alias("is_object"), F.when(kind.startswith("OBJECT"), cases).alias("cases"))
    seen = Observation()
    rows = rows.observe(seen, F.count("*").alias("n_files"), F.coalesce(F.sum(F.when(F.col("cases").isNotNull(), F.size("cases")).otherwise(0)), F.lit(0)).alias("n_cases"))
    problem = F.when(~F.col("is_object"), NOT_JSON).when(F.col("cases").isNull(), NO_CASES)
    per_file = F.when(problem.isNotNull(), F.array(F.struct(F.lit("error").alias("severity"), F.lit(None).cast("long").alias("case_id"), problem.alias("finding")))).otherwise(F.array().cast("array<struct<severity:string,case_id:long,finding:string>>"))
    lacks = F.expr(
        "flatten(transform(coalesce(cases, cast(array() AS array<variant>)), (c, i) -> filter(array("
        + ", ".join(f"IF(coalesce(schema_of_variant(c), '') LIKE 'OBJECT%' AND variant_get(c, '$.{name}', 'variant') IS NOT NULL, NULL, named_struct('severity', 'warning', 'case_id', cast(i AS long), 'finding', 'missing_{name}'))" for name in CASE_FIELDS)
        + "), x -> x IS NOT NULL)))"
    )
    found = rows.select("file", F.explode(F.concat(per_file, lacks)).alias("x")).select("x.severity", "file", "x.case_id", "x.finding")
    return found, seen


def validate_dataset(spark: SparkSession, corpus: str, benchmarks: str) -> tuple[DataFrame, dict[str, int | bool]]:
    """What is wrong with a data set, as rows, and its statistics: valid (no error), corpus_files, benchmark_files, total_test_cases; empty files, which a scan passes over, count nowhere. One that is not there has a single error and zeros."""
    status = dataset_status(spark, corpus, benchmarks)
    if not status["ready"]:
        return spark.createDataFrame([("error", None, None, MISSING)], FOUND), {"valid": False, "corpus_files": 0, "benchmark_files": 0, "total_test_cases": 0}
    found, seen = check_benchmarks(spark, benchmarks)
    errors = found.groupBy("severity").count().collect()
    n = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(corpus).select("path").count()
    figures = {"valid": not any(r["severity"] == "error" for r in errors), "corpus_files": n, "benchmark_files": seen.get["n_files"], "total_test_cases": seen.get["n_cases"]}
    return found, figures


Rules = dict[str, tuple[str, Column]]


def rule_report(rows: DataFrame, rules: Rules) -> DataFrame:
    """(severity, rule, n_rows, n_broken) of rules {name: (severity, condition)} over a table: one scan, one row a rule. A row whose condition is false or null breaks the rule."""
    counts = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, (_, ok) in rules.items()]
    one = rows.agg(F.count("*").alias("__n"), *counts)
    entries = [F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("rule"), F.col("__n").alias("n_rows"), F.col(name).alias("n_broken")) for name, (severity, _) in rules.items()]
    return one.select(F.explode(F.array(*entries)).alias("x")).select("x.*")
