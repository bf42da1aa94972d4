"""Files as document tables: text in many encodings, Word files, pages of markup, JSON test cases."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx

#: Encodings in the order in which they are tried, byte order marks, and the name space of Word files.
ENCODINGS = ("utf-8", "utf-16", "latin-1", "cp1252")
MARKS = ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MOST_BYTES = 50 << 20

LOADED = "path string, loader string, text string, encoding string, error string"


def decode(data: bytes, encoding: str | None = None) -> tuple[str, str]:
    """Text and the encoding that read it: the one given, that of a byte order mark, else the first of the list that fits."""
    if encoding:
        return data.decode(encoding), encoding
    for mark, name in MARKS:
        if data.startswith(mark):
            return data.decode(name), name
    for name in ENCODINGS:
        if name == "utf-16" and (len(data) % 2 or data[1::2].count(0) * 4 < len(data)):
            continue  # without a mark, only text with zeros in every second byte
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace"), "utf-8"


def word_paragraphs(data: bytes) -> list[str]:
    """Non-blank paragraphs of a Word file."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    found = ("".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in root.iter(f"{WORD}p"))
    return [p for p in found if p.strip()]


def load_one(path: str, loader: str | None, data: bytes, encoding: str | None) -> tuple:
    try:
        if loader is None:
            raise ValueError("unsupported_format")
        if len(data) > MOST_BYTES:
            raise ValueError("file_too_large")
        if loader == "word":
            return path, loader, "\n\n".join(word_paragraphs(data)), "xml", None
        if loader == "pdf":
            import pypdf

            pages = [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages]
            return path, loader, "\n\n".join(f"--- Page {n} ---\n{t}" for n, t in enumerate(pages, 1) if t.strip()), "pdf", None
        return (path, loader, *decode(data, encoding), None)
    except Exception as x:
        return path, loader, None, None, f"{type(x).__name__}: {x}"[:200]


def load_files(spark: SparkSession, path: str, encoding: str | None = None, pattern: str = "*") -> DataFrame:
    """A folder's files as (path, loader, text, encoding, error); a file that can't be read gives its error and no text.

    PDF files need the optional pypdf package.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [load_one(*x, encoding) for x in zip(frame["path"], frame["loader"], frame["content"], strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LOADED.split(", ")])

    return files.select("path", tx.loader(F.col("path")).alias("loader"), "content").mapInPandas(load, LOADED)


def classify_files(files: DataFrame) -> DataFrame:
    """(class, n, bytes) of (path, length): valid, empty, too_large or unsupported."""
    kind = F.when(tx.loader(F.col("path")).isNull(), "unsupported").when(F.col("length") == 0, "empty").when(F.col("length") > MOST_BYTES, "too_large").otherwise("valid")
    return files.groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def estimate_seconds(files: DataFrame) -> DataFrame:
    """Two seconds a megabyte, half as much again with a PDF among the files."""
    mb = F.sum("length") / 1048576
    pdf = F.bool_or(tx.extension(F.col("path")) == ".pdf")
    return files.agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"), F.round(mb * 2 * F.when(pdf, 1.5).otherwise(1.0), 6).alias("seconds"))


def parsed_pages(loaded: DataFrame) -> DataFrame:
    """(path, page, text) of files with page marks; files without have page 1."""
    marked = F.split("text", r"(?m)^--- Page (?=\d+ ---$)")
    rows = loaded.select("path", F.explode(marked).alias("part")).filter(F.trim("part") != "")
    number = F.regexp_extract("part", r"^(\d+) ---", 1)
    return rows.select("path", F.when(number == "", 1).otherwise(number.cast("int")).alias("page"), F.trim(F.regexp_replace("part", r"^\d+ ---\n?", "")).alias("text"))


def test_cases(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark files {"test_cases": [...]} or {"tests": [...]} as (suite, case_id, query, file_path, start_char, end_char, expected)."""
    truth = "array<struct<file_path: string, start_char: int, end_char: int, text: string>>"
    snippets = "array<struct<file_path: string, answer: string>>"
    schema = f"test_cases array<struct<query: string, ground_truth: {truth}, expected_answer: string>>, tests array<struct<query: string, snippets: {snippets}>>"
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1).alias("suite"), F.from_json("value", schema).alias("j"))
    one = files.select("suite", F.posexplode("j.test_cases").alias("case_id", "c")).select("suite", "case_id", "c.query", F.explode_outer("c.ground_truth").alias("g"))
    one = one.select("suite", "case_id", "query", "g.file_path", "g.start_char", "g.end_char", F.col("g.text").alias("expected"))
    two = files.select("suite", F.posexplode("j.tests").alias("case_id", "c")).select("suite", "case_id", "c.query", F.explode_outer("c.snippets").alias("g"))
    two = two.select("suite", "case_id", "query", "g.file_path", F.lit(None).cast("int").alias("start_char"), F.lit(None).cast("int").alias("end_char"), F.col("g.answer").alias("expected"))
    return one.unionByName(two)
