"""Splitting documents into chunks: fixed windows, packed sentences and paragraphs, headings, recursive separators."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions import tokens as tk

#: Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def fixed_windows(docs: DataFrame, size: int, overlap: int, per: int = 4) -> DataFrame:
    """Windows of ``size`` tokens (of ``per`` characters) every ``size - overlap``; the last ends with the text. No rows for an empty text."""
    step, length = (size - overlap) * per, F.length("text")
    last = F.greatest(F.lit(0), F.ceil((length - size * per) / step)).cast("int")
    starts = F.when(length > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step))
    rows = docs.withColumn("__starts", starts).select("*", F.posexplode("__starts").alias("chunk_index", "start_char"))
    content = F.substring("text", F.col("start_char") + 1, F.lit(size * per))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("start_char").cast("long").alias("start_char"), content.alias("content")).withColumn(
        "end_char", F.col("start_char") + F.length("content")
    )


def _places(size: int, carry: int):
    """An Arrow function: first piece, number of pieces and measure of every pack of a list of measures."""

    def places(measures: pd.Series) -> pd.Series:
        def one(own) -> list[tuple[int, int, int]]:
            out, start, total = [], 0, 0
            own = [] if own is None else [int(m) for m in own]
            for i, m in enumerate(own):
                if i > start and total + m > size:
                    out.append((start, i - start, total))
                    start = max(start, i - carry)
                    total = sum(own[start:i])
                total += m
            return out + [(start, len(own) - start, total)] if own else out

        return pd.Series([one(own) for own in measures])

    return F.pandas_udf(places, "array<struct<start:int,n:int,size:long>>")


def _packed(rows: DataFrame, measure, size: int, carry: int, glue: str) -> DataFrame:
    """(doc_id, chunk_index, content, n_pieces, size) of (doc_id, pieces): pieces packed in order while their measures add up to at most ``size``; a new pack starts with the last ``carry`` pieces of the one before.

    Where packs begin goes through an Arrow batch of measures alone; each pack is then one slice of the pieces.
    """
    measured = rows.select("doc_id", "pieces", F.transform("pieces", lambda p: measure(p)).alias("measures")).filter(F.size("pieces") > 0)
    placed = measured.withColumn("packs", _places(size, carry)("measures")).select("doc_id", "pieces", F.posexplode("packs").alias("chunk_index", "at"))
    content = F.array_join(F.slice("pieces", F.col("at.start") + 1, F.col("at.n")), glue)
    return placed.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), content.alias("content"), F.col("at.n").cast("long").alias("n_pieces"), F.col("at.size").alias("size"))


def pack_paragraphs(docs: DataFrame, size: int, overlap: bool = False) -> DataFrame:
    """Paragraphs packed to ``size`` characters, separators not counted; with overlap, a chunk repeats the last paragraph before it."""
    return _packed(docs.select("doc_id", tx.paragraphs(F.col("text")).alias("pieces")), lambda p: F.length(p).cast("long"), size, 1 if overlap else 0, "\n\n")


def pack_sentences(docs: DataFrame, size: int, overlap: int = 2, least: int = 11) -> DataFrame:
    """Sentences packed to ``size`` tokens; a chunk repeats the last sentences before it. Shorter sentences than ``least`` characters are left out."""
    return _packed(docs.select("doc_id", tx.sentences(F.col("text"), least).alias("pieces")), tk.char_tokens, size, overlap, " ")


def by_headings(docs: DataFrame) -> DataFrame:
    """Sections between markdown headings: (doc_id, section, level, title, content); what stands before the first has level 0."""
    parts = F.split(F.col("text"), r"(?md)^(?=#{1,6} )")
    rows = docs.select("doc_id", F.posexplode(parts).alias("section", "part")).filter(F.trim("part") != "")
    title = F.regexp_extract("part", r"(?d)^#{1,6} (.*)", 1)
    body = F.regexp_replace("part", r"(?d)^#{1,6} .*\n?", "")
    return rows.select("doc_id", F.col("section").cast("long").alias("section"), F.length(F.regexp_extract("part", r"^(#{1,6}) ", 1)).cast("long").alias("level"), F.trim(title).alias("title"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("content"))


def size_filter(chunks: DataFrame, least: int = 100) -> DataFrame:
    """Chunks whose trimmed content has at least so many characters. Ordinals stay; ``seq`` counts those kept."""
    kept = chunks.filter(F.length(F.trim("content")) >= least)
    return kept.withColumn("seq", (F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")) - 1).cast("long"))


def _large_windows(text: str, most: int, overlap: int) -> Iterator[tuple[int, str]]:
    start = 0
    while start < len(text):
        end = start + most
        if end >= len(text):
            yield start, text[start:]
            return
        window = text[start:end]
        for mark in (". ", ".\n", "\n\n"):
            if (at := window.rfind(mark)) > 0.7 * most:
                end = start + at + len(mark)
                break
        yield start, text[start:end]
        start = max(start + 1, end - overlap)


def _recursive(text: str, size: int, separators: Sequence[str]) -> Iterator[str]:
    """The first separator that occurs splits; a piece starts with its separator; longer pieces are split by the next ones."""
    used = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    mark = separators[used]
    pieces = re.split(f"(?={re.escape(mark)})", text) if mark else list(text)
    for piece in filter(None, pieces):
        if len(piece) <= size or used + 1 >= len(separators):
            yield piece
        else:
            yield from _recursive(piece, size, separators[used + 1 :])


def _merge(pieces: Iterator[str], size: int, overlap: int) -> Iterator[str]:
    held: list[str] = []
    total = 0
    for piece in pieces:
        if held and total + len(piece) > size:
            yield "".join(held)
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    if held:
        yield "".join(held)


def split_large(docs: DataFrame, most: int = 4000, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk_index, start_char, content): windows that end behind a sentence or blank line if one lies in their last part; shorter texts stay whole."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, k, s, c) for i, t in zip(frame["doc_id"], frame["text"], strict=True) if t for k, (s, c) in enumerate(_large_windows(t, most, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "start_char", "content"])

    return docs.select("doc_id", "text").mapInPandas(split, "doc_id long, chunk_index long, start_char long, content string")


def split_recursive(docs: DataFrame, size: int = 1000, overlap: int = 200, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """(doc_id, chunk_index, content): pieces cut at ever finer separators and merged up to ``size`` characters, repeating up to ``overlap``."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, t in zip(frame["doc_id"], frame["text"], strict=True):
                chunks = filter(None, (c.strip() for c in _merge(_recursive(t, size, separators), size, overlap))) if t else ()
                rows += [(i, k, c) for k, c in enumerate(chunks)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "content"])

    return docs.select("doc_id", "text").mapInPandas(split, "doc_id long, chunk_index long, content string")


def summary(chunks: DataFrame) -> DataFrame:
    """Count, total, mean, least and most characters of a chunk table."""
    n = F.length("content")
    return chunks.agg(
        F.count("*").alias("total_chunks"), F.coalesce(F.sum(n), F.lit(0)).alias("total_chars"), F.round(F.avg(n), 4).alias("avg_chars"), F.min(n).cast("long").alias("min_chars"), F.max(n).cast("long").alias("max_chars"),
        F.coalesce(F.sum(tk.char_tokens(F.col("content"))), F.lit(0)).alias("total_tokens"),
    )


def size_report(chunks: DataFrame, size: Column, least: int, target: tuple[int, int], most: int) -> DataFrame:
    """How chunk sizes lie against the least, the target range and the most; the upper median of the sizes."""
    s = chunks.select(size.alias("s"))
    low, high = target
    out = s.agg(
        F.count("*").alias("total_chunks"), F.sum("s").alias("total_tokens"), F.round(F.avg("s"), 4).alias("average"), F.min("s").alias("minimum"), F.max("s").alias("maximum"),
        F.count_if(F.col("s").between(low, high)).alias("within_target"), F.count_if(F.col("s") < least).alias("too_small"), F.count_if((F.col("s") >= least) & (F.col("s") < low)).alias("small_but_acceptable"),
        F.count_if(F.col("s") > most).alias("too_large"), F.count_if((F.col("s") > high) & (F.col("s") <= most)).alias("large_but_acceptable"),
    )
    # The upper median from the counts of sizes, which are few, not from all sizes in one place.
    counts = s.groupBy("s").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("s"))).crossJoin(out.select("total_chunks"))
    median = upto.filter(F.col("upto") > F.floor(F.col("total_chunks") / 2)).agg(F.min("s").alias("median"))
    return out.crossJoin(median).withColumn("efficiency", F.round(F.col("within_target") * 100 / F.col("total_chunks"), 4))


def section_tokens(docs: DataFrame, pattern: str = r"(?i)\n\s*(?:section|§)\s*\d+") -> DataFrame:
    """(doc_id, section, tokens, preview): the pieces between matches of a section pattern."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", pattern)).alias("section", "part"))
    return rows.select("doc_id", F.col("section").cast("long").alias("section"), tk.char_tokens(F.col("part")).alias("tokens"), tx.preview(F.col("part"), 50).alias("preview"))


def distribution(chunks: DataFrame, kind: Column, small: int = 500, large: int = 1500) -> DataFrame:
    """(kind, n_chunks, n_small, n_medium, n_large, total_tokens) of a chunk table."""
    n = F.length("content")
    return chunks.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("n_chunks"), F.count_if(n < small).alias("n_small"), F.count_if((n >= small) & (n < large)).alias("n_medium"), F.count_if(n >= large).alias("n_large"), F.sum(tk.char_tokens(F.col("content"))).alias("total_tokens")
    )


def recommendations(report: DataFrame) -> DataFrame:
    """What a size report suggests, as rows (recommendation)."""
    advice = F.array(
        F.when(F.col("too_small") > 0, F.concat(F.lit("merge "), F.col("too_small").cast("string"), F.lit(" small chunks"))),
        F.when(F.col("too_large") > 0, F.concat(F.lit("split "), F.col("too_large").cast("string"), F.lit(" large chunks"))),
        F.when(F.col("efficiency") < 80, F.lit("adjust the chunk size")),
    )
    return report.select(F.explode(F.filter(advice, lambda x: x.isNotNull())).alias("recommendation"))


def hierarchical(docs: DataFrame, boundaries: DataFrame, size: int = 400, largest: int = 600) -> DataFrame:
    """(doc_id, chunk_index, content, tokens): texts cut at their boundaries (doc_id, pos), packed to ``size`` tokens; a piece over ``largest`` is cut into equal parts.

    All text is kept. A document without boundaries is one piece before packing.
    """
    marks = boundaries.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("pos").cast("int"))).alias("marks"))
    joined = docs.select("doc_id", "text").filter("text <> ''").join(marks, "doc_id", "left")
    cuts = F.array_distinct(F.concat(F.array(F.lit(0)), F.coalesce("marks", F.array().cast("array<int>")), F.array(F.length("text"))))
    rows = joined.withColumn("cuts", cuts)
    pieces = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda i: F.substring("text", F.get("cuts", i) + 1, F.get("cuts", i + 1) - F.get("cuts", i)))
    measured = F.filter(pieces, lambda p: F.trim(p) != "")
    packed = _packed(rows.select("doc_id", measured.alias("pieces")), tk.char_tokens, size, 0, "").select("doc_id", F.col("chunk_index").alias("pos"), "content")
    parts = F.greatest(F.lit(1), F.ceil(tk.char_tokens(F.col("content")) / largest)).cast("int")
    width = F.ceil(F.length("content") / parts).cast("int")
    split = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.substring("content", i * width + 1, width))
    out = packed.select("doc_id", "pos", F.posexplode(split).alias("part", "content"))
    order = Window.partitionBy("doc_id").orderBy("pos", "part")
    return out.select("doc_id", (F.row_number().over(order) - 1).cast("long").alias("chunk_index"), "content", tk.char_tokens(F.col("content")).alias("tokens"))
