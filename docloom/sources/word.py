"""Word files as typed rows: paragraphs with their styles, tables cell by cell, sections and properties."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.sources.files import MOST_BYTES, WORD

ELEMENT = "path string, element long, kind string, level int, style string, alignment string, left_indent int, right_indent int, table_index int, row_index int, cell_index int, text string, error string"
PROPERTY = "path string, title string, author string, subject string, keywords string, comments string, created string, modified string, last_modified_by string, revision int, file_size long, error string"
#: Names of the core properties in their part of the file, and names of alignments.
CORE = {"title": "title", "author": "creator", "subject": "subject", "keywords": "keywords", "comments": "description", "created": "created", "modified": "modified", "last_modified_by": "lastModifiedBy", "revision": "revision"}
ALIGNMENTS = {"left": "left", "start": "left", "center": "center", "right": "right", "end": "right", "both": "justify", "distribute": "distribute"}
HEADING = "heading"


def _value(node: ElementTree.Element | None, *names: str) -> str | None:
    if node is None:
        return None
    return next((v for n in names if (v := node.get(f"{WORD}{n}")) is not None), None)


def _text(paragraph: ElementTree.Element) -> str:
    """The text of a paragraph's runs, with its tabs and breaks."""
    out = []
    for node in paragraph.iter():
        if node.tag == f"{WORD}t":
            out.append(node.text or "")
        elif node.tag == f"{WORD}tab" and node.get(f"{WORD}val") is None:
            out.append("\t")
        elif node.tag in (f"{WORD}br", f"{WORD}cr"):
            out.append("\n")
    return "".join(out)


def _styles(archive: zipfile.ZipFile) -> tuple[dict[str, str], str]:
    """Names of paragraph styles by id, and the default one."""
    if "word/styles.xml" not in archive.namelist():
        return {}, "Normal"
    names, default = {}, "Normal"
    for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{WORD}style"):
        name = _value(style.find(f"{WORD}name"), "val") or _value(style, "styleId") or ""
        name = name[:1].upper() + name[1:] if name.startswith("heading") else name
        names[_value(style, "styleId") or name] = name
        if _value(style, "type") == "paragraph" and _value(style, "default") in ("1", "true"):
            default = name
    return names, default


def _whole(text: str | None) -> int | None:
    return int(float(text)) if text else None


def _paragraph(node: ElementTree.Element, names: dict[str, str], default: str) -> tuple | None:
    """(kind, level, style, alignment, left indent, right indent, text); None for a blank one. Indents are twentieths of a point."""
    text = _text(node).strip()
    if not text:
        return None
    own = node.find(f"{WORD}pPr")
    style = default if own is None else names.get(_value(own.find(f"{WORD}pStyle"), "val") or "", _value(own.find(f"{WORD}pStyle"), "val") or default)
    indent = None if own is None else own.find(f"{WORD}ind")
    left, right = _whole(_value(indent, "left", "start")), _whole(_value(indent, "right", "end"))
    aligned = ALIGNMENTS.get(_value(own.find(f"{WORD}jc"), "val") or "") if own is not None else None
    if style.lower().startswith(HEADING):
        digits = style[len(HEADING) :].strip()
        return HEADING, int(digits) if digits.isdigit() else 1, style, aligned, left, right, text
    return "list_item" if left else "paragraph", None, style, aligned, left, right, text


def _cells(row: ElementTree.Element) -> Iterator[str]:
    """Texts of a row's cells; one that spans several columns stands in each."""
    for cell in row.findall(f"{WORD}tc"):
        text = "\n".join(_text(p) for p in cell.findall(f"{WORD}p")).strip()
        span = _value(cell.find(f"{WORD}tcPr/{WORD}gridSpan"), "val")
        yield from [text] * (int(span) if span else 1)


def _elements(path: str, data: bytes) -> Iterator[tuple]:
    """A file's rows: its paragraphs in order, then its tables' cells."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    names, default = _styles(archive)
    body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{WORD}body")
    at = 0
    for node in body.findall(f"{WORD}p") if body is not None else ():
        if (found := _paragraph(node, names, default)) is not None:
            yield path, at, *found[:6], None, None, None, found[6], None
            at += 1
    for t, table in enumerate(body.findall(f"{WORD}tbl") if body is not None else ()):
        for r, row in enumerate(table.findall(f"{WORD}tr")):
            for c, text in enumerate(_cells(row)):
                yield path, at, "table", None, None, None, None, None, t, r, c, text, None
        at += 1


def _properties(path: str, data: bytes) -> tuple:
    archive = zipfile.ZipFile(io.BytesIO(data))
    found = {}
    if "docProps/core.xml" in archive.namelist():
        found = {node.tag.rpartition("}")[2]: node.text or "" for node in ElementTree.fromstring(archive.read("docProps/core.xml"))}
    own = [found.get(name, "") for name in CORE.values()]
    return path, *own[:-1], int(own[-1]) if own[-1].isdigit() else 0, len(data), None


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path).select("path", "content")


def _read(spark: SparkSession, path: str, schema: str, rows_of) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for where, data in zip(frame["path"], frame["content"], strict=True):  # a file at a time
                try:
                    if len(data) > MOST_BYTES:
                        raise ValueError("file_too_large")
                    out = list(rows_of(where, data))
                except Exception as x:
                    out = [(where, *[None] * (len(names) - 2), f"{type(x).__name__}: {x}"[:200])]
                yield pd.DataFrame(out, columns=names, dtype=object)

    return _files(spark, path).mapInPandas(load, schema)


def word_elements(spark: SparkSession, path: str) -> DataFrame:
    """Every .docx file of a folder as rows (path, element, kind, level, style, alignment, left_indent, right_indent, table_index, row_index, cell_index, text, error).

    Elements are headings (by style, with their level), list items (indented paragraphs), paragraphs, and behind them the cells of tables, a table being one element. Blank paragraphs go. A file that can't be read, is damaged or over 50 MB has one row with its error; a file without content has none.
    """
    return _read(spark, path, ELEMENT, _elements)


def word_properties(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, author, subject, keywords, comments, created, modified, last_modified_by, revision, file_size, error) of every .docx file; a property that is not there is empty, and 0 the revision."""
    return _read(spark, path, PROPERTY, lambda where, data: [_properties(where, data)])


def word_tables(elements: DataFrame) -> DataFrame:
    """(path, table_index, row_index, cells, is_header) of the rows of tables; the first row is a header if fewer of its cells hold a digit than of the second's."""
    cells = elements.filter("kind = 'table'").groupBy("path", "table_index", "row_index").agg(F.array_sort(F.collect_list(F.struct("cell_index", "text"))).alias("x"))
    rows = cells.select("path", "table_index", "row_index", F.col("x.text").alias("cells"))
    digits = F.size(F.filter("cells", lambda c: c.rlike(r"\p{Nd}")))
    below = F.lead(digits).over(Window.partitionBy("path", "table_index").orderBy("row_index"))
    return rows.select("path", "table_index", "row_index", "cells", ((F.col("row_index") == 0) & F.coalesce(digits < below, F.lit(False))).alias("is_header"))


def word_sections(elements: DataFrame) -> DataFrame:
    """(path, section, content, n_elements, word_count, char_count, styles): a heading begins a section, whose elements are joined by blank lines; a table stands as its number in brackets.

    Sections are numbered by a running sum of headings over a file's elements.
    """
    one = elements.filter("error IS NULL").groupBy("path", "element").agg(F.first("kind").alias("kind"), F.first("style").alias("style"), F.first("table_index").alias("t"), F.first("text").alias("text"))
    shown = F.when(F.col("kind") == "table", F.concat(F.lit("[TABLE_"), F.col("t").cast("string"), F.lit("]"))).otherwise(F.col("text"))
    order = Window.partitionBy("path").orderBy("element")
    begins = F.when((F.col("kind") == HEADING) & (F.row_number().over(order) > 1), 1).otherwise(0)
    rows = one.withColumn("shown", shown).withColumn("begins", begins).withColumn("section", F.sum("begins").over(order))
    whole = rows.groupBy("path", "section").agg(F.array_sort(F.collect_list(F.struct("element", "shown"))).alias("x"), F.array_sort(F.collect_set("style")).alias("styles"))
    content = F.array_join("x.shown", "\n\n")
    words = F.size(F.filter(F.split(content, r"\s+"), lambda w: w != ""))
    return whole.select("path", "section", content.alias("content"), F.size("x").cast("long").alias("n_elements"), words.cast("long").alias("word_count"), F.length(content).cast("long").alias("char_count"), "styles")
