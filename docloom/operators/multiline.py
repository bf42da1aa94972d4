"""Headings of several lines.

A heading starts at a short line in title case or capitals and takes the lines behind it, three lines at most, up to a blank or long one; the next can only start behind it. So within a run of lines the starts are counted anew from each heading, which no window expresses: of each text only the lengths and kinds of its lines, three small numbers, go through an Arrow batch that places the headings. All else are column expressions within the row; nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import strip

#: A starting line is shorter than 50 characters, a line in a heading has 80 at most, a heading 3 lines and 200 characters.
START_LENGTH, LINE_LENGTH, MOST_LINES, LONGEST = 50, 80, 3, 200
PLACES = "array<struct<line:int,n:int,start:long,end:long>>"


def is_upper(text: Column) -> Column:
    """A capital letter and none that is small or of title form."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")


def is_title(text: Column) -> Column:
    """Capitals only behind what has no case, small letters only behind what has, and a capital at all."""
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    return text.rlike(r"[\p{Lu}\p{Lt}]") & ~text.rlike(rf"[{cased}][\p{{Lu}}\p{{Lt}}]") & ~text.rlike(rf"(^|[^{cased}])\p{{Ll}}")


def heading_places(kinds: pd.Series, lengths: pd.Series) -> pd.Series:
    """First line (from 0), number of lines, and first and last character place of each heading.

    A kind is 2 for a line that may start a heading, 1 for one that may go on, 0 for one that ends it; a length is that of the whole line.
    """

    def places(kind: np.ndarray | None, length: np.ndarray) -> list[tuple[int, int, int, int]]:
        if kind is None:
            return []
        kind = np.asarray(kind, dtype=np.int8)
        ends = np.cumsum(np.asarray(length, dtype=np.int64) + 1)
        out, free = [], 0
        for start in np.flatnonzero(kind == 2).tolist():
            if start < free:
                continue
            stop = start + 1
            while stop < len(kind) and stop - start < MOST_LINES and kind[stop]:
                stop += 1
            free = stop
            if stop - start > 1:
                out.append((start, stop - start, int(ends[start - 1]) if start else 0, int(ends[stop - 1]) - 1))
        return out

    return pd.Series([places(k, n) for k, n in zip(kinds, lengths, strict=True)])


def multiline_headings(docs: DataFrame) -> DataFrame:
    """(doc_id, line_number, n_lines, start, end, title, confidence) of every heading of two or three lines; lines count from 1.

    Confidence is 0.4, plus 0.2 where all its lines are in title case, else 0.3 where all are in capitals, plus 0.1 before a blank line; 0.8 at most. A heading of over 200 characters is left out, though its lines are used up. Null and empty texts have none; repeated rows have theirs each.
    """
    parts = docs.select("doc_id", F.split("text", "\n", -1).alias("raw")).select("doc_id", "raw", F.transform("raw", strip).alias("bare"))
    starts = lambda x: (F.length(x) < START_LENGTH) & (is_title(x) | is_upper(x))
    kind = F.transform("bare", lambda x: F.when((x == "") | (F.length(x) > LINE_LENGTH), 0).when(starts(x), 2).otherwise(1))
    placed = parts.select("doc_id", "bare", kind.alias("kind"), F.transform("raw", F.length).alias("length"))
    placed = placed.filter(F.array_contains("kind", 2)).withColumn("at", F.explode(F.pandas_udf(heading_places, PLACES)("kind", "length")))
    own = placed.select("doc_id", "at.*", F.expr("slice(bare, at.line + 1, at.n)").alias("lines"), F.expr("get(bare, at.line + at.n)").alias("behind"))
    style = F.when(F.forall("lines", is_title), 2).when(F.forall("lines", is_upper), 3).otherwise(0)
    tenths = F.least(F.lit(8), 4 + style + F.when(F.col("behind") == "", 1).otherwise(0))
    title = F.array_join("lines", " ")
    rows = own.select("doc_id", (F.col("line") + 1).cast("long").alias("line_number"), F.col("n").cast("long").alias("n_lines"), "start", "end", title.alias("title"), (tenths / 10).cast("double").alias("confidence"))
    return rows.filter(F.length("title") <= LONGEST)
