"""Kinds of lines, positions of passages and structure counts of plain texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import strip

#: Words that make a line a heading, those of the first two levels, and the marks that begin a list item.
HEADING_WORDS = ("chapter", "section", "introduction", "conclusion", "abstract")
LEVEL_ONE, LEVEL_TWO = ("chapter", "part"), ("section", "introduction", "conclusion")
BULLETS = ("•", "◦", "▪", "▫", "‣", "⁃", "-", "*")


def holds(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words stands anywhere in the text, whatever its case."""
    return F.lower(text).rlike("|".join(words))


def is_upper(text: Column) -> Column:
    """A capital and no small letter."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}")


def is_list_item(line: Column) -> Column:
    """A digit in front and a point or bracket within the first five characters, or a bullet in front."""
    bare = strip(line)
    return (bare.rlike(r"^\p{Nd}") & F.left(bare, F.lit(5)).rlike("[.)]")) | F.left(bare, F.lit(1)).isin(*BULLETS)


def is_heading(line: Column) -> Column:
    """A capital in front, at most 100 characters, no sentence of over 50, and a heading's word somewhere or capitals alone, over three characters."""
    bare = strip(line)
    sentence = bare.endswith(".") & (F.length(bare) > 50)
    return (F.length(bare) <= 100) & ~sentence & bare.rlike(r"^\p{Lu}") & (holds(bare, HEADING_WORDS) | (is_upper(bare) & (F.length(bare) > 3)))


def heading_level(line: Column) -> Column:
    bare = strip(line)
    return F.when(is_upper(bare) | holds(bare, LEVEL_ONE), 1).when(holds(bare, LEVEL_TWO), 2).otherwise(3)


def line_elements(docs: DataFrame) -> DataFrame:
    """(doc_id, line_number, kind, level, title): headings with their level, numbered and bulleted items, and paragraphs of over 20 characters; lines count from 0. Of two kinds that fit the first in this order holds."""
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_number", "line")).select("doc_id", "line_number", strip(F.col("line")).alias("title"))
    bare = F.col("title")
    item = F.when(bare.rlike(r"^\p{Nd}"), "numbered").otherwise("bulleted")
    kind = F.when(is_heading(bare), "heading").when(is_list_item(bare), item).when(F.length(bare) > 20, "paragraph")
    return each.select("doc_id", F.col("line_number").cast("long").alias("line_number"), kind.alias("kind"), F.when(is_heading(bare), heading_level(bare)).cast("long").alias("level"), "title").filter("kind IS NOT NULL")


def line_kinds(docs: DataFrame) -> DataFrame:
    """(doc_id, n_headings, n_top, n_items, n_paragraphs): lines by kind, as :func:`line_elements` has them. Null texts have no lines."""
    each = docs.select("doc_id", F.explode_outer(F.split("text", "\n")).alias("line"))
    kind = F.when(is_heading(F.col("line")), "heading").when(is_list_item(F.col("line")), "item").when(F.length(strip(F.col("line"))) > 20, "paragraph")
    each = each.select("doc_id", kind.alias("kind"), heading_level(F.col("line")).alias("level"))
    return each.groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "heading").alias("n_headings"),
        F.count_if((F.col("kind") == "heading") & (F.col("level") == 1)).alias("n_top"),
        F.count_if(F.col("kind") == "item").alias("n_items"),
        F.count_if(F.col("kind") == "paragraph").alias("n_paragraphs"),
    )


#: Marked headings and list items; a mark needs text behind it.
MARKED = r"(?dm)^#{1,6}\s+.+$"
LISTED = r"(?dm)^\s*[-*+]\s+.+$|^\s*\d+\.\s+.+$"


def split_structure(text: Column) -> dict[str, Column]:
    """What decides how a text is split: marked headings, paragraphs of over 50 characters with their mean length, list items."""
    long = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: F.length(p) > 50)
    marked, listed = F.regexp_count(text, F.lit(MARKED)).cast("long"), F.regexp_count(text, F.lit(LISTED)).cast("long")
    total = F.aggregate(long, F.lit(0).cast("long"), lambda n, p: n + F.length(p))
    return {
        "n_marked": marked,
        "n_long": F.size(long).cast("long"),
        "n_listed": listed,
        "has_headings": marked > 0,
        "has_paragraphs": F.size(long) > 2,
        "has_lists": listed > 0,
        "avg_long": F.round(total / F.greatest(F.lit(1), F.size(long)), 6),
    }


def split_plan(text: Column) -> Column:
    """How a text is split: by its headings, else by its paragraphs, else plainly."""
    found = split_structure(text)
    return F.when(found["has_headings"], "headings").when(found["has_paragraphs"], "paragraphs").otherwise("basic")


def passage_positions(text: Column, passage: Column) -> dict[str, Column]:
    """Start and end of the first place where the passage stands (null if nowhere), and whether the text there equals it but for spaces at the ends."""
    at = F.call_function("instr", text, passage)
    start = F.when(at > 0, (at - 1).cast("long"))
    return {"start": start, "end": start + F.length(passage), "valid": F.trim(F.substring(text, at, F.length(passage))) == F.trim(passage)}


def megabytes(n_bytes: Column) -> Column:
    return F.round(n_bytes.cast("double") / 1048576.0, 1)
