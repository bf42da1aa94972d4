"""Records of documents, chunks and nodes: summaries, merges of maps and lists, checks of trees, corrected test cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import tokens as tk
from docloom.operators import lines

#: What costs more tokens in legal texts when no tokenizer answers.
COSTLY = (r"(?i)\b(?:§|Section|Sec\.?)\s*\d+(?:\.\d+)*\b", r"(?i)\b\d+\s+[A-Z][a-z]+\.?\s+\d+\b", r"(?i)\([a-z]\)|(?:\([ivx]+\))")


def merged_maps(first: Column, second: Column) -> Column:
    """Both maps' entries; of equal keys the second's value stays."""
    kept = F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k))
    return F.map_concat(kept, second)


def added(items: Column, item: Column) -> Column:
    """The list with an item at its end, unless it holds it; a null list is an empty one."""
    known = F.coalesce(items, F.array_except(F.array(item), F.array(item)))
    return F.when(F.array_contains(known, item), known).otherwise(F.array_append(known, item))


def removed(items: Column, item: Column) -> Column:
    return F.array_remove(items, item)


def centred(text: Column, width: int = 80) -> Column:
    """Spaces on both sides up to the width; of an odd number the one more on the left if the width is odd too, else on the right."""
    pad = F.lit(width) - F.length(text)
    left = F.floor(pad / 2) + F.when((pad % 2 == 1) & (F.lit(width) % 2 == 1), 1).otherwise(0)
    return F.when(pad <= 0, text).otherwise(F.rpad(F.concat(F.repeat(F.lit(" "), left.cast("int")), text), width, " "))


def fallback_tokens(text: Column, legal: bool = True) -> Column:
    """Characters over three, at least 1; for legal texts a tenth more, and one for each section, citation and subsection mark."""
    base = F.greatest(F.lit(1), F.floor(F.length(text) / 3)).cast("long")
    if not legal:
        return base
    extra = sum((F.regexp_count(text, F.lit(p)) for p in COSTLY), F.lit(0))
    return (F.floor(base * 1.1) + extra).cast("long")


def tokens_with_metadata(text: Column, metadata: Column) -> Column:
    """Tokens of a text and of its metadata as JSON."""
    return tk.char_tokens(text) + tk.char_tokens(F.to_json(metadata))


def valid_sizes(least: Column, most: Column) -> Column:
    """0 < least < most; a null is not valid."""
    return F.coalesce((least > 0) & (least < most), F.lit(False))


def chunk_overview(chunks: DataFrame, *groups: str) -> DataFrame:
    """(groups, n_chunks, avg_length, min_length, max_length, n_sources, first_sources) of chunks (content, source): of the sources' file names the first three of the alphabet."""
    n, name = F.length("content"), F.regexp_extract("source", r"([^/]*)$", 1)
    out = chunks.groupBy(*groups).agg(
        F.count("*").alias("n_chunks"), F.round(F.avg(n), 4).alias("avg_length"), F.min(n).cast("long").alias("min_length"), F.max(n).cast("long").alias("max_length"), F.array_sort(F.collect_set(name)).alias("__names")
    )
    return out.select(*groups, "n_chunks", "avg_length", "min_length", "max_length", F.size("__names").cast("long").alias("n_sources"), F.slice("__names", 1, 3).alias("first_sources"))


def rejoined(chunks: DataFrame, glue: str = "\n") -> DataFrame:
    """(doc_id, text, n_chunks): each document's chunks in order, joined."""
    rows = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("x"))
    return rows.select("doc_id", F.array_join("x.content", glue).alias("text"), F.size("x").cast("long").alias("n_chunks"))


def hierarchy_totals(found: DataFrame) -> DataFrame:
    """(doc_id, total_elements, n_roots, max_depth) of elements (doc_id, level, parent_line)."""
    return found.groupBy("doc_id").agg(F.count("*").alias("total_elements"), F.count_if(F.col("parent_line").isNull()).alias("n_roots"), F.max("level").cast("long").alias("max_depth"))


def rooted(nodes: DataFrame, made_up: int) -> DataFrame:
    """The forest (node, parent, ord) under one root: itself if it has one root, else with a made-up root over all of them. Nodes whose parent is not there are roots."""
    own = nodes.select(F.col("node").alias("__n"))
    held = nodes.join(own, F.col("parent") == F.col("__n"), "left").select("node", F.col("__n").alias("parent"), "ord")
    several = held.filter("parent IS NULL").agg((F.count("*") > 1).alias("several"))
    both = held.crossJoin(F.broadcast(several))
    placed = both.select("node", F.when(F.col("parent").isNull() & F.col("several"), F.lit(made_up).cast("long")).otherwise(F.col("parent")).alias("parent"), "ord")
    return placed.unionByName(several.filter("several").select(F.lit(made_up).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("ord")))


def child_at(nodes: DataFrame, index: int) -> DataFrame:
    """(parent, node): each node's child of that place, from 0, or from the end if negative."""
    order = [F.col("ord"), F.col("node")] if index >= 0 else [F.desc("ord"), F.desc("node")]
    place = F.row_number().over(Window.partitionBy("parent").orderBy(*order))
    at = index + 1 if index >= 0 else -index
    return nodes.filter("parent IS NOT NULL").withColumn("__at", place).filter(F.col("__at") == at).select("parent", "node")


def tree_violations(found: DataFrame, stored: DataFrame) -> DataFrame:
    """(node, violation): nodes whose stored depth is not that of their way from the root, or that have no way, and stored lines that come before their parent's. ``found`` has paths, ``stored`` (node, parent, depth, line)."""
    rows = stored.join(found.select("node", F.col("depth").alias("true_depth")), "node", "left")
    up = stored.select(F.col("node").alias("parent"), F.col("line").alias("parent_line"))
    rows = rows.join(up, "parent", "left")
    checks = F.array(
        F.when(F.col("true_depth").isNull(), "no_way_to_root"),
        F.when(F.col("true_depth") != F.col("depth"), "wrong_depth"),
        F.when(F.col("line") < F.col("parent_line"), "before_parent"),
    )
    return rows.select("node", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("violation"))


def corrected_cases(cases: DataFrame, texts: DataFrame) -> DataFrame:
    """(case_id, doc_id, start, end, answer): test cases (case_id, doc_id, answer) with the first place where their answer stands in the document; those whose place does not hold are left out."""
    joined = cases.join(texts.select("doc_id", "text"), "doc_id").filter("answer <> ''")
    at = lines.passage_positions(F.col("text"), F.col("answer"))
    placed = joined.select("case_id", "doc_id", "answer", *[c.alias(k) for k, c in at.items()])
    return placed.filter(F.col("start").isNotNull() & F.col("valid")).select("case_id", "doc_id", "start", "end", "answer")


def formatting(chars: Column) -> dict[str, Column]:
    """Fonts, sizes and colours of an array of characters (fontname, size, ncs), sorted and each once, and how many are bold or italic."""
    name = lambda c: F.lower(F.coalesce(c["fontname"], F.lit("")))
    kept = lambda key, kind: F.array_sort(F.array_distinct(F.filter(F.transform(chars, lambda c: c[key].try_cast(kind)), lambda x: x.isNotNull())))
    count = lambda pattern: F.size(F.filter(chars, lambda c: name(c).rlike(pattern))).cast("long")
    return {"fonts": kept("fontname", "string"), "font_sizes": kept("size", "double"), "colors": kept("ncs", "string"), "bold_chars": count("bold"), "italic_chars": count("italic|oblique"), "total_chars": F.size(chars).cast("long")}
