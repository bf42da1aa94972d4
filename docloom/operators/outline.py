"""Look-ups over the elements of documents, and what their numbering tells."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import numbering
from docloom.functions import tokens as tk
from docloom.functions.text import WHITE
from docloom.operators import trees

#: Kinds of elements, those that are sections, confidences of edges made from parents, and the advice on numbering.
KINDS = ("article", "chapter", "clause", "heading", "list_item", "paragraph", "section", "subsection")
SECTIONS = ("section", "subsection")
EDGE_CONFIDENCE, EDGE_SIMILARITY, BASE_CONFIDENCE = 0.95, 0.9, 0.8
MOST_TYPES, DEEPEST, LEAST_TOP = 3, 5, 0.3


def find_elements(found: DataFrame, kinds: Sequence[str] | None = None, level: int | None = None, text: str | None = None, exact: bool = False, line: int | None = None) -> DataFrame:
    """Elements (doc_id, line_number, element_type, level, title) of some kinds, of a level, with a text in their title whatever its case (or that is all of it as written), at a line; all that is given must hold."""
    out = found
    if kinds is not None:
        out = out.filter(F.col("element_type").isin(*kinds))
    if level is not None:
        out = out.filter(F.col("level") == level)
    if text is not None:
        out = out.filter(F.col("title") == text if exact else F.contains(F.lower("title"), F.lit(text.lower())))
    return out if line is None else out.filter(F.col("line_number") == line)


def at_line(rows: DataFrame) -> DataFrame:
    """(doc_id, line_number, node): of several nodes registered for a line the last, from (doc_id, line_number, node, registered)."""
    return rows.groupBy("doc_id", "line_number").agg(F.max_by("node", F.struct("registered", "node")).alias("node"))


def first_numbered(numbers: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, full_number, line_number): the first element of a document with each wanted (doc_id, full_number); those of no element have no row."""
    return numbers.join(wanted, ["doc_id", "full_number"], "left_semi").groupBy("doc_id", "full_number").agg(F.min("line_number").alias("line_number"))


def full_numbers(found: DataFrame, parents: DataFrame) -> DataFrame:
    """(doc_id, line_number, full_number, path): each element's number behind those of its parents, with points between, and the way from the root as numbers or, without one, kinds of elements.

    ``parents`` has (doc_id, line_number, parent_line), of which an element without a row is a root. The ways come a level a round, see :func:`docloom.operators.trees.paths`.
    """
    rows = found.select("doc_id", "line_number", "value", "element_type").join(parents.select("doc_id", "line_number", "parent_line"), ["doc_id", "line_number"], "left")
    node = F.struct("doc_id", "line_number")
    up = F.when(F.col("parent_line").isNotNull(), F.struct("doc_id", F.col("parent_line").alias("line_number")))
    ways = trees.paths(rows.select(node.alias("node"), up.alias("parent"), F.struct("value", "element_type").alias("ord")))
    numbers = F.filter(F.transform("places", lambda p: p["value"]), lambda v: v.isNotNull())
    return ways.select("node.doc_id", "node.line_number", F.array_join(numbers, ".").alias("full_number"), F.transform("places", lambda p: F.coalesce(p["value"], p["element_type"])).alias("path"))


def children_of(elements: DataFrame) -> DataFrame:
    """(doc_id, element, child, ord): the children that each element's list (doc_id, element, child_ids) names, in its order; those that are not there are left out."""
    asked = elements.select("doc_id", "element", F.posexplode("child_ids").alias("ord", "child"))
    return asked.join(elements.select("doc_id", F.col("element").alias("child")), ["doc_id", "child"], "left_semi").select("doc_id", "element", "child", F.col("ord").cast("long").alias("ord"))


def resolved_reference(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """The chunks (doc_id, chunk_index, refs) with the first of their references that is an element (doc_id, element, ...), as a struct of its columns; null without one."""
    facts = [c for c in elements.columns if c != "doc_id"]
    named = chunks.select("doc_id", "chunk_index", F.posexplode("refs").alias("pos", "element")).join(elements, ["doc_id", "element"])
    first = named.groupBy("doc_id", "chunk_index").agg(F.min_by(F.struct(*facts), F.col("pos")).alias("reference"))
    return chunks.join(first, ["doc_id", "chunk_index"], "left")


def edges_from_parents(rows: DataFrame) -> DataFrame:
    """(doc_id, source, target, kind, bidirectional, confidence, similarity) from elements (doc_id, element, text, line_number, parent_text, parent_line): the parent is the first element of the document with that text at that line; without one there is no edge."""
    key = rows.select(F.col("doc_id").alias("__d"), F.col("text").alias("__t"), F.col("line_number").alias("__l"), F.col("element").alias("source")).groupBy("__d", "__t", "__l").agg(F.min("source").alias("source"))
    joined = rows.join(key, (F.col("doc_id") == F.col("__d")) & (F.col("parent_text") == F.col("__t")) & (F.col("parent_line") == F.col("__l")))
    return joined.select("doc_id", "source", F.col("element").alias("target"), F.lit("parent_child").alias("kind"), F.lit(True).alias("bidirectional"), F.lit(EDGE_CONFIDENCE).alias("confidence"), F.lit(EDGE_SIMILARITY).alias("similarity"))


def type_counts(found: DataFrame) -> DataFrame:
    """(doc_id, element_type, n) for all kinds of elements in each document that has elements, zeros included."""
    counts = found.groupBy("doc_id").agg(*[F.count_if(F.col("element_type") == k).alias(k) for k in KINDS])
    return counts.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("element_type"), F.col(k).alias("n")) for k in KINDS])).alias("x")).select("doc_id", "x.*")


def structure_confidence(found: DataFrame) -> DataFrame:
    """(doc_id, n_scores, confidence): the mean over the elements' confidences and those of their numbers (``number_confidence``, null without a number)."""
    scores = found.select("doc_id", F.explode(F.filter(F.array("confidence", "number_confidence"), lambda x: x.isNotNull())).alias("score"))
    return scores.groupBy("doc_id").agg(F.count("*").alias("n_scores"), F.round(F.avg("score"), 6).alias("confidence"))


def numbering_sequence_issues(found: DataFrame, last_part: bool = False) -> DataFrame:
    """(doc_id, n_gaps, n_duplicates, n_issues) of the numbers (doc_id, line_number, value, parts) of each document.

    Numbers of one part are one sequence; longer ones a sequence for each parent, the number without the last part, if it stands in the document. Numbers without it are orphans, an issue for each length. Of a sequence the first parts are compared (or the last ones): a value again is a duplicate, a step over one a gap.
    """
    n = F.size("parts")
    rows = found.filter(n > 0).select("doc_id", "line_number", "parts", (n - 1).alias("level"), F.slice("parts", F.lit(1), n - 1).alias("head"), F.get("parts", n - 1 if last_part else F.lit(0)).alias("v"))
    known = rows.select("doc_id", F.col("parts").alias("head"), F.lit(True).alias("there")).distinct()
    rows = rows.join(known, ["doc_id", "head"], "left")
    orphan = (F.col("level") > 0) & F.col("there").isNull()
    issues = rows.filter(orphan).groupBy("doc_id").agg(F.count_distinct("level").alias("n_issues"))
    step = F.col("v") - F.lag("v").over(Window.partitionBy("doc_id", "level", "head").orderBy("v", "line_number"))
    steps = rows.filter(~orphan).withColumn("step", step).groupBy("doc_id").agg(F.count_if(F.col("step") > 1).alias("n_gaps"), F.count_if(F.col("step") == 0).alias("n_duplicates"))
    out = rows.select("doc_id").distinct().join(steps, "doc_id", "left").join(issues, "doc_id", "left")
    return out.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_gaps", "n_duplicates", "n_issues")])


def numbering_advice(found: DataFrame) -> DataFrame:
    """(doc_id, n_numbers, n_types, depth, top_share, n_gaps, n_duplicates, n_issues, advice) of each document with numbers (doc_id, line_number, numbering_type, value, parts): advice as a list of sentences."""
    rows = found.filter("value IS NOT NULL").withColumn("at", numbering.level(F.col("parts")))
    facts = rows.groupBy("doc_id").agg(F.count("*").alias("n_numbers"), F.count_distinct("numbering_type").alias("n_types"), (F.max("at") + 1).cast("long").alias("depth"), F.count_distinct("at").alias("n_levels"), F.round(F.avg((F.col("at") == 0).cast("double")), 6).alias("top_share"))
    both = facts.join(numbering_sequence_issues(rows), "doc_id", "left").na.fill(0, ["n_gaps", "n_duplicates", "n_issues"])
    mixed = F.col("n_types") > MOST_TYPES
    broken = (F.col("n_gaps") > 0) | (F.col("n_duplicates") > 0) | (F.col("n_issues") > 0) | mixed
    found_n = lambda c, what: F.when(F.col(c) > 0, F.concat(F.lit("Found "), F.col(c).cast("string"), F.lit(f" {what}")))
    advice = F.array(
        F.when(broken, "Numbering sequence validation failed"),
        found_n("n_gaps", "gaps in numbering"),
        found_n("n_duplicates", "duplicate numbers"),
        found_n("n_issues", "structural issues"),
        F.when(F.col("depth") > DEEPEST, F.concat(F.lit("Deep hierarchy detected ("), F.col("depth").cast("string"), F.lit(" levels) - consider restructuring"))),
        F.when(mixed, "Multiple numbering types detected - ensure consistency"),
        F.when((F.col("n_levels") > 1) & (F.col("top_share") < LEAST_TOP), "Consider adding more top-level sections"),
    )
    given = F.filter(advice, lambda x: x.isNotNull())
    whole = F.when(F.size(given) > 0, given).otherwise(F.array(F.lit("Numbering structure appears well-organized")))
    return both.select("doc_id", "n_numbers", "n_types", "depth", "top_share", "n_gaps", "n_duplicates", "n_issues", whole.alias("advice"))


def numbering_distribution(found: DataFrame) -> DataFrame:
    """(doc_id, numbering_type, level, n): how often each numbering system stands at each level of a document."""
    return found.filter("value IS NOT NULL").groupBy("doc_id", "numbering_type", numbering.level(F.col("parts")).cast("long").alias("level")).agg(F.count("*").alias("n"))


def interleaved(first: DataFrame, second: DataFrame) -> DataFrame:
    """(tree, line, level, origin): the elements of two tables of trees together, in line order behind one another; build the tree from them anew. Of equal lines the first table's comes first."""
    rows = first.select("tree", "line", "level", F.lit(0).alias("origin")).unionByName(second.select("tree", "line", "level", F.lit(1).alias("origin")))
    order = Window.partitionBy("tree").orderBy("line", "origin", "level")
    return rows.withColumn("place", (F.row_number().over(order) - 1).cast("long"))


def _runs(least: int, target: int, most: int):
    """An Arrow function: first chunk and number of chunks of every run of a list of token counts."""

    def places(counts: pd.Series) -> pd.Series:
        def one(own) -> list[tuple[int, int]]:
            out, start, total = [], 0, 0
            for i, n in enumerate(map(int, own)):
                if n >= least:
                    if start < i:
                        out.append((start, i - start))
                    out.append((i, 1))
                    start, total = i + 1, 0
                    continue
                total += n
                if total >= target:
                    out.append((start, i + 1 - start))
                    start, total = i + 1, 0
            return out + ([(start, len(own) - start)] if start < len(own) else [])

        return pd.Series([one(own) for own in counts])

    return F.pandas_udf(places, "array<struct<start:int,n:int>>")


def optimised_sizes(pieces: DataFrame, least: int, target: int, most: int, ends: str = WHITE) -> DataFrame:
    """(doc_id, chunk_index, content, n_merged, tokens) of chunks (doc_id, chunk_index, content): small ones (under ``least`` tokens) joined by blank lines until they reach ``target`` or one of fitting size comes; ones over ``most`` cut into equal parts.

    Joined ones lose ``ends`` at their ends, and what is made of them alone goes. No other text is dropped, also where joined ones exceed ``most``. Only token counts leave the JVM.
    """
    ordered = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("x")).select("doc_id", F.col("x.content").alias("texts"))
    counted = ordered.withColumn("counts", F.transform("texts", lambda t: tk.char_tokens(t)))
    runs = counted.withColumn("runs", _runs(least, target, most)("counts")).select("doc_id", "texts", F.posexplode("runs").alias("pos", "at"))
    own = F.slice("texts", F.col("at.start") + 1, F.col("at.n"))
    joined = F.when(F.col("at.n") == 1, F.get("texts", F.col("at.start"))).otherwise(F.array_join(F.filter(F.transform(own, lambda t: F.btrim(t, F.lit(ends))), lambda t: t != ""), "\n\n"))
    rows = runs.select("doc_id", "pos", F.col("at.n").cast("long").alias("n_merged"), joined.alias("content")).filter(F.btrim(F.col("content"), F.lit(ends)) != "")
    parts = F.when(F.col("n_merged") == 1, F.greatest(F.lit(1), F.ceil(tk.char_tokens(F.col("content")) / most))).otherwise(1).cast("int")
    width = F.ceil(F.length("content") / parts).cast("int")
    cut = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.substring("content", i * width + 1, width))
    out = rows.select("doc_id", "pos", "n_merged", F.posexplode(cut).alias("part", "content"))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "part")) - 1
    return out.select("doc_id", index.cast("long").alias("chunk_index"), "content", "n_merged", tk.char_tokens(F.col("content")).alias("tokens"))
