"""Splitting a text at separators of its own, made from the structure found in it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import strip
from docloom.operators import chunks, spans

#: Separators of legal texts, coarse to fine.
LEGAL_SEPARATORS = ("\n\nCHAPTER ", "\n\nTITLE ", "\n\nPART ", "\n\nARTICLE ", "\n\nSECTION ", "\n\nSec. ", "\n\n§ ", "\n\n(", "\n\n(i)", "\n\n(A)", "\n\n", "\n", ". ", "; ", ", ", " ", "")
#: What stands before a number, by kind of element; an empty one is the bare number.
NUMBER_LEADS = {
    "chapter": ("CHAPTER ", "Chapter ", ""),
    "article": ("ARTICLE ", "Article ", ""),
    "section": ("SECTION ", "Section ", "Sec. ", ""),
    "subsection": ("Subsection ", ""),
    "clause": ("Clause ", ""),
    "paragraph": ("Paragraph ", ""),
}
#: What begins an element of a kind, whatever its number.
KIND_LEADS = {
    "chapter": ("CHAPTER ", "Chapter "),
    "article": ("ARTICLE ", "Article "),
    "section": ("SECTION ", "Section ", "Sec. ", "§ "),
    "subsection": ("Subsection ", "("),
    "clause": ("Clause ",),
    "paragraph": ("Paragraph ",),
    "heading": ("",),
}
#: What begins a line in each numbering system, behind a blank line.
NUMBERING_LEADS = {
    "decimal": ("1.", "2.", "3.", "1.1", "1.2", "2.1"),
    "roman_upper": ("I.", "II.", "III.", "IV.", "V.", "I ", "II ", "III "),
    "roman_lower": ("i.", "ii.", "iii.", "iv.", "v.", "i ", "ii ", "iii "),
    "letter_upper": ("A.", "B.", "C.", "D.", "A ", "B ", "C ", "(A)", "(B)", "(C)"),
    "letter_lower": ("a.", "b.", "c.", "d.", "a ", "b ", "c ", "(a)", "(b)", "(c)"),
    "section_symbol": ("§ ", "§"),
}
#: A section sign also separates within a line.
INLINE_LEADS = {"section_symbol": ("§ ",)}
BLANK = "\n\n"


def element_separators(kind: Column, number: Column, system: Column) -> Column:
    """The separators that one element gives: its kind's words with its number, its number alone, and its kind's words."""
    number = F.trim(number)
    named = F.lit(None).cast("array<string>")
    for name, leads in NUMBER_LEADS.items():
        own = F.array(*[F.concat(F.lit(BLANK + lead), number) for lead in leads])
        if name == "section":
            sign = F.array(F.concat(F.lit(f"{BLANK}§ "), number), F.concat(F.lit(f"{BLANK}§"), number))
            own = F.when((system == "section_symbol") & ~number.startswith("§"), F.concat(own, sign)).otherwise(own)
        if name == "subsection":
            own = F.when(number.startswith("("), own).otherwise(F.concat(own, F.array(F.concat(F.lit(f"{BLANK}("), number, F.lit(")")))))
        named = F.when(kind == name, own).otherwise(named)
    general = F.lit(None).cast("array<string>")
    for name, leads in KIND_LEADS.items():
        general = F.when(kind == name, F.array(*[F.lit(BLANK + lead) for lead in leads])).otherwise(general)
    none = F.array().cast("array<string>")
    return F.concat(F.when(number != "", F.coalesce(named, none)).otherwise(none), F.coalesce(general, none))


def ranked_separators(found: DataFrame) -> DataFrame:
    """(doc_id, tier, level, place, separator): every document's separators in order, each once, from its elements (doc_id, element_type, value, numbering_type, level).

    Tier 0 has those of the elements, by level, longer ones first, then by the alphabet; tier 1 those of the numbering systems that occur, systems in alphabetical order; tier 2 those of legal texts. A separator that occurs in several places keeps the first. ``place`` counts from 0 over the document; level is null but in tier 0.
    """
    own = found.select("doc_id", F.col("level").cast("long").alias("level"), F.explode(element_separators(F.col("element_type"), F.coalesce("value", F.lit("")), F.coalesce("numbering_type", F.lit("")))).alias("separator"))
    key = F.struct("level", (-F.length("separator")).alias("short"), "separator")
    systems = found.filter("value IS NOT NULL").select("doc_id", F.col("numbering_type").alias("system"))
    tiers = own.groupBy("doc_id").agg(F.array_sort(F.collect_set(key)).alias("own"))
    used = systems.groupBy("doc_id").agg(F.array_sort(F.collect_set("system")).alias("systems"))
    rows = tiers.join(used, "doc_id", "left")
    by_system = F.lit(None).cast("array<string>")
    none = F.array().cast("array<string>")

    def leads(x: Column) -> Column:
        out = by_system
        for name, own_leads in NUMBERING_LEADS.items():
            texts = [BLANK + lead for lead in own_leads] + list(INLINE_LEADS.get(name, ()))
            out = F.when(x == name, F.array(*map(F.lit, texts))).otherwise(out)
        return F.coalesce(out, none)

    def entry(tier: int, level: Column, text: Column) -> Column:
        return F.struct(F.lit(tier).alias("tier"), level.cast("long").alias("level"), text.alias("separator"))

    first = F.transform("own", lambda x: entry(0, x["level"], x["separator"]))
    second = F.transform(F.flatten(F.transform(F.coalesce("systems", none), leads)), lambda x: entry(1, F.lit(None), x))
    third = F.array(*[entry(2, F.lit(None), F.lit(x)) for x in LEGAL_SEPARATORS])
    each = rows.select("doc_id", F.posexplode(F.concat(first, second, third)).alias("at", "x")).select("doc_id", "at", "x.*")
    firsts = each.groupBy("doc_id", "separator").agg(F.min(F.struct("at", "tier", "level")).alias("x"))
    listed = firsts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("x.at", "x.tier", "x.level", "separator"))).alias("all"))
    return listed.select("doc_id", F.posexplode("all").alias("place", "x")).select("doc_id", "x.tier", "x.level", F.col("place").cast("long").alias("place"), "x.separator")


def separator_lists(found: DataFrame) -> DataFrame:
    """(doc_id, separators): the lists of :func:`ranked_separators`. Documents without elements have no row."""
    return ranked_separators(found).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "separator"))).alias("x")).select("doc_id", F.col("x.separator").alias("separators"))


def _structural(separator: str) -> bool:
    return (separator.startswith(BLANK) and len(separator) > len(BLANK)) or separator.startswith("§")


def _marks(text: str, ranks: dict[str, int]) -> list[tuple[int, int]]:
    """(place, rank) of every occurrence of the separators, by one look at each blank line and section sign."""
    out: list[tuple[int, int]] = []
    for first in (BLANK, "§"):
        lengths = sorted({len(s) for s in ranks if s.startswith(first)})
        at = text.find(first)
        while at >= 0:
            out += [(at, ranks[text[at : at + n]]) for n in lengths if text[at : at + n] in ranks]
            at = text.find(first, at + 1)
    return sorted(out)


def _split(text: str, separators: list[str], size: int) -> Iterator[str]:
    """Pieces cut at the first separator that occurs, longer ones again at those behind it; a piece begins with its separator."""
    head = next((i for i, s in enumerate(separators) if not _structural(s)), len(separators))
    tail = separators[head:]
    waiting = [(0, len(text), 0, _marks(text, {s: i for i, s in enumerate(separators[:head])}))]
    while waiting:
        start, stop, least, marks = waiting.pop()
        left = [m for m in marks if m[1] >= least]
        if stop - start <= size or not left:
            if stop - start <= size or not tail:
                yield text[start:stop]
            else:
                yield from chunks._recursive(text[start:stop], size, tail)
            continue
        rank = min(r for _, r in left)
        cuts = sorted({start, stop, *(at for at, r in left if r == rank)})
        parts, k = [], 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = []
            while k < len(left) and left[k][0] < b:
                own.append(left[k])
                k += 1
            parts.append((a, b, rank + 1, own))
        waiting += reversed(parts)


def split_dynamic(docs: DataFrame, found: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk_index, content): each text cut at the separators of its own elements (see :func:`ranked_separators`; the legal ones alone without an element), merged up to ``size`` characters, repeating up to ``overlap``.

    Null and empty texts have no chunk. Documents with the same doc_id share their separators.
    """
    lists = separator_lists(found)
    default = F.array(*map(F.lit, LEGAL_SEPARATORS))
    rows = docs.select("doc_id", "text").filter("text <> ''").join(lists, "doc_id", "left").select("doc_id", "text", F.coalesce("separators", default).alias("separators"))

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, text, own in zip(frame["doc_id"], frame["text"], frame["separators"], strict=True):
                merged = (c.strip() for c in chunks._merge(_split(text, list(own), size), size, overlap))
                out += [(i, k, c) for k, c in enumerate(filter(None, merged))]
            yield pd.DataFrame(out, columns=["doc_id", "chunk_index", "content"])

    return rows.mapInPandas(split, "doc_id long, chunk_index long, content string")


#: Elements that a chunk never runs across, and those it does not run across down to the second level.
SECTION_KINDS, PART_KINDS, DEEPEST = ("chapter", "article", "section"), ("subsection", "clause", "paragraph"), 2


def cut_at_elements(pieces: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, part, start_char, content): chunks (doc_id, chunk_index, start_char, content) cut where an important element (doc_id, start_char, element_type, level) begins within them; empty parts go, and the others are trimmed.

    Chunks meet the boundaries of their own stretches of the text only, by place, and no text moves for it; (doc_id, chunk_index) names a chunk.
    """
    important = F.col("element_type").isin(*SECTION_KINDS) | (F.col("element_type").isin(*PART_KINDS) & (F.col("level") <= DEEPEST))
    marks = found.filter(important).select("doc_id", F.col("start_char").cast("long").alias("pos")).distinct()
    rows = pieces.select("doc_id", "chunk_index", F.col("start_char").cast("long").alias("start_char"), "content").filter("content <> ''")
    end = F.col("start_char") + F.length("content")
    held = spans.inside(rows.select("doc_id", "chunk_index", "start_char", end.alias("end_char")), marks)
    inner = held.groupBy("doc_id", "chunk_index").agg(F.array_sort(F.collect_set("pos")).alias("inner"))
    rows = rows.join(inner, ["doc_id", "chunk_index"], "left")
    rows = rows.withColumn("cuts", F.concat(F.array("start_char"), F.coalesce("inner", F.array().cast("array<long>")), F.array(end))).drop("inner")
    part = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda i: F.struct(F.get("cuts", i).alias("start_char"), F.substring("content", (F.get("cuts", i) - F.col("start_char") + 1).cast("int"), (F.get("cuts", i + 1) - F.get("cuts", i)).cast("int")).alias("content")))
    out = rows.select("doc_id", "chunk_index", F.posexplode(part).alias("part", "x")).select("doc_id", "chunk_index", F.col("part").cast("long").alias("part"), "x.start_char", "x.content")
    return out.withColumn("content", strip(F.col("content"))).filter("content <> ''")
