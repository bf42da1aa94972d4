"""Document structure: pattern counts, heading candidates and elements, a line at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import numbering

_NUMBER = r"\d+(?:\.\d+)*"
_ROMAN = r"(?:[IVXLCDM]+|\d+(?:\.\d+)*)"
_TITLE = r"\s*[:\-–—]\s*[^\n\r]*"

#: Patterns by category and name; what a category's words have in common is written once above. Lines start and end at \n only; letter case does not count but in all_caps.
PATTERNS: dict[str, dict[str, str]] = {
    "section_symbols": {
        "basic_section": rf"§\s*{_NUMBER}",
        "section_with_text": rf"§\s*{_NUMBER}\s*[^\n\r]*",
        "section_range": rf"§§\s*{_NUMBER}\s*-\s*{_NUMBER}",
        "section_list": rf"§\s*{_NUMBER}(?:\s*,\s*{_NUMBER})*",
    },
    "articles": {
        "article_basic": rf"\barticle\s+{_ROMAN}\b",
        "article_with_title": rf"\barticle\s+{_ROMAN}{_TITLE}",
        "article_standalone": rf"^\s*article\s+{_ROMAN}\s*$",
        "article_period": rf"\barticle\s+{_ROMAN}\.\s*[^\n\r]*",
    },
    "sections": {
        "section_basic": rf"\bsection\s+{_NUMBER}\b",
        "section_with_title": rf"\bsection\s+{_NUMBER}{_TITLE}",
        "section_space_title": rf"\bsection\s+{_NUMBER}\s+[^\n\r]+",
        "section_period": rf"\bsection\s+{_NUMBER}\.\s*[^\n\r]*",
        "section_parentheses": rf"\(section\s+{_NUMBER}\)",
    },
    "chapters": {
        "chapter_basic": rf"\bchapter\s+{_ROMAN}\b",
        "chapter_with_title": rf"\bchapter\s+{_ROMAN}{_TITLE}",
        "chapter_period": rf"\bchapter\s+{_ROMAN}\.\s*[^\n\r]*",
    },
    "subsections": {
        "subsection_basic": rf"\bsubsection\s+{_NUMBER}\b",
        "subsection_with_title": rf"\bsubsection\s+{_NUMBER}{_TITLE}",
        "subsection_parentheses": rf"\(subsection\s+{_NUMBER}\)",
    },
    "decimal_numbering": {
        "standalone_decimal": rf"^\s*{_NUMBER}\s*$",
        "decimal_with_text": rf"^\s*{_NUMBER}\s+[^\n\r]+",
        "decimal_period": rf"^\s*{_NUMBER}\.\s*[^\n\r]*",
        "decimal_parentheses": rf"^\s*{_NUMBER}\)\s*[^\n\r]*",
        "decimal_bracket": rf"^\s*\({_NUMBER}\)\s*[^\n\r]*",
    },
    "roman_numerals": {
        "roman_upper": r"^\s*[IVXLCDM]+\s*\.?\s*[^\n\r]*",
        "roman_lower": r"^\s*[ivxlcdm]+\s*\.?\s*[^\n\r]*",
        "roman_parentheses": r"^\s*\([IVXLCDM]+\)\s*[^\n\r]*",
    },
    "letter_numbering": {
        "letter_upper": r"^\s*[A-Z]\s*\.?\s*[^\n\r]*",
        "letter_lower": r"^\s*[a-z]\s*\.?\s*[^\n\r]*",
        "letter_parentheses": r"^\s*\([A-Z]\)\s*[^\n\r]*",
    },
    "clauses": {
        "clause_basic": rf"\bclause\s+{_NUMBER}\b",
        "clause_with_title": rf"\bclause\s+{_NUMBER}{_TITLE}",
        "paragraph_basic": rf"\bparagraph\s+{_NUMBER}\b",
        "paragraph_with_title": rf"\bparagraph\s+{_NUMBER}{_TITLE}",
    },
    "list_items": {
        "bullet_dash": r"^\s*[-–—]\s*[^\n\r]+",
        "bullet_asterisk": r"^\s*\*\s*[^\n\r]+",
        "bullet_dot": r"^\s*•\s*[^\n\r]+",
        "numbered_list": r"^\s*\d+\.\s*[^\n\r]+",
        "lettered_list": r"^\s*[A-Z]\.\s*[^\n\r]+",
    },
    "headings": {
        "all_caps": r"^\s*[A-Z][A-Z\s]{2,}[A-Z]\s*$",
        "title_case": r"^\s*[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s*$",
        "underlined": r"^[^\n\r]+\n[-=_]{3,}",
        "numbered_heading": rf"^\s*{_NUMBER}\s+[A-Z][^\n\r]*",
        "centered": r"^\s{10,}[^\n\r]+\s{10,}$",
    },
    "legal_terms": {
        "whereas": r"\bwhereas\b",
        "therefore": r"\btherefore\b",
        "provided_that": r"\bprovided\s+that\b",
        "subject_to": r"\bsubject\s+to\b",
        "notwithstanding": r"\bnotwithstanding\b",
        "in_accordance_with": r"\bin\s+accordance\s+with\b",
    },
    "cross_references": {
        "see_section": rf"\bsee\s+section\s+{_NUMBER}",
        "see_article": rf"\bsee\s+article\s+{_ROMAN}",
        "pursuant_to": rf"\bpursuant\s+to\s+section\s+{_NUMBER}",
        "in_section": rf"\bin\s+section\s+{_NUMBER}",
        "under_section": rf"\bunder\s+section\s+{_NUMBER}",
    },
    "formatting": {
        "double_newline": r"\n\s*\n",
        "indentation": r"^\s{4,}[^\n\r]+",
        "tab_indented": r"^\t+[^\n\r]+",
        "line_breaks": r"\n+",
        "whitespace_only": r"^\s*$",
    },
}
#: A text that lacks this, in any case, has no match of the category or pattern.
NEEDED = {
    "section_symbols": "§", "articles": "article", "sections": "section", "chapters": "chapter", "subsections": "subsection", "clause_basic": "clause", "clause_with_title": "clause", "paragraph_basic": "paragraph", "paragraph_with_title": "paragraph",
    "bullet_asterisk": "*", "bullet_dot": "•", "whereas": "whereas", "therefore": "therefore", "provided_that": "provided", "subject_to": "subject", "notwithstanding": "notwithstanding", "in_accordance_with": "accordance",
    "see_section": "section", "see_article": "article", "pursuant_to": "pursuant", "in_section": "section", "under_section": "under", "tab_indented": "\t",
}
_COUNT = pa.schema([("category", pa.string()), ("pattern", pa.string()), ("n_docs", pa.int64()), ("n_matches", pa.int64())])
#: Room of the matches that a worker holds, and of one without its text.
BATCH_BYTES, ROW_BYTES = 4 << 20, 200


def pattern_flags(name: str) -> str:
    """Inline flags of a pattern, without the one for line ends."""
    return "(?m)" if name == "all_caps" else "(?im)"


def pattern_supported(category: str, name: str | None = None) -> bool:
    return category in PATTERNS and (name is None or name in PATTERNS[category])


def legal_view(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every text laid out as a contract: an article and section headings numbered from the key, the text's lines below them."""
    n = F.col(key)
    head = F.concat(F.lit("ARTICLE "), numbering.int_to_roman(n % 20 + 1), F.lit("\n\nSection "), (n % 9 + 1).cast("string"), F.lit("."), (n % 4 + 1).cast("string"), F.lit(" General Terms\n\n"))
    body = F.concat(F.lit("(a) "), F.substring_index("text", "\n", 1), F.lit("\n\nPursuant to Section "), (n % 9 + 1).cast("string"), F.lit(", subject to § "), (n % 7 + 1).cast("string"), F.lit(".2\n\n"))
    return docs.withColumn("text", F.concat(head, body, F.coalesce("text", F.lit(""))))


def _counted(name: str, pattern: str) -> str:
    """The pattern for counts by Arrow, which takes what is left behind a match for a text of its own: a match goes on to the end of its line or word, where no other could begin, so a line or word begins there only if one does in the text."""
    if name == "centered":
        pattern = pattern.replace(r"\s{10,}$", r"\s{9,}(?:[^\S\n]$\n?|\n$)")
    elif pattern.startswith("^") and not pattern.endswith("$"):
        pattern += r"[^\n]*\n?"
    elif name in PATTERNS["cross_references"]:
        pattern += r"\w*"
    return pattern_flags(name) + pattern


def _blank_runs(texts: pa.Array) -> pa.Array:
    """Matches of whitespace_only: runs of blank lines, and once more those of several lines that end in an empty one."""
    end, nothing = pa.scalar("\n", texts.type), pa.scalar("", texts.type)
    padded = pc.binary_join_element_wise(end, texts, end, nothing)
    return pc.add(pc.count_substring_regex(padded, r"\n\s*\n"), pc.count_substring_regex(padded, r"\n\s*\n\n(?:[^\S\n]*\S|\z)"))


def counted_matches(batches: Iterator[pa.RecordBatch], wanted: dict[str, dict[str, str]]) -> Iterator[pa.RecordBatch]:
    """(category, pattern, n_docs, n_matches) of each batch of texts; a pattern is tried only on texts that hold what it needs."""
    for batch in batches:
        texts, rows, last, some = batch["text"], [], None, None
        for c, names in wanted.items():
            for n, p in names.items():
                needed = NEEDED.get(n, NEEDED.get(c))
                if needed and needed != last:  # one copy of texts at a time
                    last, some = needed, texts.filter(pc.match_substring(texts, needed, ignore_case=True))
                found = _blank_runs(texts) if n == "whitespace_only" else pc.count_substring_regex(some if needed else texts, _counted(n, p))
                rows.append((c, n, pc.sum(pc.greater(found, 0)).as_py() or 0, pc.sum(found).as_py() or 0))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _COUNT, strict=True)], schema=_COUNT)


def pattern_counts(docs: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """(category, pattern, n_docs, n_matches) over a table of texts, in one scan; of some categories or all. One row a pattern and batch of texts is exchanged."""
    wanted = {c: PATTERNS[c] for c in (categories or PATTERNS)}
    rows = docs.select("text").mapInArrow(lambda batches: counted_matches(batches, wanted), "category string, pattern string, n_docs long, n_matches long")
    return rows.groupBy("category", "pattern").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_matches").alias("n_matches"))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_number, line, start_char, before, after): lines with their place and neighbours."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    starts = F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return parts.select("doc_id", (F.col("pos") + 1).cast("long").alias("line_number"), "line", F.coalesce(starts, F.lit(0)).cast("long").alias("start_char"), F.lag("line").over(order).alias("before"), F.lead("line").over(order).alias("after"))


def is_upper(text: Column) -> Column:
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}")


def is_title(text: Column) -> Column:
    """A capital after whatever isn't a letter, small letters after letters, and a capital at all."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{L}\p{Lu}") & ~text.rlike(r"(^|\P{L})\p{Ll}")


def format_headings(docs: DataFrame, longest: int = 200) -> DataFrame:
    """Lines that look like headings: (doc_id, line_number, title, is_caps, is_title_case, is_centered, is_underlined, is_standalone, confidence).

    A base of 0.2, 0.3 for capitals or an underline, 0.2 for title case or centring, 0.1 for blank neighbours; at most 0.9. A line needs one of the first four.
    """
    bare = F.trim("line")
    lead, trail = F.length("line") - F.length(F.ltrim("line")), F.length("line") - F.length(F.rtrim("line"))
    under = F.trim(F.coalesce("after", F.lit("")))
    rows = lines(docs).select(
        "doc_id", "line_number", bare.alias("title"),
        is_upper(bare).alias("is_caps"), is_title(bare).alias("is_title_case"), ((lead > 4) & (F.abs(lead - trail) <= 2)).alias("is_centered"),
        (under.rlike(r"^(-+|=+|_+|~+|\*+)$") & (F.abs(F.length(under) - F.length(bare)) <= 2)).alias("is_underlined"),
        ((F.trim(F.coalesce("before", F.lit(""))) == "") & (under == "")).alias("is_standalone"),
    )
    score = F.lit(0.2)
    for name, weight in (("is_caps", 0.3), ("is_title_case", 0.2), ("is_centered", 0.2), ("is_underlined", 0.3), ("is_standalone", 0.1)):
        score = score + F.when(F.col(name), weight).otherwise(0.0)
    some = F.col("is_caps") | F.col("is_title_case") | F.col("is_centered") | F.col("is_underlined")
    return rows.filter(some & F.length("title").between(1, longest)).withColumn("confidence", F.round(F.least(F.lit(0.9), score), 4))


def elements(docs: DataFrame) -> DataFrame:
    """Structural elements of contracts: (doc_id, line_number, start_char, element_type, numbering_type, value, parts, level, title, confidence).

    A line is an element if it opens with article, chapter, section, a section sign, or a bracketed number or letter. Confidence is 0.8 for a keyword, 0.5 else, plus 0.2 for decimals; 0.1 more for a line under ten characters, 0.2 less over a hundred; at most 1.
    """
    bare = F.trim("line")
    kind = (
        F.when(bare.rlike(r"(?i)^article\s+([IVXLCDM]+|\d+)\b"), "article").when(bare.rlike(r"(?i)^chapter\s+([IVXLCDM]+|\d+)\b"), "chapter")
        .when(bare.rlike(r"(?i)^section\s+\d+(\.\d+)*\b"), "section").when(bare.rlike(r"^§\s*\d+"), "section").when(bare.rlike(r"^\([A-Za-z0-9]+\)"), "list_item")
    )
    value = F.coalesce(
        *[F.nullif(F.regexp_extract(bare, p, 1), F.lit("")) for p in (r"(?i)^(?:article|chapter)\s+([IVXLCDM]+|\d+)\b", r"(?i)^section\s+(\d+(?:\.\d+)*)", r"^§\s*(\d+(?:\.\d+)*)", r"^\(([A-Za-z0-9]+)\)")]
    )
    rows = lines(docs).select("doc_id", "line_number", "start_char", bare.alias("title"), kind.alias("element_type"), value.alias("value")).filter(F.col("element_type").isNotNull())
    system = numbering.kind_of(F.col("value"))
    rows = rows.withColumn("numbering_type", system).withColumn("parts", numbering.normalise(F.col("numbering_type"), F.col("value")))
    score = F.when(F.col("element_type") == "list_item", 0.5).otherwise(0.8) + F.when(F.col("numbering_type") == "decimal", 0.2).otherwise(0.0)
    score = score + F.when(F.length("title") < 10, 0.1).when(F.length("title") > 100, -0.2).otherwise(0.0)
    depth = F.when(F.col("element_type").isin("article", "chapter"), 0).when(F.col("element_type") == "section", F.size("parts")).otherwise(3)
    return rows.withColumns({"level": depth.cast("long"), "confidence": F.round(F.least(F.lit(1.0), score), 4)})


def with_parents(found: DataFrame) -> DataFrame:
    """Elements with the line of the nearest element above them of a lower level.

    A running last line for each level gives it without a join of elements with elements.
    """
    order = Window.partitionBy("doc_id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.col("line_number"))).over(order) for k in range(8)]
    rows = found.withColumn("__last", F.array(*last))
    above = F.array_max(F.filter(F.transform("__last", lambda x, i: F.when(i < F.col("level"), x)), lambda x: x.isNotNull()))
    return rows.withColumn("parent_line", above).drop("__last")


def sequence_gaps(found: DataFrame) -> DataFrame:
    """(doc_id, element_type, n_numbers, n_duplicates, n_gaps) of first numbers in line order of value."""
    order = Window.partitionBy("doc_id", "element_type").orderBy("first")
    rows = found.filter(F.size("parts") > 0).select("doc_id", "element_type", F.get("parts", F.lit(0)).alias("first"))
    step = rows.withColumn("step", F.col("first") - F.lag("first").over(order))
    return step.groupBy("doc_id", "element_type").agg(F.count("*").alias("n_numbers"), F.count_if(F.col("step") == 0).alias("n_duplicates"), F.count_if(F.col("step") > 1).alias("n_gaps"))


def headings(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """(doc_id, line_number, title, origin, confidence): one heading a line, from structure or format, the surer of the two; those under ``least`` go."""
    both = elements(docs).select("doc_id", "line_number", "title", F.lit("structure").alias("origin"), "confidence").unionByName(
        format_headings(docs).select("doc_id", "line_number", "title", F.lit("format").alias("origin"), "confidence")
    )
    best = both.filter(F.col("confidence") >= least).groupBy("doc_id", "line_number")
    return best.agg(F.max_by(F.struct("title", "origin", "confidence"), F.struct("confidence", "origin")).alias("x")).select("doc_id", "line_number", "x.*")


def numbering_statistics(found: DataFrame) -> DataFrame:
    """(doc_id, n_numbers, depth, avg_level, n_types, main_type): of a document's numbered elements; the most frequent type, the first in the alphabet among equals."""
    counts = found.groupBy("doc_id", "numbering_type").agg(F.count("*").alias("n"), F.max("level").alias("deepest"), F.sum("level").alias("levels"))
    return counts.groupBy("doc_id").agg(
        F.sum("n").alias("n_numbers"), (F.max("deepest") + 1).alias("depth"), F.round(F.sum("levels") / F.sum("n"), 6).alias("avg_level"), F.count("*").alias("n_types"),
        F.min_by("numbering_type", F.struct(-F.col("n"), "numbering_type")).alias("main_type"),
    )


def coverage(counts: DataFrame) -> DataFrame:
    """(category, n_patterns, n_used, n_matches) of :func:`pattern_counts`."""
    return counts.groupBy("category").agg(F.count("*").alias("n_patterns"), F.count_if(F.col("n_matches") > 0).alias("n_used"), F.sum("n_matches").alias("n_matches"))


_MATCH = pa.schema([("doc_id", pa.int64()), ("category", pa.string()), ("pattern", pa.string()), ("start_char", pa.int64()), ("match", pa.string())])


def found_matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, category, pattern, start_char, match) of all patterns in batches of texts. A text at a time; matches leave as soon as they are many or long, so memory follows neither a batch nor a partition."""
    compiled = [(c, n, re.compile(p, re.M if n == "all_caps" else re.I | re.M)) for c, names in PATTERNS.items() for n, p in names.items()]
    rows, room = [], 0
    for batch in batches:
        for key, value in zip(batch["doc_id"], batch["text"], strict=True):
            text = value.as_py() or ""
            for c, n, p in compiled if text else ():
                for m in p.finditer(text):
                    rows.append((key.as_py(), c, n, m.start(), m.group()))
                    room += ROW_BYTES + len(m.group())
                    if room >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _MATCH, strict=True)], schema=_MATCH)
                        rows, room = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _MATCH, strict=True)], schema=_MATCH)


def pattern_positions(docs: DataFrame) -> DataFrame:
    """(doc_id, category, pattern, start_char, match): every match of every pattern with its place, of overlapping ones of a category the longest from the left."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(found_matches, "doc_id long, category string, pattern string, start_char long, match string")
    # Left to right, a match stays if it starts behind all that began before it, the longest first among those that start together.
    order = Window.partitionBy("doc_id", "category").orderBy("start_char", F.desc(F.length("match")), "pattern")
    before = F.max(F.col("start_char") + F.length("match")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("__before", before).filter(F.col("__before").isNull() | (F.col("start_char") >= F.col("__before"))).drop("__before")
