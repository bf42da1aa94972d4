"""Headings of several lines and splitting by a text's own separators."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.operators import chunks, multiline, separators, structure


def plain_headings(text):
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        line = lines[i].strip()
        if not (0 < len(line) < 50 and (line.istitle() or line.isupper())):
            i += 1
            continue
        j, own = i, []
        while j < len(lines) and lines[j].strip() and len(lines[j].strip()) <= 80 and j - i < 3:
            own.append(lines[j].strip())
            j += 1
        if len(own) > 1 and len(" ".join(own)) <= 200:
            sure = 0.4 + (0.2 if all(x.istitle() for x in own) else 0.3 if all(x.isupper() for x in own) else 0) + (0.1 if j < len(lines) and not lines[j].strip() else 0)
            start = sum(len(x) + 1 for x in lines[:i])
            out.append((i + 1, len(own), start, sum(len(x) + 1 for x in lines[:j]) - 1, " ".join(own), round(min(sure, 0.8), 1)))
        i = j
    return out


def test_multiline_headings(spark):
    rnd = random.Random(4)
    pool = ["GENERAL TERMS", "Of The Parties", "some plain words", "", "  ", "x" * 81, "T" * 49, "U" * 50, "V" * 80, "Über Alles", "3 Blind Mice", "　WIDE \t", "McDonald", "漢字", "12.5", "A", "ÀÉ\x85"]
    texts = ["\n".join(rnd.choices(pool, k=rnd.randrange(1, 30))) for _ in range(300)] + ["", "TITLE", "ONE\nTWO", "A\n" * 5000, "\n\n"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(-1, None, 2), (2, texts[2], 3)], "doc_id long, text string, title int")
    got = sorted(tuple(r) for r in multiline.multiline_headings(docs).collect())
    want = sorted((i, *h) for i, t in [*enumerate(texts), (2, texts[2])] for h in plain_headings(t))
    assert got == want and len(want) > 2000
    assert multiline.multiline_headings(docs.limit(0)).count() == 0


def plain_separators(elements):
    """Separators of (type, value, system, level) elements, from the rules."""
    tiers = set()
    for kind, value, system, level in elements:
        own = [f"\n\n{lead}{value}" for lead in separators.NUMBER_LEADS.get(kind, ())] if value else []
        if kind == "section" and value and system == "section_symbol" and not value.startswith("§"):
            own += [f"\n\n§ {value}", f"\n\n§{value}"]
        if kind == "subsection" and value and not value.startswith("("):
            own.append(f"\n\n({value})")
        tiers |= {(level, -len(s), s) for s in own + [f"\n\n{lead}" for lead in separators.KIND_LEADS.get(kind, ())]}
    out = [s for _, _, s in sorted(tiers)]
    for system in sorted({s for _, v, s, _ in elements if v}):
        out += [f"\n\n{x}" for x in separators.NUMBERING_LEADS.get(system, ())] + list(separators.INLINE_LEADS.get(system, ()))
    return list(dict.fromkeys(out + list(separators.LEGAL_SEPARATORS)))


ELEMENTS = {
    1: [("chapter", "IV", "roman_upper", 0), ("section", "1.2", "decimal", 1), ("section", "1.2", "decimal", 1), ("subsection", "a", "letter_lower", 2), ("subsection", "(b)", "letter_lower", 2), ("heading", None, None, 1)],
    2: [("section", "12", "section_symbol", 1), ("section", "§ 3", "section_symbol", 1), ("clause", "9", "decimal", 3), ("paragraph", "i", "roman_lower", 3), ("article", "X", "letter_upper", 0)],
    3: [("list_item", "a", "letter_lower", 3)],
    4: [("list_item", "a", "letter_lower", 3), ("article", "", "mixed", 0)],
}


def test_separators(spark):
    rows = [(i, *e) for i, own in ELEMENTS.items() for e in own]
    found = spark.createDataFrame(rows, "doc_id long, element_type string, value string, numbering_type string, level long")
    got = {r.doc_id: r.separators for r in separators.separator_lists(found).collect()}
    assert got == {i: plain_separators(own) for i, own in ELEMENTS.items() if i != 3}  # 3 has no separators of its own
    ranked = separators.ranked_separators(found.filter("doc_id = 2")).orderBy("place").collect()
    assert [r.tier for r in ranked] == sorted(r.tier for r in ranked) and {r.level for r in ranked if r.tier} == {None}


def plain_split(text, seps, size):
    """The textbook recursion: the first separator that occurs, then those behind it."""
    used = next((i for i, s in enumerate(seps) if s == "" or s in text), len(seps) - 1)
    mark = seps[used]
    pieces = [p for p in (re.split(f"(?={re.escape(mark)})", text) if mark else list(text)) if p]
    out = []
    for p in pieces:
        out += [p] if len(p) <= size or used + 1 == len(seps) else plain_split(p, seps[used + 1 :], size)
    return out


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(["\n\nSection 1.", "\n\nSection 1.1", "\n\n", "\n", "§ ", "§", "\n\n§ 4", "\n\nARTICLE I", "\n\nARTICLE ", "word ", "long words, and more; so. ", "x" * 30, "\n\n("]), max_size=25), st.integers(1, 60))
def test_split_is_the_textbook_recursion(parts, size):
    seps = ["\n\nARTICLE I", "\n\nARTICLE ", "\n\nSection 1.1", "\n\nSection 1.", "\n\nSection ", "\n\n§ 4", "\n\n§ ", "\n\n§", "§ ", *[s for s in separators.LEGAL_SEPARATORS if s not in ("\n\nARTICLE ", "\n\n§ ")]]
    text = "".join(parts)
    if text:
        assert list(separators._split(text, seps, size)) == (plain_split(text, seps, size) if len(text) > size else [text])


def test_dynamic_chunks(spark):
    texts = {1: "PREAMBLE\n\nARTICLE I\n\nSection 1.1 First\n\n" + "words and words. " * 30 + "\n\nSection 1.2 Second\n\n(a) an item\n\n" + "more words; " * 40, 2: "no structure at all, " * 100, 3: None, 4: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = separators.split_dynamic(docs, structure.elements(docs), 300, 50).orderBy("doc_id", "chunk_index").collect()
    own = {}
    for r in out:
        own.setdefault(r.doc_id, []).append(r.content)
    found = [(r.element_type, r.value, r.numbering_type, r.level) for r in structure.elements(docs.filter("doc_id = 1")).collect()]
    for i, seps in ((1, plain_separators(found)), (2, list(separators.LEGAL_SEPARATORS))):
        assert own[i] == [c.strip() for c in chunks._merge(iter(plain_split(texts[i], seps, 300)), 300, 50) if c.strip()]
    assert set(own) == {1, 2} and all(len(c) <= 300 for c in own[1] + own[2])


def test_many_separators_stay_fast(spark):
    n = 4000
    text = "".join(f"\n\nSection {i}.{i % 7} " + "words " * 20 for i in range(n))
    seps = [f"\n\nSection {i}.{i % 7}" for i in range(n)] + list(separators.LEGAL_SEPARATORS)
    pieces = list(separators._split(text, seps, 200))
    assert "".join(pieces) == text and len(pieces) == n


def test_cut_at_elements(spark):
    pieces = spark.createDataFrame([(1, 0, 0, "aaaa bbbb cccc"), (1, 1, 10, "cccc dddd"), (2, 0, 0, "eeee")], "doc_id long, chunk_index long, start_char long, content string")
    found = spark.createDataFrame([(1, 0, "section", 1), (1, 5, "clause", 2), (1, 10, "article", 0), (1, 12, "clause", 3), (1, 15, "list_item", 1), (1, 15, "section", 9)], "doc_id long, start_char long, element_type string, level int")
    got = sorted(tuple(r) for r in separators.cut_at_elements(pieces, found).collect())
    assert got == [(1, 0, 0, 0, "aaaa"), (1, 0, 1, 5, "bbbb"), (1, 0, 2, 10, "cccc"), (1, 1, 0, 10, "cccc"), (1, 1, 1, 15, "dddd"), (2, 0, 0, 0, "eeee")]
