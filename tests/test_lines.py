"""Kinds of lines, and trees and chains of any depth."""

import re

from pyspark.sql import functions as F

from docloom.operators import graphs, lines, trees

#: Lines on which loose readings of the rules go wrong.
ODD_LINES = (
    "◦ open bullet", "An abstract of what is to come", "2nd. of May", "The final chapter", "Chapter one was long and told of many things that nobody had asked for.", "chapter small", "ÉTÉ", "ABC", "ABCD", "PART 1", "a. b", "12345) x", "12) x", " • wide space", "+ plus",
    "word " * 30, "SECTION " * 20, "plain words that go on for a while", "exactly twenty chars", "Section.", "- ", "١. arabic digit", "Introduction to it", "", "   ",
)


def plain_kind(line):
    line = line.strip()
    if not line:
        return None
    heading = len(line) <= 100 and not (line.endswith(".") and len(line) > 50) and line[0].isupper() and (any(w in line.lower() for w in lines.HEADING_WORDS) or (line.isupper() and len(line) > 3))
    if heading:
        low = line.lower()
        return "heading", 1 if line.isupper() or any(w in low for w in lines.LEVEL_ONE) else 2 if any(w in low for w in lines.LEVEL_TWO) else 3
    if line[0].isdigit() and ("." in line[:5] or ")" in line[:5]):
        return "numbered", None
    if line[0] in lines.BULLETS:
        return "bulleted", None
    return ("paragraph", None) if len(line) > 20 else None


def test_line_elements(spark):
    docs = spark.createDataFrame([(1, "\n".join(ODD_LINES)), (2, None), (3, ""), (None, "The final chapter")], "doc_id long, text string")
    want = {(1, i, *k, x.strip()) for i, x in enumerate(ODD_LINES) if (k := plain_kind(x))} | {(None, 0, "heading", 1, "The final chapter")} - {()}
    assert {tuple(r) for r in lines.line_elements(docs).collect()} == want


def test_line_kinds(spark):
    text = "CHAPTER ONE\n1. first item\nIntroduction to it\n- second\nplain words that go on for a while\nshort\n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, "Part of the section")], "doc_id long, text string")
    out = {r.doc_id: (r.n_headings, r.n_top, r.n_items, r.n_paragraphs) for r in lines.line_kinds(docs).collect()}
    assert out == {1: (2, 1, 2, 1), 2: (0, 0, 0, 0), 3: (0, 0, 0, 0), None: (1, 1, 0, 0)}


def test_split_structure(spark):
    texts = ["# a\n\n" + "x" * 60 + "\n\n- b\n+ c\n* \n12. d\n3.e", "#\nnext", "####### seven", "\n\n".join(["y" * 51, " " + "z" * 70 + "\t", "w" * 50, "v" * 99]), "", "  - in\n\n  7. on"]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = out.select("i", lines.split_plan(F.col("text")).alias("plan"), *[c.alias(k) for k, c in lines.split_structure(F.col("text")).items()]).orderBy("i").collect()
    for t, r in zip(texts, rows, strict=True):
        marked, listed = len(re.findall(r"^#{1,6}\s+.+$", t, re.M)), len(re.findall(r"^\s*[-*+]\s+.+$|^\s*\d+\.\s+.+$", t, re.M))
        long = [len(p.strip()) for p in t.split("\n\n") if len(p.strip()) > 50]
        assert (r.n_marked, r.n_listed, r.n_long, r.has_paragraphs, r.avg_long) == (marked, listed, len(long), len(long) > 2, round(sum(long) / max(1, len(long)), 6)), t
        assert r.plan == ("headings" if marked else "paragraphs" if len(long) > 2 else "basic")


def test_positions(spark):
    row = spark.createDataFrame([("# a\n\n" + "x" * 60 + "\n\n- b", "- b", "zz")], "text string, p string, q string")
    found = lines.passage_positions(F.col("text"), F.col("p")) | {f"no_{k}": c for k, c in lines.passage_positions(F.col("text"), F.col("q")).items()}
    r = row.select(*[c.alias(k) for k, c in found.items()]).first()
    assert (r.start, r.end, r.valid, r.no_start) == (67, 70, True, None)


def test_no_limit_on_depth(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None, 0) for i in range(12)], "node long, parent long, ord long")
    assert graphs.on_cycles(chain.select("node", "parent")).count() == 0
    assert trees.paths(chain).agg(F.max("depth")).first()[0] == 11
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, None), (6, 5)], "node long, parent long")
    assert sorted(r.node for r in graphs.on_cycles(ring).collect()) == [1, 2, 3, 4]


def test_paths_end_where_two_parents_make_a_ring(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, 1, 0), (3, 2, 0), (2, 3, 0)], "node long, parent long, ord long")
    assert sorted((r.node, r.depth) for r in trees.paths(rows).collect()) == [(1, 0), (2, 1), (3, 2)]
