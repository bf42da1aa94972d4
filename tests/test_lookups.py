"""Look-ups over outlines, advice on numbering, and chunk sizes."""

import duckdb
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import outline
from docloom.plans import lookup_queries

ROWS = [
    (1, 1, "chapter", "IV", "roman_upper", [4], 0, "CHAPTER IV of Things", 0.9, 0.8), (1, 2, "section", "4.1", "decimal", [4, 1], 1, "Section 4.1", 1.0, 0.8), (1, 3, "section", "4.3", "decimal", [4, 3], 1, "Section 4.3", 1.0, None), (1, 4, "heading", None, "mixed", [], 2, "a heading", 0.4, None),
    (2, 1, "clause", "a", "letter_lower", [1], 3, "(a)", 0.5, 0.8), (2, 2, "clause", "c", "letter_lower", [3], 3, "(c)", 0.5, 0.8), (2, 3, "clause", "c", "letter_lower", [3], 3, "(c)", 0.5, 0.8), (2, 4, "section", "9.1.1", "decimal", [9, 1, 1], 2, "9.1.1", 0.5, 0.8),
    (3, 1, "article", "1", "decimal", [1], 0, "Article 1", 0.8, 0.8), (3, 2, "article", "2", "decimal", [2], 0, "Article 2", 0.8, 0.8),
]
SCHEMA = "doc_id long, line_number long, element_type string, value string, numbering_type string, parts array<int>, level long, title string, confidence double, number_confidence double"


def test_lookups(spark):
    found = spark.createDataFrame(ROWS, SCHEMA)
    lines = lambda df: {(r.doc_id, r.line_number) for r in df.collect()}
    assert lines(outline.find_elements(found, ["section"])) == {(1, 2), (1, 3), (2, 4)}
    assert lines(outline.find_elements(found, level=0, text="OF THINGS")) == {(1, 1)} and lines(outline.find_elements(found, text="(c)", exact=True)) == {(2, 2), (2, 3)}
    assert lines(outline.find_elements(found, line=4)) == {(1, 4), (2, 4)} and not lines(outline.find_elements(found, text="OF THINGS", exact=True))
    wanted = spark.createDataFrame([(2, "c"), (1, "c")], "doc_id long, full_number string")
    assert [tuple(r) for r in outline.first_numbered(found.withColumnRenamed("value", "full_number"), wanted).collect()] == [(2, "c", 2)]
    nodes = spark.createDataFrame([(1, 5, 10, 1), (1, 5, 11, 3), (1, 5, 12, 2), (1, 6, 13, 0)], "doc_id long, line_number long, node long, registered long")
    assert {tuple(r) for r in outline.at_line(nodes).collect()} == {(1, 5, 11), (1, 6, 13)}
    parents = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 1), (1, 4, 3)], "doc_id long, line_number long, parent_line long")
    ways = {r.line_number: (r.full_number, r.path) for r in outline.full_numbers(found.filter("doc_id = 1"), parents).collect()}
    assert ways == {1: ("IV", ["IV"]), 2: ("IV.4.1", ["IV", "4.1"]), 3: ("IV.4.3", ["IV", "4.3"]), 4: ("IV.4.3", ["IV", "4.3", "heading"])}


def test_counts_and_confidence(spark):
    found = spark.createDataFrame(ROWS, SCHEMA)
    counts = {(r.doc_id, r.element_type): r.n for r in outline.type_counts(found).collect()}
    assert len(counts) == 24 and counts[1, "section"] == 2 and counts[3, "heading"] == 0 and sum(counts.values()) == len(ROWS)
    assert {r.doc_id: (r.n_scores, r.confidence) for r in outline.structure_confidence(found).collect()} == {1: (6, round((0.9 + 0.8 + 1 + 0.8 + 1 + 0.4) / 6, 6)), 2: (8, 0.65), 3: (4, 0.8)}


def test_numbering_advice(spark):
    got = {r.doc_id: r for r in outline.numbering_advice(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert (got[1].n_numbers, got[1].n_gaps, got[1].n_duplicates, got[1].n_issues, got[1].depth) == (3, 0, 1, 0, 2)
    assert got[1].advice == ["Numbering sequence validation failed", "Found 1 duplicate numbers"]
    assert (got[2].n_gaps, got[2].n_duplicates, got[2].n_issues, got[2].depth, got[2].top_share) == (1, 1, 1, 3, 0.75)
    assert got[3].advice == ["Numbering structure appears well-organized"]
    by_last = {r.doc_id: (r.n_gaps, r.n_duplicates, r.n_issues) for r in outline.numbering_sequence_issues(spark.createDataFrame(ROWS, SCHEMA), last_part=True).collect()}
    assert by_last == {1: (1, 0, 0), 2: (1, 1, 1), 3: (0, 0, 0)}


def test_references_and_edges(spark):
    elements = spark.createDataFrame([(1, "a", ["c", "b", "zz"]), (1, "b", []), (1, "c", None), (2, "b", ["a"])], "doc_id long, element string, child_ids array<string>")
    assert {tuple(r) for r in outline.children_of(elements).collect()} == {(1, "a", "c", 0), (1, "a", "b", 1)}
    chunks = spark.createDataFrame([(1, 0, ["zz", "b", "a"]), (1, 1, ["q"]), (1, 2, None)], "doc_id long, chunk_index long, refs array<string>")
    got = {r.chunk_index: r.reference for r in outline.resolved_reference(chunks, elements.select("doc_id", "element")).collect()}
    assert got[0].element == "b" and got[1] is None and got[2] is None
    rows = [(1, 10, "A", 1, None, None), (1, 11, "B", 2, "A", 1), (1, 12, "A", 1, None, None), (1, 13, "C", 3, "A", 2), (2, 14, "D", 4, "A", 1)]
    edges = outline.edges_from_parents(spark.createDataFrame(rows, "doc_id long, element long, text string, line_number long, parent_text string, parent_line long")).collect()
    assert [(r.source, r.target, r.kind, r.bidirectional, r.confidence, r.similarity) for r in edges] == [(10, 11, "parent_child", True, 0.95, 0.9)]


def test_optimised_sizes(spark):
    texts = ["a" * 8, " ", "b" * 8, "c" * 100, "d" * 8, "e" * 500, "f" * 12, "g" * 36, "h" * 4]
    pieces = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "  ")], "doc_id long, chunk_index long, content string")
    got = [(r.content, r.n_merged) for r in outline.optimised_sizes(pieces, 10, 12, 100).orderBy("chunk_index").collect()]
    assert got == [("a" * 8 + "\n\n" + "b" * 8, 3), ("c" * 100, 1), ("d" * 8, 1), ("e" * 250, 1), ("e" * 250, 1), ("f" * 12 + "\n\n" + "g" * 36, 2), ("h" * 4, 1)]


def test_optimised_sizes_of_sentences(spark):
    """Sentences keep the digits at their ends, also those of their place."""
    docs = spark.createDataFrame([(1, "0 zero 0. 1 one 1. 2 two 2. " + "3" * 80 + "3.")], "doc_id long, text string")
    pieces = docs.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("chunk_index", "content"))
    got = [(r.content, r.n_merged) for r in outline.optimised_sizes(pieces, 20, 60, 100).orderBy("chunk_index").collect()]
    assert got == [("0 zero 0.\n\n1 one 1.\n\n2 two 2.", 3), ("3" * 81 + ".", 1)]


def test_optimised_sizes_of_odd_spaces(spark, tmp_path):
    """As in its SQL, sentences lose only spaces at their ends, a text of white space alone stays, and U+0001 ends a sentence."""
    texts = ["\nfoo. \xa0bar.  baz\n", "\n\n\n", " \u2003\u2003 ", "\t" + "x" * 450 + "\u3000", "one\x01two. \x01three", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT * FROM ({lookup_queries.SQL['chunk_sizes_optimised']}) ORDER BY doc_id, chunk_index").fetchall()
    got = lookup_queries.chunk_sizes_optimised(spark, str(tmp_path)).orderBy("doc_id", "chunk_index").collect()
    assert [tuple(r) for r in got] == want
    assert [r.content for r in got if r.doc_id in (0, 1, 4)] == ["\nfoo.\n\n\xa0bar.\n\nbaz\n", "\n\n\n", "one\n\ntwo.\n\nthree"]


def test_encodings_and_types(spark):
    rows = spark.createDataFrame([("UTF_16", "application/pdf", "x.txt"), (None, None, "a/B.DOCX"), ("latin1", "image/png", "c.doc"), ("", None, "no_extension"), (None, "text/plain", None)], "d string, mime string, name string")
    got = rows.select(tx.encoding_order(F.col("d")).alias("e"), tx.typed(F.col("mime"), F.col("name")).alias("t")).collect()
    assert [r.t for r in got] == ["pdf", "docx", "doc", None, "txt"]
    assert got[0].e[:3] == ["utf-16", "utf-8", "utf-8-sig"] and got[1].e[0] == "utf-8" and got[2].e[:2] == ["latin1", "utf-8"] and all(len(r.e) == len(set(r.e)) == 33 for r in got)
