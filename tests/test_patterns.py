"""The catalogue of patterns against Python's re."""

import random
import re

import duckdb
import pyarrow as pa

from docloom.operators import structure
from docloom.plans import chunk_queries

PIECES = (
    "§ 12.3", "§§ 1 - 2.4", "§ 1, 2.5 , 3", "Article IV", "ARTICLE 2: Terms", "article iv – Of Things", "Article X.", "Section 3.1", "section 4 - On More", "Section 5. Next", "(Section 9)", "Chapter II", "chapter 3.", "Subsection 2.1: x", "(subsection 4)", "1.", "1.2", "12 apples", "3) three", "(4) four",
    "IV. fourth", "xi eleven", "(iv) fourth", "A. one", "b two", "(c) three", "Clause 8", "clause 8.1 - x", "Paragraph 3", "- dash", "– dash", "* star", "• dot", "GENERAL TERMS", "General Terms", "Heading\n=====", "          centred          ", "WHEREAS", "therefore", "provided  that", "Subject\nto", "notwithstanding",
    "in accordance with", "see Section 4", "See article V", "pursuant to section 2", "in Section 3", "under section 9.9", "\tTab", "    indent", "", "  ", "plain words, a few.", "é", "I", "a", "Ab cd Ef", "Ab c Ef", "12",
)


def test_counts_of_all_patterns(spark):
    rnd = random.Random(8)
    texts = ["\n".join(rnd.choices(PIECES, k=rnd.randrange(1, 25))) for _ in range(150)] + ["", "\n", "\n\n", " \n \n", "a\n", "Word " * 30_000, "\n".join(PIECES)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string")
    got = {(r.category, r.pattern): (r.n_docs, r.n_matches) for r in structure.pattern_counts(docs).collect()}
    want = {}
    for c, names in structure.PATTERNS.items():
        for n, p in names.items():
            found = [len(re.findall(p, t, re.M if n == "all_caps" else re.M | re.I)) for t in texts]
            want[c, n] = (sum(x > 0 for x in found), sum(found))
    assert got == want and len(got) == 60


def test_some_categories(spark):
    docs = spark.createDataFrame([(1, "Article I\nSection 2")], "doc_id long, text string")
    assert {r.category for r in structure.pattern_counts(docs, ["articles", "sections"]).collect()} == {"articles", "sections"}
    assert structure.pattern_supported("articles", "article_basic") and not structure.pattern_supported("articles", "nothing") and not structure.pattern_supported("none")
    assert structure.pattern_counts(docs.limit(0)).filter("n_matches > 0").count() == 0


def test_positions_keep_the_longest(spark):
    docs = spark.createDataFrame([(1, "see Section 3.1 - On Terms\nSection 4"), (2, None)], "doc_id long, text string")
    rows = {(r.category, r.start_char, r.match) for r in structure.pattern_positions(docs).collect()}
    assert ("sections", 4, "Section 3.1 - On Terms") in rows and ("sections", 27, "Section 4") in rows and ("cross_references", 0, "see Section 3.1") in rows
    assert not [r for r in rows if r[0] == "sections" and r[1] == 4 and r[2] == "Section 3.1"]


def test_positions_leave_a_worker_in_small_batches(spark, monkeypatch):
    """A worker holds few matches at a time, and none are lost between batches."""
    monkeypatch.setattr(structure, "BATCH_BYTES", 1_000)
    text = "\n".join(f"Section {i}.1 - On Terms" for i in range(300))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, text)], "doc_id long, text string")
    found = structure.pattern_positions(docs)
    assert found.filter("category = 'sections'").groupBy("doc_id").count().orderBy("doc_id").collect() == [(1, 300), (3, 300)]
    sizes = [b.num_rows for b in structure.found_matches(iter(docs.toArrow().to_batches()))]
    assert len(sizes) > 10 and max(sizes) <= 1_000 // structure.ROW_BYTES + 1


def test_counts_as_in_sql_on_odd_texts(spark, tmp_path):
    """Matches side by side, lone carriage returns and vertical tabs count as in the SQL, and no pattern is tried row by row in the JVM."""
    rnd = random.Random(9)
    ends = ["\n", "\n\n", "\r", "\r\n", " ", "    ", "          ", "\t", "\v", "\xa0", "x", "4", "---", ".", "", "\n   ", " \n \n"]
    texts = ["".join(rnd.choice(PIECES) + rnd.choice(ends) for _ in range(rnd.randrange(1, 12))) for _ in range(400)]
    texts += ["see section 4see section 5", "1. a\r2. b\n3. c", "a\n   b\n    c", "\v", "a\n\v\n\nb", "section\v2", "          mid          \n          mid          \n\nx", "a\n---\n---", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("pattern_counts_by_category", "pattern_coverage"):
        found = chunk_queries.QUERIES[name](spark, str(tmp_path))
        assert sorted(tuple(r) for r in found.collect()) == sorted(con.execute(chunk_queries.SQL[name]).fetchall())
        assert "regexp" not in found._jdf.queryExecution().executedPlan().toString().lower()


def test_counts_leave_a_worker_as_one_row_a_pattern():
    batch = pa.RecordBatch.from_arrays([pa.array(["Section 1", None, "Section 2\nSection 3"] * 50)], names=["text"])
    out = list(structure.counted_matches(iter([batch, batch.slice(0, 0)]), structure.PATTERNS))
    assert [b.num_rows for b in out] == [60, 60]
    assert [(r["n_docs"], r["n_matches"]) for b in out for r in b.to_pylist() if r["pattern"] == "section_basic"] == [(100, 150), (0, 0)]
