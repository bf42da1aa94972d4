"""Records: maps and lists, layout, token fallbacks, rejoined chunks, roots and checks of trees."""

from pyspark.sql import functions as F

from docloom.operators import records, trees


def test_maps_lists_and_layout(spark):
    rows = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": None}, ["x"], "odd"), ({}, {}, None, "even"), ({"a": "1"}, {}, ["y", "x", "y"], "w" * 90)], "m map<string,string>, n map<string,string>, l array<string>, t string")
    got = rows.select(records.merged_maps(F.col("m"), F.col("n")).alias("m"), records.added(F.col("l"), F.lit("y")).alias("a"), records.removed(F.col("l"), F.lit("y")).alias("r"), records.centred(F.col("t")).alias("c"), records.centred(F.col("t"), 7).alias("d")).collect()
    assert [r.m for r in got] == [{"a": "1", "b": "3", "c": None}, {}, {"a": "1"}]
    assert [r.a for r in got] == [["x", "y"], ["y"], ["y", "x", "y"]] and [r.r for r in got] == [["x"], None, ["x"]]
    assert [r.c for r in got] == [t.center(80) for t in ("odd", "even", "w" * 90)] and [r.d for r in got] == [t.center(7) for t in ("odd", "even", "w" * 90)]


def test_tokens_and_sizes(spark):
    rows = spark.createDataFrame([("", 1, 2), ("Section 4.1 and (a) under 12 Abc. 5", 0, 5), ("plain text of some length", 5, 5), ("x", None, 5)], "t string, a int, b int")
    got = rows.select(records.fallback_tokens(F.col("t")).alias("n"), records.fallback_tokens(F.col("t"), legal=False).alias("p"), records.valid_sizes(F.col("a"), F.col("b")).alias("v")).collect()
    assert [(r.n, r.p, r.v) for r in got] == [(1, 1, True), (int(11 * 1.1) + 3, 11, False), (int(8 * 1.1), 8, False), (1, 1, False)]


def test_formatting(spark):
    chars = "array<struct<fontname:string,size:string,ncs:string>>"
    rows = spark.createDataFrame([([("Times-Bold", "12", "rgb"), ("Times", "9.5", None), (None, "huge", "cmyk"), ("Arial-BoldOblique", "12", "rgb")],), ([],)], f"c {chars}")
    got = rows.select(*[c.alias(k) for k, c in records.formatting(F.col("c")).items()]).collect()
    assert tuple(got[0]) == (["Arial-BoldOblique", "Times", "Times-Bold"], [9.5, 12.0], ["cmyk", "rgb"], 2, 1, 4) and tuple(got[1]) == ([], [], [], 0, 0, 0)


def test_trees(spark):
    nodes = spark.createDataFrame([(1, None, 0), (2, 1, 1), (3, 1, 0), (4, 99, 0)], "node long, parent long, ord long")
    assert {tuple(r) for r in records.rooted(nodes, -1).collect()} == {(1, -1, 0), (2, 1, 1), (3, 1, 0), (4, -1, 0), (-1, None, 0)}
    assert {tuple(r) for r in records.rooted(nodes.filter("node < 4"), -1).collect()} == {(1, None, 0), (2, 1, 1), (3, 1, 0)}
    assert [tuple(r) for r in records.child_at(nodes, 0).filter("parent = 1").collect()] == [(1, 3)] and [tuple(r) for r in records.child_at(nodes, -1).filter("parent = 1").collect()] == [(1, 2)]
    stored = spark.createDataFrame([(1, None, 0, 10), (2, 1, 2, 11), (3, 1, 1, 5), (4, 99, 0, 1)], "node long, parent long, depth long, line long")
    got = {tuple(r) for r in records.tree_violations(trees.paths(nodes.filter("node < 4")), stored).collect()}
    assert got == {(2, "wrong_depth"), (3, "before_parent"), (4, "no_way_to_root")}


def test_chunks_and_cases(spark):
    chunks = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (1, 10, "c"), (2, 0, "")], "doc_id long, chunk_index long, content string")
    assert {tuple(r) for r in records.rejoined(chunks).collect()} == {(1, "a\nb\nc", 3), (2, "", 1)}
    cases = spark.createDataFrame([(1, 1, "world"), (2, 1, "moon"), (3, 9, "x"), (4, 1, "")], "case_id long, doc_id long, answer string")
    texts = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    assert [tuple(r) for r in records.corrected_cases(cases, texts).collect()] == [(1, 1, 6, 11, "world")]
    named = spark.createDataFrame([("abc", "/x/one.txt"), ("a", "one.txt"), ("abcdef", "/y/two.txt")], "content string, source string")
    assert tuple(records.chunk_overview(named).first()) == (3, 3.3333, 1, 6, 2, ["one.txt", "two.txt"])


def test_label_metrics_are_those_of_the_listed_truth(spark):
    from docloom.operators import evaluate

    labels = spark.createDataFrame([("a", 1), ("b", 1), (" c ", 2), ("d", None), ("", 1)], "item string, label int")
    asked = spark.createDataFrame([(1, 1), (2, 2), (3, 7), (4, 1)], "query_id long, label int")
    found = spark.createDataFrame([(1, "a"), (1, " a "), (1, "c"), (1, "zz"), (2, "c"), (3, "a"), (3, "")], "query_id long, item string")
    truth = asked.join(labels, "label").select("query_id", "item")
    want = {tuple(r) for r in evaluate.retrieval_metrics(found, truth).collect()}
    assert {tuple(r) for r in evaluate.label_metrics(found, labels, asked).collect()} == want and len(want) == 4
