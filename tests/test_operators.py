"""Operators on small tables."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.operators import chunks, corpus, evaluate, graphs, quality, search, spans, structure, trees
from docloom.sources import files
from docloom.streaming import ingest

NODES = "node long, parent long, ord long"


@pytest.fixture(scope="module")
def forest(spark):
    rows = [(1, None, 0), (2, 1, 1), (3, 1, 0), (4, 2, 0), (5, 2, 1), (6, 4, 0), (9, None, 1), (20, 21, 0), (21, 20, 0)]
    return spark.createDataFrame(rows, NODES)


def test_tree_orders(forest):
    found = trees.paths(forest)
    assert [r.node for r in trees.preorder(found).collect()] == [1, 3, 2, 4, 6, 5, 9]
    assert [r.node for r in trees.postorder(found).collect()] == [3, 6, 4, 5, 2, 1, 9]
    assert [r.node for r in trees.levelorder(found).collect()] == [1, 9, 3, 2, 4, 5, 6]


def test_tree_measures(forest):
    of = {r.node: r for r in trees.measures(trees.paths(forest)).collect()}
    assert (of[1]["size"], of[1].height, of[1].n_leaves, of[1].n_children) == (6, 3, 3, 2)
    assert (of[9]["size"], of[9].height, of[9].n_children) == (1, 0, 0)


def test_large_forests_go_in_parts(spark, monkeypatch):
    """Paths and their sums are dealt by number, so a part stays small however large the forest; results do not change."""
    monkeypatch.setattr(trees, "PART", 8)
    rows = [(i, (i - 1) // 2 if i else None, i) for i in range(200)]
    forest = spark.createDataFrame(rows, NODES)
    found = trees.paths(forest)
    assert trees.spread(found).rdd.getNumPartitions() == 25
    of = {r.node: r for r in trees.measures(found).collect()}
    size = [1] * 200
    for i in range(199, 0, -1):
        size[(i - 1) // 2] += size[i]
    assert len(of) == 200 and all(of[i]["size"] == size[i] and of[i].n_children == sum(2 * i + k < 200 for k in (1, 2)) for i in range(200))
    kinds = forest.select("node", F.when(F.col("node") % 2 == 0, "even").otherwise("odd").alias("kind"))
    both = {r.node: r for r in trees.subtree_kinds(found, kinds, ["even", "odd"]).collect()}
    assert all(both[i].even + both[i].odd == size[i] for i in range(200)) and (both[0].even, both[5].odd) == (100, sum(k % 2 for k in range(200) if 5 in above(k)))


def above(k):
    return {k} | (above((k - 1) // 2) if k else set())


def test_related_chunks_make_no_rows_of_other_elements(spark):
    """Edges that repeat count once; elements that no chunk names are dropped before the chunks meet them."""
    edges = spark.createDataFrame([(1, 2, "x"), (1, 2, "x"), (2, 3, "x"), (2, 4, "y"), (2, 4, "x")], "source long, target long, kind string")
    refs = spark.createDataFrame([(10, 1), (11, 1), (12, 3), (13, 9), (14, 2)], "chunk long, element long")
    got = graphs.related_chunks(refs.filter("chunk = 10").select("chunk"), refs, edges, 2).collect()
    assert sorted((r.chunk, r.related, r.element, r.distance) for r in got) == [(10, 11, 1, 2), (10, 12, 3, 2), (10, 14, 2, 1)]
    ends = spark.createDataFrame([(2,), (3,)], "node long")
    assert {(r.node, r.distance) for r in graphs.within_hops(edges, spark.createDataFrame([(1,)], "node long"), 2, ends=ends).collect()} == {(2, 1), (3, 2)}


def test_every_chunk_asks_for_its_related_ones(spark):
    import duckdb

    from docloom.plans import graph_queries

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    chunks = [k for (k,) in con.execute(f"SELECT c_custkey FROM '{sf}/customer.parquet'").fetchall()]
    sold = set(con.execute(f"SELECT l_partkey, l_suppkey FROM '{sf}/lineitem.parquet'").fetchall())
    by = {p: {s for q, s in sold if q == p} for p in {k % 97 for k in chunks}}
    want = [(a, b, b % 97, 2) for a in chunks for b in chunks if a != b and by[a % 97] & by[b % 97]]
    assert sorted(map(tuple, graph_queries.graph_related_chunks(spark, sf).collect())) == sorted(want) and any(a % 50 for a, *_ in want)
    refs = spark.createDataFrame([(1, 7), (2, 7), (2, 7)], "chunk long, element long")
    got = graphs.related_chunks(refs.select("chunk"), refs, spark.createDataFrame([(7, 8, "x")], "source long, target long, kind string")).collect()
    assert sorted((r.chunk, r.related) for r in got) == [(1, 2), (1, 2), (2, 1)]  # a row for each reference found, whatever the number of those that ask


def test_tree_edits(spark, forest):
    found = trees.paths(forest)
    pairs = spark.createDataFrame([(6, 5), (3, 6), (6, 2), (6, 9)], "a long, b long")
    assert {(r.a, r.b): r.ancestor for r in trees.common_ancestor(found, pairs).collect()} == {(6, 5): 2, (3, 6): 1, (6, 2): 2, (6, 9): None}
    left = trees.prune(forest, found, spark.createDataFrame([(2,)], "node long"))
    assert sorted(r.node for r in left.collect()) == [1, 3, 9, 20, 21]


def test_long_chain(spark):
    rows = [(i, i - 1 if i else None, 0) for i in range(40)]
    found = trees.paths(spark.createDataFrame(rows, NODES))
    assert found.agg(F.max("depth")).first()[0] == 39


def test_graphs(spark, forest):
    edges = spark.createDataFrame([(1, 2, "references"), (2, 3, "similar"), (3, 4, "similar")], "source long, target long, kind string")
    near = {(r.start, r.node): r.distance for r in graphs.within_hops(edges, spark.createDataFrame([(1,)], "node long"), 2).collect()}
    assert near == {(1, 2): 1, (1, 3): 2, (1, 1): 2}
    assert sorted(r.node for r in graphs.on_cycles(forest.select("node", "parent")).collect()) == [20, 21]
    back = graphs.both_ways(edges.withColumn("bidirectional", F.col("source") == 1))
    assert ("2", "1", "referenced_by") in [tuple(map(str, r)) for r in back.collect()]


def test_spans(spark):
    c = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 20)], "doc_id long, chunk_index long, start_char long, end_char long")
    e = spark.createDataFrame([(1, "a", 0, 6), (1, "b", 6, 12), (1, "c", 12, 20)], "doc_id long, element string, start_char long, end_char long")
    assert [(r.chunk_index, r.element, r.overlap) for r in spans.best_overlap(c, e).orderBy("chunk_index").collect()] == [(0, "a", 6), (1, "c", 8)]
    rows = spark.createDataFrame([(1, 5), (1, 15), (2, 3)], "k long, at long")
    marks = spark.createDataFrame([(1, 5, "x"), (1, 9, "y")], "k long, at long, v string")
    assert {(r.k, r["at"]): r.v for r in spans.last_before(rows, marks, "k", "at", "v").collect()} == {(1, 5): "x", (1, 15): "y", (2, 3): None}


def test_packed_pieces_keep_digits(spark):
    """A piece loses spaces at its ends, not the digits of its place among the pieces."""
    docs = spark.createDataFrame([(1, "0 one 0\n\n 1 two 1 \n\n2 three 2\n\n")], "doc_id long, text string")
    assert [(r.content, r.n_pieces, r.size) for r in chunks.pack_paragraphs(docs, 100).collect()] == [("0 one 0\n\n1 two 1\n\n2 three 2", 3, 23)]
    texts = spark.createDataFrame([(1, " 0 first one 0.  1 second one 1. 2 third one 2. ")], "doc_id long, text string")
    assert [(r.content, r.n_pieces) for r in chunks.pack_sentences(texts, 200).collect()] == [("0 first one 0. 1 second one 1. 2 third one 2.", 3)]


def test_chunks(spark):
    text = "One two three. " * 40
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "para one\n\npara two\n\n\n\npara three")], "doc_id long, text string")
    fixed = chunks.fixed_windows(docs, 25, 5).filter("doc_id = 1").orderBy("chunk_index").collect()
    assert all(r.content == text[r.start_char : r.end_char] for r in fixed) and fixed[-1].end_char == len(text)
    packed = chunks.pack_paragraphs(docs, 16).filter("doc_id = 4").collect()
    assert [(r.content, r.n_pieces) for r in packed] == [("para one\n\npara two", 2), ("para three", 1)]
    lapped = chunks.pack_paragraphs(docs, 18, overlap=True).filter("doc_id = 4").collect()
    assert [r.content for r in lapped] == ["para one\n\npara two", "para two\n\npara three"]
    pieces = chunks.split_recursive(docs, 50, 10).filter("doc_id = 1").collect()
    assert all(len(r.content) <= 50 for r in pieces) and len(pieces) > 10
    large = chunks.split_large(docs, 100, 20).filter("doc_id = 1").orderBy("chunk_index").collect()
    assert all(r.content == text[r.start_char : r.start_char + len(r.content)] for r in large)
    assert large[-1].start_char + len(large[-1].content) == len(text)
    head = chunks.by_headings(spark.createDataFrame([(1, "pre\n# A\nbody\n## B\nmore")], "doc_id long, text string")).collect()
    assert [(r.level, r.title, r.content) for r in head] == [(0, "", "pre"), (1, "A", "body"), (2, "B", "more")]


def test_structure(spark):
    text = "ARTICLE II\n\nSection 2.1 Terms\n(a) first\n\nTITLE LINE\n==========\nplain words go on"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = structure.with_parents(structure.elements(docs)).orderBy("line_number").collect()
    assert [(r.element_type, r.value, r.level, r.parent_line) for r in found] == [("article", "II", 0, None), ("section", "2.1", 2, 1), ("list_item", "a", 3, 3)]
    heads = {r.title: r for r in structure.format_headings(docs).collect()}
    assert heads["TITLE LINE"].is_underlined and heads["TITLE LINE"].is_caps
    assert "plain words go on" not in heads


def test_corpus(spark):
    docs = spark.createDataFrame([(1, "s", "a" * 30), (2, "s", "b" * 40), (3, "s", "c" * 50), (4, "s", "d" * 200), (5, "s", "e"), (6, "t", "f")], "doc_id long, source string, text string")
    out = [(r.group, r.first_doc, r.n_docs, len(r.text)) for r in corpus.merge_short(docs, 100).orderBy("first_doc").collect()]
    assert out == [("s", 1, 3, 124), ("s", 4, 1, 200), ("s", 5, 1, 1), ("t", 6, 1, 1)]


def test_metrics(spark):
    got = spark.createDataFrame([(1, "a "), (1, "b"), (1, "b"), (2, "x")], "query_id long, item string")
    truth = spark.createDataFrame([(1, "a"), (1, "c"), (3, "z")], "query_id long, item string")
    by = {r.query_id: (r.precision, r.recall, r.f1, r.exact_match) for r in evaluate.retrieval_metrics(got, truth).collect()}
    assert by == {1: (0.5, 0.5, 0.5, 0.0), 2: (0.0, 0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0, 0.0)}


def test_quality(spark):
    rows = spark.createDataFrame([(0, " ", 0, 1), (1, "abc", 5, 5), (2, "abc", 0, 3), (-1, None, -1, 3)], "chunk_index long, content string, start_char long, end_char long")
    out = [r.violations for r in quality.check_chunks(rows).collect()]
    assert out == [["blank_text"], ["bad_span"], [], ["blank_text", "bad_index", "bad_start"]]


def test_nearest_each_equals_brute_force(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    got = search.nearest_each(rows.filter("vec_id % 20 = 0"), rows, 4, block=2)
    assert got.count() == 12
    one = search.nearest(rows, [0.0, 0.0, 1.0], 4)
    assert [r.vec_id for r in one.collect()] == [r.vec_id for r in got.filter("query_id = 0").orderBy("rank").collect()]


def test_within_each_keeps_to_the_group(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0], i % 3 if i % 11 else None) for i in range(60)], "vec_id long, embedding array<double>, label int")
    asked = rows.filter("vec_id % 4 = 0")
    label = {r.vec_id: r.label for r in rows.collect()}
    every = {(r.query_id, r.vec_id, r.similarity) for r in search.within_each(asked, rows, 0.9, block=3).collect()}
    own = {(r.query_id, r.vec_id, r.similarity) for r in search.within_each(asked, rows, 0.9, block=3, group="label").collect()}
    assert own == {x for x in every if label[x[0]] is not None and label[x[0]] == label[x[1]]} and own
    assert search.within_each(asked.limit(0), rows, 0.9, group="label").count() == 0


def test_near_vectors_of_other_labels(spark):
    import numpy as np

    from docloom.plans import table_queries

    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    matrix = np.array([r.embedding for r in rows], dtype=np.float64)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    alike = np.round(matrix @ matrix.T, 6)
    want = {(rows[i].vec_id, rows[k].vec_id) for i, k in zip(*np.nonzero(alike >= 0.3), strict=True) if i != k and rows[i].vec_id % 50 == 0}
    got = [(r.a, r.b) for r in table_queries.near_dup_cosine_all_labels(spark, "/root/testdata/sf0.01").collect()]
    label = {r.vec_id: r.label for r in rows}
    assert len(got) == len(set(got)) and set(got) == want and any(label[a] != label[b] for a, b in got)
    assert search.within_each(spark.createDataFrame([], "vec_id long, embedding array<double>"), spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"), 0.3).count() == 0


def test_near_copies_of_the_whole_table(spark):
    import numpy as np

    from docloom.plans import table_queries

    def brute(rows, at_least):
        matrix = np.array([v for _, v in rows], dtype=np.float64)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        alike = np.round(matrix @ matrix.T, 6)
        return sorted((rows[i][0], rows[k][0], alike[i, k].item()) for i, k in zip(*np.nonzero(alike >= at_least), strict=True) if rows[i][0] != rows[k][0])

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want = brute(rows, 0.3)
    assert sorted(map(tuple, table_queries.near_dup_cosine(spark, "/root/testdata/sf0.01").collect())) == want and any(a % 50 and b % 50 for a, b, _ in want)
    rows = [(i, [float(i % 7), float(i % 5), float(i % 3)]) for i in range(60)] + [(7, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame([*rows, (99, None), (None, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    for block in (3, 1000):
        got = sorted(map(tuple, search.links(table, 0.9, block=block).collect()))
        assert [x[:2] for x in got] == [x[:2] for x in brute(rows, 0.9)] and np.allclose([x[2] for x in got], [x[2] for x in brute(rows, 0.9)], atol=2e-6)
    assert search.links(table.limit(0), 0.9).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("grüße".encode())
    (tmp_path / "b.md").write_bytes("wide".encode("utf-16"))
    (tmp_path / "c.txt").write_bytes("caf\xe9 \x93x\x94".encode("latin-1"))
    (tmp_path / "d.exe").write_bytes(b"\0")
    xml = f'<w:document xmlns:w="{files.WORD[1:-1]}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p/></w:body></w:document>'
    with zipfile.ZipFile(blob := io.BytesIO(), "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "e.docx").write_bytes(blob.getvalue())
    (tmp_path / "f.docx").write_bytes(b"broken")
    by = {r.path.rsplit("/", 1)[1]: r for r in files.load_files(spark, str(tmp_path)).collect()}
    assert by["a.txt"].text == "grüße" and by["b.md"].text == "wide" and by["c.txt"].text.startswith("café")
    assert by["e.docx"].text == "Hello"
    assert by["d.exe"].error and by["f.docx"].error and by["f.docx"].text is None


def test_cases(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"test_cases": [{"query": "q", "ground_truth": [{"file_path": "f", "start_char": 1, "end_char": 3, "text": "bc"}], "expected_answer": "x"}]}')
    (tmp_path / "two.json").write_text('{"tests": [{"query": "p", "snippets": [{"file_path": "g", "answer": "y"}]}]}')
    rows = sorted((r.suite, r.query, r.file_path, r.expected) for r in files.test_cases(spark, str(tmp_path)).collect())
    assert rows == [("one.json", "q", "f", "bc"), ("two.json", "p", "g", "y")]


def test_streaming(spark, tmp_path):
    rows = [(1, "same  text", "s", "2024-01-01 00:00:00"), (2, "same text", "s", "2024-01-01 00:01:00"), (3, "other", "t", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, arrived string").withColumn("arrived", F.to_timestamp("arrived")).write.parquet(str(tmp_path / "in"))
    stream = ingest.fresh_documents(ingest.read_documents(spark, str(tmp_path / "in")))
    ingest.start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["other", "same text"]


def test_redundancy_against_all_rows(spark):
    vectors = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.01]), (4, [0.01, 1.0]), (5, [1.0, 1.0]), (6, None), (7, [1.0, 0.0])]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.redundant) for r in search.redundancy(rows.filter("vec_id <> 4"), rows).collect()}
    assert got == {1: (2, False), 2: (1, False), 3: (2, True), 5: (0, False), 6: (0, False), 7: (2, True)}
    assert search.redundancy(rows.limit(0), rows).count() == 0


def plain_merge(rows, least):
    out, held = [], []

    def close():
        if held:
            out.append((held[0][0], held[0][1], len(held), "\n\n".join(x[2] for x in held)))
        held.clear()

    for g, i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0)):
        t = t or ""
        if held and (held[0][0] != g or len(t) >= least):
            close()
        held.append((g, i, t))
        if len(t) >= least or sum(len(x[2]) for x in held) >= least:
            close()
    close()
    return out


def test_merging_over_many_ranges(spark):
    import random

    rnd = random.Random(9)
    sizes = lambda g: rnd.choice([0, 3, 10, 25, 60, 120]) if g == "hot" else rnd.choice([1, 2]) if g == "small" else rnd.randrange(300)
    rows = [(g, i * 7 + 2**60, "x" * sizes(g) or None) for g, n in (("hot", 800), ("small", 500), ("b", 60), ("c", 1)) for i in range(n)] + [(None, i, "y" * 30) for i in range(9)] + [("b", None, "null id")]
    docs = spark.createDataFrame(rows, "source string, doc_id long, text string").repartition(5)
    for ranges in (1, 70):
        assert sorted(map(repr, map(tuple, corpus.merge_short(docs, 100, ranges=ranges).collect()))) == sorted(map(repr, plain_merge(rows, 100)))
    assert corpus.merge_short(docs.limit(0)).count() == 0
