"""Word files, data set checks, nested trees, inserts, and the life of documents taken in."""

import datetime
import io
import json
import random
import zipfile

from pyspark.sql import functions as F

from docloom.operators import nested
from docloom.sources import dataset, word
from docloom.streaming import lifecycle

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = f'<w:styles {NS}><w:style w:type="paragraph" w:default="1" w:styleId="Std"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="H2"><w:name w:val="heading 2"/></w:style><w:style w:type="paragraph" w:styleId="T"><w:name w:val="Title"/></w:style></w:styles>'
CORE = '<c:coreProperties xmlns:c="http://core" xmlns:dc="http://dc"><dc:title>A Title</dc:title><dc:creator>Someone</dc:creator><c:revision>7</c:revision></c:coreProperties>'


def paragraph(text, style=None, left=None, align=None):
    own = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:ind w:left="{left}"/>' if left is not None else "") + (f'<w:jc w:val="{align}"/>' if align else "")
    return f"<w:p><w:pPr>{own}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def table(rows):
    cell = lambda x: f'<w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{paragraph(x[1:])}</w:tc>' if x.startswith("+") else f"<w:tc>{paragraph(x)}</w:tc>"
    return "<w:tbl>" + "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in rows) + "</w:tbl>"


def docx(body, styles=True, core=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", STYLES)
        if core:
            z.writestr("docProps/core.xml", CORE)
    return out.getvalue()


def test_word_files(spark, tmp_path):
    body = paragraph("Front") + paragraph("Scope", "H2") + paragraph("  ") + paragraph("first item", left=720) + table([["+Name", "Year"], ["a", "x", "2001"]]) + paragraph("End<w:tab/>ing".replace("<w:tab/>", "</w:t><w:tab/><w:t>"), "T", 0, "center") + table([["1"]])
    files = {"a.docx": docx(body), "b/c.docx": docx(paragraph("only", "H1"), styles=False, core=False), "d.docx": b"no zip at all", "e.docx": docx(""), "f.docx": docx("<w:p>")[:-5] , "g.txt": b"not a Word file"}
    for name, data in files.items():
        where = tmp_path / name
        where.parent.mkdir(exist_ok=True)
        where.write_bytes(data)
    rows = word.word_elements(spark, str(tmp_path)).withColumn("f", F.regexp_extract("path", r"([^/]*)$", 1)).orderBy("f", "element", "row_index", "cell_index").collect()
    got = [tuple(r[x] for x in ("element", "kind", "level", "style", "alignment", "left_indent", "table_index", "row_index", "cell_index", "text")) for r in rows if r.f == "a.docx"]
    assert got == [
        (0, "paragraph", None, "Normal", None, None, None, None, None, "Front"), (1, "heading", 2, "Heading 2", None, None, None, None, None, "Scope"), (2, "list_item", None, "Normal", None, 720, None, None, None, "first item"),
        (3, "paragraph", None, "Title", "center", 0, None, None, None, "End\ting"), (4, "table", None, None, None, None, 0, 0, 0, "Name"), (4, "table", None, None, None, None, 0, 0, 1, "Name"), (4, "table", None, None, None, None, 0, 0, 2, "Year"),
        (4, "table", None, None, None, None, 0, 1, 0, "a"), (4, "table", None, None, None, None, 0, 1, 1, "x"), (4, "table", None, None, None, None, 0, 1, 2, "2001"), (5, "table", None, None, None, None, 1, 0, 0, "1"),
    ]
    assert [(r.f, r.kind, r.text) for r in rows if r.f == "c.docx"] == [("c.docx", "paragraph", "only")]
    assert {r.f for r in rows if r.error} == {"d.docx", "f.docx"} and not [r for r in rows if r.f in ("e.docx", "g.txt")]
    elements = word.word_elements(spark, str(tmp_path))
    sections = [(r.section, r.content, r.n_elements, r.word_count) for r in word.word_sections(elements).filter("path LIKE '%a.docx'").orderBy("section").collect()]
    assert sections == [(0, "Front", 1, 1), (1, "Scope\n\nfirst item\n\nEnd\ting\n\n[TABLE_0]\n\n[TABLE_1]", 5, 7)]
    tables = {(r.table_index, r.row_index): (r.cells, r.is_header) for r in word.word_tables(elements).collect()}
    assert tables == {(0, 0): (["Name", "Name", "Year"], True), (0, 1): (["a", "x", "2001"], False), (1, 0): (["1"], False)}
    known = {r.path.rpartition("/")[2]: r for r in word.word_properties(spark, str(tmp_path)).collect()}
    assert (known["a.docx"].title, known["a.docx"].author, known["a.docx"].revision, known["a.docx"].subject) == ("A Title", "Someone", 7, "") and known["c.docx"].revision == 0
    assert known["d.docx"].error and known["a.docx"].file_size == len(files["a.docx"])


def test_dataset_checks(spark, tmp_path):
    corpus, bench = tmp_path / "corpus", tmp_path / "benchmarks"
    assert [tuple(r) for r in dataset.validate_dataset(spark, str(corpus), str(bench))[0].collect()] == [("error", None, None, "dataset_missing")]
    (corpus / "deep").mkdir(parents=True)
    bench.mkdir()
    (corpus / "deep" / "a.txt").write_text("text")
    (corpus / "b.txt").write_text("more")
    (corpus / "empty.txt").write_text("")
    cases = [{"query": "q", "ground_truth": []}, {"query": None, "ground_truth": 1}, {"ground_truth": []}, {"query": "x"}, 5]
    for name, text in {"good": json.dumps({"test_cases": cases[:2]}), "lacks": json.dumps({"test_cases": cases}), "none": json.dumps({"tests": []}), "list": "[1]", "bad": "{", "empty": json.dumps({"test_cases": []}), "odd": json.dumps({"test_cases": "x"})}.items():
        (bench / f"{name}.json").write_text(text)
    found, figures = dataset.validate_dataset(spark, str(corpus), str(bench))
    assert {tuple(r) for r in found.collect()} == {
        ("warning", "lacks.json", 2, "missing_query"), ("warning", "lacks.json", 3, "missing_ground_truth"), ("warning", "lacks.json", 4, "missing_query"), ("warning", "lacks.json", 4, "missing_ground_truth"),
        ("error", "none.json", None, "no_test_cases"), ("error", "list.json", None, "not_json"), ("error", "bad.json", None, "not_json"), ("error", "odd.json", None, "no_test_cases"),
    }
    assert figures == {"valid": False, "corpus_files": 2, "benchmark_files": 7, "total_test_cases": 7}
    rows = spark.createDataFrame([(1, "a"), (None, ""), (3, None)], "id long, text string")
    report = dataset.rule_report(rows, {"has_id": ("error", F.col("id").isNotNull()), "has_text": ("warning", F.col("text") != "")})
    assert {tuple(r) for r in report.collect()} == {("error", "has_id", 3, 1), ("warning", "has_text", 3, 2)}


def plain_nested(rows):
    """Nested objects from (line, level, title) rows by a stack."""
    out, stack = [], []
    for line, level, title in rows:
        while stack and stack[-1][0] >= level:
            stack.pop()
        own = {"line": line} | ({"title": title} if title is not None else {}) | {"children": []}
        (stack[-1][1]["children"] if stack else out).append(own)
        stack.append((level, own))
    return out


def flat(objects, parent=None, depth=0):
    for k, o in enumerate(objects):
        yield o["line"], parent, depth, k, o.get("title")
        yield from flat(o["children"], o["line"], depth + 1)


def test_nested_round_trip(spark):
    rnd = random.Random(2)
    rows = {t: [(i, rnd.randrange(9), None if i % 17 == 0 else f'title "{i}"\n{t}') for i in range(n)] for t, n in ((1, 1), (2, 40), (3, 700))} | {4: [(i, i, "deep") for i in range(30)]}
    frame = spark.createDataFrame([(t, *r) for t, own in rows.items() for r in own], "tree long, line long, level int, title string").repartition(4)
    for ranges in (1, 50):
        texts = nested.export_nested(frame, ["title"], ranges)
        got = {r.tree: json.loads(r.json) for r in texts.collect()}
        assert got == {t: plain_nested(own) for t, own in rows.items()}
    back = nested.import_nested(texts.unionByName(spark.createDataFrame([(8, "no json"), (9, '{"a": 1}'), (10, None), (11, "[]")], "tree long, json string")), {"title": "string"})
    want = {(t, *x) for t, own in rows.items() for x in flat(plain_nested(own))} | {(t, None, None, -1, 0, None) for t in (8, 9, 10)}
    assert {tuple(r[x] for x in ("tree", "line", "parent", "depth", "ord", "title")) for r in back.collect()} == want


def test_grafts_and_inserts(spark):
    nodes = spark.createDataFrame([(1, None, 0), (2, 1, 0), (3, 1, 4)], "node long, parent long, ord long")
    subtree = spark.createDataFrame([(10, None, 0), (11, 10, 0), (12, None, 1)], "node long, parent long, ord long")
    got = {tuple(r) for r in nested.grafted(nodes, subtree, 1).collect()}
    assert got == {(1, None, 0), (2, 1, 0), (3, 1, 4), (10, 1, 5), (11, 10, 0), (12, 1, 6)}
    assert nested.grafted(nodes, subtree, 99).count() == 3 and nested.grafted(nodes, nodes, 2).count() == 3
    assert {tuple(r) for r in nested.grafted(nodes, subtree, 2).collect()} >= {(10, 2, 0), (12, 2, 1)}
    tree = spark.createDataFrame([(1, 100, None, 1), (1, 101, 100, 10), (1, 102, 101, 20), (2, 200, None, 5)], "tree long, node long, parent long, line long")
    rows = spark.createDataFrame([(1, 1, 15, None), (1, 2, 15, 100), (1, 3, 15, 999), (1, 4, None, None), (1, 5, 0, None), (2, 6, 20, None), (3, 7, 1, None), (1, 101, 2, None), (1, 1, 15, None)], "tree long, node long, line long, wanted long")
    got = {(r.tree, r.node, r.parent) for r in nested.bulk_inserted(tree, rows).filter("inserted").collect()}
    assert got == {(1, 1, 101), (1, 2, 100), (1, 3, 101), (1, 4, 100), (1, 5, 100), (2, 6, 200), (3, 7, None)}


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def test_life_of_documents(spark, tmp_path):
    batches = [
        [(1, "processing", 0, at(0)), (2, "pending", 0, at(1)), (3, "processing", None, at(2)), (None, "pending", 0, at(2)), (4, "lost", 0, at(2))],
        [(1, "completed", 0, at(600)), (1, "processing", 0, at(500)), (3, "failed", 0, at(590)), (5, "processing", 0, at(590))],
        [(2, "completed", 0, at(10)), (3, "processing", 1, at(595)), (5, "completed", 0, at(599)), (5, "processing", 0, at(599))],
    ]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, lifecycle.EVENTS).coalesce(1).write.mode("append").parquet(source)
        lifecycle.start(lifecycle.read_events(spark, source), out, str(tmp_path / "check")).awaitTermination()
    want = {(1, "completed", 0), (2, "timed_out", 0), (3, "processing", 1), (5, "completed", 0)}
    state = lambda: {(r.doc_id, r.status, r.attempt) for r in lifecycle.current(spark, out).collect()}
    assert state() == want
    assert {tuple(r) for r in lifecycle.late_counts(spark, out).collect()} == {("completed", 1)}
    for k, rows in enumerate(batches):  # a replay of any batch changes nothing
        lifecycle.store_batch(spark.createDataFrame(rows, lifecycle.EVENTS), k, out)
    assert state() == want and lifecycle.late_counts(spark, out).first().n == 1


def test_outcomes_with_state(spark, tmp_path):
    source = str(tmp_path / "in")
    for rows in ([(1, "processing", 0, at(0)), (2, "processing", 1, at(0))], [(1, "completed", 0, at(5)), (3, "processing", 0, at(900))], [(3, "failed", 2, at(901))]):
        spark.createDataFrame(rows, lifecycle.EVENTS).coalesce(1).write.mode("append").parquet(source)
        query = lifecycle.outcomes(lifecycle.read_events(spark, source)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "completed", 0, 300.0), (2, "timed_out", 1, 0.0), (3, "failed", 2, 60.0)}
