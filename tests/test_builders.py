"""Trees from ordered rows against plain stacks and recursions, cut into many ranges."""

import random
from collections import Counter

from pyspark.sql import functions as F

from docloom.operators import builders, trees


def stack_parents(rows):
    """Parents by one stack over (tree, line, level) in the given order."""
    out, stack, tree = set(), [], object()
    for t, line, level in rows:
        if t != tree:
            stack, tree = [], t
        while stack and stack[-1][1] >= level:
            stack.pop()
        out.add((t, line, level, stack[-1][0] if stack else None))
        stack.append((line, level))
    return out


def outline_rows(seed, n, one_tree=0.4):
    rnd, at, rows = random.Random(seed), 0, []
    for i in range(n):
        at = max(0, min(9, at + rnd.choice([-3, -1, -1, 0, 0, 1, 1, 2])))
        rows.append((1 if i < n * one_tree else 2 + i % 50 if i < 0.9 * n else None, i * 3, at))
    return rows


def order(rows, by):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *by(r)))


def test_outline_parents_of_many_lines(spark):
    rows = outline_rows(1, 100_000)
    frame = spark.createDataFrame(rows, "tree long, line long, level int").repartition(6)
    for ranges in (4, 97):
        got = {tuple(r) for r in builders.outline_parents(frame, ranges).collect()}
        assert got == stack_parents(order(rows, lambda r: (r[1],)))


def test_depth_first_parents(spark):
    rows = outline_rows(2, 5000)
    frame = spark.createDataFrame(rows, "tree long, line long, level int").repartition(3)
    for ranges in (1, 60):
        assert {tuple(r) for r in builders.depth_first_parents(frame, ranges).collect()} == stack_parents(order(rows, lambda r: (r[2], r[1])))
    assert builders.depth_first_parents(frame.limit(0)).count() == 0


def halved(lines, above=None, side=None, depth=0):
    if not lines:
        return []
    m = len(lines) // 2
    return [(lines[m], above, side, depth), *halved(lines[:m], lines[m], "left", depth + 1), *halved(lines[m + 1 :], lines[m], "right", depth + 1)]


def test_balanced_parents(spark):
    rnd = random.Random(3)
    rows = [(t, x) for t, n in ((1, 3000), (2, 1), (3, 2), (4, 64), (None, 100)) for x in rnd.sample(range(10**6), n)]
    frame = spark.createDataFrame(rows, "tree long, line long").repartition(5)
    want = {(t, *r) for t in {t for t, _ in rows} for r in halved(sorted(x for u, x in rows if u == t))}
    for ranges in (1, 40):
        assert {tuple(r) for r in builders.balanced_parents(frame, ranges).collect()} == want
    made_up = frame.filter("tree = 4").withColumn("node", F.col("line")).unionByName(spark.createDataFrame([(4, None, -1)], "tree long, line long, node long"))
    assert {tuple(r) for r in builders.rebalanced(made_up).collect()} == {r for r in want if r[0] == 4}


def forest(seed, n):
    rnd = random.Random(seed)
    parent = {i: rnd.choice([None, *range(max(0, i - 30), i)]) if i % 40 else None for i in range(n)}
    return [(i, p, i) for i, p in parent.items()]


def below(rows):
    """Each node's subtree in pre-order."""
    children = {}
    for i, p, _ in rows:
        children.setdefault(p, []).append(i)
    out = {}

    def walk(i):
        own = [i]
        for c in children.get(i, ()):
            own += walk(c)
        out[i] = own
        return own

    whole = [x for root in children.get(None, ()) for x in walk(root)]
    return whole, out, children


def test_subtrees(spark):
    rows = forest(5, 400)
    whole, subtree, children = below(rows)
    kinds = {i: "abc"[i % 3] if i % 11 else None for i in range(400)}
    texts = {i: None if i % 13 == 0 else "t" * (i % 7) + str(i) for i in range(400)}
    nodes = spark.createDataFrame(rows, "node long, parent long, ord long")
    found = builders.written(trees.paths(nodes))
    for ranges in (1, 23):
        spans = builders.written(builders.subtree_intervals(found, ranges))
        assert {(r.node, r.first, r.behind) for r in spans.collect()} == {(i, whole.index(i), whole.index(i) + len(subtree[i])) for i in whole}
    frame = spark.createDataFrame([(i, kinds[i], texts[i]) for i in whole], "node long, kind string, text string")
    got = {r.node: r.kinds for r in builders.subtree_kinds(spans, frame, ["a", "b", "c"]).collect()}
    assert got == {i: dict(Counter(kinds[x] for x in own if kinds[x])) for i, own in subtree.items()}
    joined = "\n".join(texts[i] or "" for i in whole)
    for r in builders.subtree_texts(spans, frame).collect():
        assert joined[r.start : r.start + r.length] == "\n".join(texts[i] or "" for i in subtree[r.node])
    depth = {r.node: r.depth for r in found.collect()}
    parent = {i: p for i, p, _ in rows}
    high = {i: max(depth[x] for x in own) - depth[i] for i, own in subtree.items()}
    for r in builders.node_summary(found, spans).collect():
        own = children.get(r.node, [])
        heights = [high[c] for c in own]
        balance = (max(heights) - min(heights)) / max(heights) if heights and max(heights) else 0.0
        leaves = sum(x not in children for x in subtree[r.node])
        siblings = len(children[parent[r.node]]) - 1 if parent[r.node] is not None else 0
        assert tuple(r) == (r.node, depth[r.node], high[r.node], not own, parent[r.node] is None, len(own), len(subtree[r.node]), leaves, depth[r.node] + high[r.node], depth[r.node] + 1, siblings, round(balance, 6))
    sums = builders.subtree_sums(spans, frame, {"n": F.length("text")})
    changed = spark.createDataFrame([(7, 5), (7, 1), (33, -2)], "node long, n long")
    extra = {7: 6, 33: -2}
    want = {i: sum(len(texts[x] or "") + extra.get(x, 0) for x in own) for i, own in subtree.items()}
    assert {r.node: r.n for r in builders.with_changes(sums, found, changed, ["n"]).collect()} == want


def test_section_texts(spark):
    text = "head\n1 A\nbody\n1.1 B\nmore\n2 C\nend"
    docs = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    found = spark.createDataFrame([(1, 2, 5, 1), (1, 4, 14, 2), (1, 6, 25, 1)], "doc_id long, line_number long, start_char long, level long")
    assert {(r.line_number, r.content) for r in builders.section_texts(docs, found).collect()} == {(2, "1 A\nbody\n1.1 B\nmore\n"), (4, "1.1 B\nmore\n"), (6, "2 C\nend")}
