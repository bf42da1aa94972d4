"""Near-dedup, decontamination and fingerprints against plain versions."""

import hashlib
import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from cases import ODD  # noqa: E402

from docloom.llm import components, decontamination, fingerprints, near_dedup, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def bag(text):
    w = (text or "").translate(UPPER).split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def similarity(a, b):
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 1.0


def brute_classes(rows, threshold=0.8):
    texts = sorted({t or "" for _, t in rows})
    bags = [bag(t) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= threshold:
                root[top(i)] = top(j)
    groups = defaultdict(list)
    at = {t: i for i, t in enumerate(texts)}
    for i, t in rows:
        groups[top(at[t or ""])].append(i)
    out = Counter()
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        for i in ids:
            out[i, min(known, default=None), len(ids)] += 1
    return out


def variants(seed=1, groups=6, size=9, words=80):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for k in range(size):
            if k % 3 == 0:  # a chain: each differs a little from the one before
                base = list(base)
                base[rng.randrange(words)] = rng.choice(vocabulary)
            text = list(base)
            if k % 3 == 2:
                text[rng.randrange(words)] = "other"
            rows.append((g * 100 + k, " ".join(text)))
    return rows


def test_near_classes_equal_brute_force(docs_of):
    rows = variants() + [(i, t) for i, t in ODD if i != 9] + [(900, "Short text"), (901, "short TEXT"), (902, "short text")]
    got = Counter((r.doc_id, r.class_id, r.n_docs) for r in near_dedup.near_classes(docs_of(rows)).collect())
    assert got == brute_classes(rows)


def test_near_classes_in_small_blocks(docs_of):
    rows = variants(2, groups=2, size=30)
    got = Counter((r.doc_id, r.class_id, r.n_docs) for r in near_dedup.near_classes(docs_of(rows), block_rows=7).collect())
    assert got == brute_classes(rows)


def test_keep_one(docs_of):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (None, "x y z"), (5, "x y z")]
    kept = near_dedup.keep_one(docs_of(rows))
    assert kept.columns == ["doc_id", "text", "lang", "mark", "score", "n_chars", "created"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5]
    assert near_dedup.near_classes(docs_of([])).count() == 0


def test_whole_table_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = Counter((r.doc_id, r.class_id, r.n_docs) for r in queries.op7_bag_minhash(spark, SF).collect())
    assert got == brute_classes(rows)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    elements = np.sort(rng.integers(1, 1 << 62, 60).astype(np.uint64))
    a, b = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    found = near_dedup.bag_minhash(np.concatenate((elements, elements)), np.array([60, 60]), np.concatenate((a, b)), components=6000)
    assert (found[0] == found[1]).mean() == pytest.approx(want, abs=0.03)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(60)] + [(7, 7), (500, 400)]
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: top(i) for i in root}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


ITEM = "If Anna Miller has 12 apples and gives 5 apples to Peter then how many apples does Anna Miller keep after 12 days of walking home"


def test_decontamination(spark, docs_of):
    benchmark = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (None, ITEM), (4, "12 13 14 15 16 17 18")], "item_id long, text string")
    other = ITEM.replace("Anna Miller", "Maria Stone").replace("12", "40").replace("5", "9").replace("Peter", "Paul")
    mixed = ITEM.replace("has 12", "has 40").replace("after 12", "after 41")  # one value stands for two
    filler = "nothing of this is in any benchmark at all so it stays clean whatever it says "
    rows = [(10, filler + ITEM), (11, filler * 3 + other + " " + filler), (12, filler), (13, filler + mixed), (14, " ".join(reversed(ITEM.split()))), (15, None), (16, ""), (17, "12 13 14 15 16 17 18"), (18, filler + ITEM.upper()), (10, filler + ITEM)]
    found = {r.doc_id: r for r in decontamination.find_contaminated(docs_of(rows), benchmark).collect()}
    assert {10, 11} <= set(found) <= {10, 11, 18}
    assert found[10].item_id == 1 and found[10].changed_slots == 0 and found[11].changed_slots == 5
    assert decontamination.find_contaminated(docs_of([]), benchmark).count() == 0
    assert decontamination.find_contaminated(docs_of(rows), benchmark.filter("item_id > 99")).count() == 0


def test_decontamination_finds_items_literally(spark, docs_of):
    benchmark = spark.createDataFrame([(1, ITEM), (2, "Compute 12 + 7 * 3 - 4"), (3, "Name seven prime numbers"), (4, "12 13 14 15 16 17 18"), (5, "How far is it from Rome to Bari by the old road if 3 trains and 5 buses go there each day")], "item_id long, text string")
    filler = "nothing of this is in any benchmark at all so it stays clean whatever it says "
    rows = [
        (1, filler + "Compute 12 + 7 * 3 - 4 " + filler), (2, filler + "please name seven prime numbers. " + filler), (3, filler + ITEM.upper() + " " + filler),
        (4, filler + ITEM.replace("12 apples", "13 apples") + " " + filler), (5, filler + "how far is it from Rome to Bari by the old road if 4 trains and 4 buses go there each day " + filler),
        (6, filler + "Compute 12 + 7 * 3 - 5 name seven prime " + filler), (7, "12 13 14 15 16 17 18 " + filler),
    ]
    found = {(r.doc_id, r.item_id): r for r in decontamination.find_contaminated(docs_of(rows), benchmark).collect()}
    assert set(found) == {(1, 2), (2, 3), (3, 1), (4, 1), (5, 5)}
    assert found[1, 2].coverage == found[2, 3].coverage == 1.0 and found[5, 5].changed_slots == 2


def test_decontamination_of_items_rich_in_placeholders(spark, docs_of):
    benchmark = spark.createDataFrame([(1, "Compute 12 + 7 * 3 - 4 + 9 / 2"), (2, "Add 3 kg and 5 kg to 9 kg"), (3, "Rome"), (4, "Is Rome")], "item_id long, text string")
    filler = "nothing of this is in any benchmark at all so it stays clean whatever it says "
    rows = [
        (1, filler + "Compute 15 + 8 * 2 - 6 + 1 / 3 " + filler), (2, "Add 4 kg and 6 kg to 8 kg"), (3, filler + "all roads lead to Rome and so is Rome " + filler), (4, " rome. "), (5, "Compute 12 + 12 * 3 - 4 + 9 / 2"),
        (6, filler + "Measure 15 + 8 * 2 - 6 + 1 / 3"), (7, "Add 4 kg and 6 lb of 8 kg"), (8, "compute 1 2 3 four"), (9, "is Rome"),
    ]
    found = {(r.doc_id, r.item_id): r.changed_slots for r in decontamination.find_contaminated(docs_of(rows), benchmark).collect()}
    assert found == {(1, 1): 6, (2, 2): 3, (4, 3): 0, (5, 1): 1, (9, 4): 0}


def test_verbatim_leaks_in_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs for i, x in items if x in (t or "")}
    got = {(r.doc_id, r.item_id) for r in queries.op3_template_decontamination(spark, SF).collect()}
    assert want <= got
    words = {i: x.split() for i, x in items}
    for d, i in got - want:  # whatever else is found shares most five-word runs
        text = " ".join(dict(docs)[d].split())
        runs = [" ".join(words[i][k : k + 5]) for k in range(len(words[i]) - 4)]
        assert sum(r in text for r in runs) >= 0.4 * len(runs)


def test_templates():
    counts, own, kind, codes, words = decontamination.templates(pa.array(["It was 5 kg. Then John Smith paid", None, "5 kg"]))
    assert counts.tolist() == [8, 0, 2]
    assert kind.tolist() == [0, 0, 1, 3, 0, 2, 2, 0, 1, 3]
    assert own[2] == own[-2] and own[3] == own[-1]


def brute_edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out[i] = (len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())
    return out


def test_fingerprints(docs_of):
    rows = [r for k, r in enumerate(ODD) if k != 6]  # without the repeated row
    out = {r.doc_id: r for r in fingerprints.compare_edited(docs_of(rows)).collect()}
    want = brute_edited(rows)
    assert {i: (r.n_chars, r.edited_sha256) for i, r in out.items()} == want
    assert out[3].fingerprint == out[4].fingerprint and out[3].near_next == 1.0
    assert out[1].fingerprint == out[2].fingerprint == ""
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out.values())
    assert fingerprints.compare_edited(docs_of(ODD)).count() == len(ODD)
    assert fingerprints.compare_edited(docs_of([])).count() == 0
    single = fingerprints.compare_edited(docs_of([(1, "one two three four")])).collect()
    assert len(single) == 1 and single[0].near_next == 1.0
    same = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint_documents(docs_of(rows)).collect()}
    assert same == {i: r.fingerprint for i, r in out.items()}


def test_fingerprints_follow_edits_and_order(spark):
    rng = random.Random(9)
    base = [rng.choice([f"word{i}" for i in range(3000)]) for _ in range(400)]
    few = list(base)
    for at in rng.sample(range(400), 4):
        few[at] = "changed"
    swapped = base[200:] + base[:200]
    many = [w if rng.random() < 0.5 else "changed" + w for w in base]
    rows = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate((base, few, swapped, many))], "k long, text string")
    pairs = {r.k: set(r.pairs) for r in fingerprints.order_minhash(rows, ["k"], "text").collect()}
    like = [len(pairs[0] & pairs[k]) / len(pairs[0] | pairs[k]) for k in range(4)]
    assert like[0] == 1.0 and like[1] > 0.75 and like[3] < 0.2
    assert like[2] < 0.85 * like[0] and like[2] < like[1]  # the same words in another order


def test_fingerprints_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = {r.doc_id: r for r in queries.op1_order_minhash(spark, SF).collect()}
    assert {i: (r.n_chars, r.edited_sha256) for i, r in out.items()} == brute_edited(rows)
    by = defaultdict(set)
    for i, t in rows:
        by[t or ""].add(out[i].fingerprint)
    assert all(len(x) == 1 for x in by.values())


def textbook_likeness(a, b, sketches=64):
    """Order MinHash as published: for each sketch the two least occurrence-numbered k-mers under its own hash, in text order."""
    import xxhash

    def marks(words):
        seen, elements = Counter(), []
        for at in range(len(words)):
            kmer = tuple(words[at : at + 3])
            seen[kmer] += 1
            elements.append((repr((kmer, seen[kmer])), at))
        out = []
        for j in range(sketches):
            least = sorted(elements, key=lambda e: xxhash.xxh64_intdigest(e[0], j))[:2]
            out.append(tuple(e[0] for e in sorted(least, key=lambda e: e[1])))
        return out

    return sum(x == y for x, y in zip(marks(a), marks(b), strict=True)) / sketches


@pytest.mark.parametrize("n_words", [20, 50, 100, 400])
def test_order_likeness_is_near_the_textbook_one(spark, n_words):
    """Texts against themselves with their halves swapped, and with a word in ten changed."""
    rng = random.Random(n_words)
    rows, want = [], {"swapped": [], "changed": []}
    for i in range(24):
        words = [f"w{rng.randrange(3000)}" for _ in range(n_words)]
        swapped = words[n_words // 2 :] + words[: n_words // 2]
        changed = [w if rng.random() > 0.1 else f"x{k}" for k, w in enumerate(words)]
        rows += [(i, "own", " ".join(words)), (i, "swapped", " ".join(swapped)), (i, "changed", " ".join(changed))]
        want["swapped"].append(textbook_likeness(words, swapped))
        want["changed"].append(textbook_likeness(words, changed))
    marks = fingerprints.order_minhash(spark.createDataFrame(rows, "i int, kind string, text string"), ["i", "kind"], "text").cache()
    own = marks.filter("kind = 'own'").select("i", F.col("pairs").alias("own"))
    got = {r.kind: r.near for r in marks.join(own, "i").groupBy("kind").agg(F.avg(fingerprints.likeness(F.col("own"), F.col("pairs"))).alias("near")).collect()}
    assert got["own"] == 1.0
    for kind, each in want.items():
        assert got[kind] == pytest.approx(sum(each) / len(each), abs=0.1)
