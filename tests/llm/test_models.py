"""Toxicity, URL rules, the language model and the pipeline."""

import itertools
import math
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from cases import ODD  # noqa: E402

import corpus_pipeline  # noqa: E402
from docloom.llm import hmm, queries, toxicity, url_filter  # noqa: E402

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def tokens(text):
    return [w for w in (text or "").translate(UPPER).translate(str.maketrans("\x0b\x0c\r\n\t", "     ")).split(" ") if w] + [None]


def brute_base(rows, held):
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return {i: (len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows}


def test_base_scores_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    want = brute_base(rows, held)
    out = queries.op8_hidden_markov(spark, SF).collect()
    assert len(out) == len(rows)
    for r in out:
        n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    mine, plain = (sum(x for r in out if r.held_out for x in [getattr(r, c)]) for c in ("score", "base_score"))
    assert mine > plain


def test_states_tell_more_than_words_alone(spark):
    """On held-out texts six states beat one, and one the base, which lacks only the shares of unseen words."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    score = lambda states: hmm.score_documents(docs, held, states=states).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    (six, base), (one, _) = score(6), score(1)
    assert six > 0.96 * one and one > 0.9 * base


def test_language_model_odd_rows(docs_of):
    out = hmm.score_documents(docs_of(ODD), F.col("doc_id") == 5, states=2, rounds=1).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in ODD)
    want = brute_base([r for k, r in enumerate(ODD) if k != 6], lambda i: i == 5)
    for r in out:
        assert r.n_tokens == want[r.doc_id][0] and math.isfinite(r.score)
    assert hmm.score_documents(docs_of([]), F.lit(False), rounds=1).count() == 0
    none = hmm.score_documents(docs_of([(1, "a b")]), F.lit(True), rounds=1).collect()
    assert none[0].n_known == 0 and none[0].train_tokens == 0 and math.isfinite(none[0].score)


def test_forward_equals_the_sum_over_paths():
    rng = np.random.default_rng(3)
    start = np.array([0.3, 0.7])
    move = np.array([[0.6, 0.4], [0.1, 0.9]])
    emit = rng.random((hmm.END + 1, 2))
    lengths, classes = np.array([3, 1, 5]), rng.integers(0, 50, 9)
    logs = hmm._forward(start, move, emit, lengths, classes)
    at = 0
    for n, got in zip(lengths, logs, strict=True):
        total = 0.0
        for path in np.ndindex(*([2] * n)):
            p = start[path[0]]
            for k in range(n):
                p *= emit[classes[at + k], path[k]] * (move[path[k - 1], path[k]] if k else 1)
            total += p
        at += n
        assert got == pytest.approx(math.log10(total))


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(4)
    lengths = np.full(40, 12)
    classes = np.concatenate([rng.integers(0, 20, 12) + (k % 2) * 20 for k in range(40)])
    prior = np.ones(hmm.END + 1) / (hmm.END + 1)
    model, seen = hmm._initial(prior, 2, 1), []
    for _ in range(6):
        logs, starts, moves, emissions = hmm._forward(*model, lengths, classes, backward=True)
        seen.append(logs.sum())
        assert starts.sum() == pytest.approx(40) and moves.sum() == pytest.approx(40 * 11) and emissions.sum() == pytest.approx(480, rel=1e-4)
        model = hmm._maximise(starts, moves, emissions, prior, weight=1e-6)
    assert seen[1:] == sorted(seen[1:]) and seen[-1] > seen[1]


def test_toxicity_held_out_accuracy(spark):
    out = queries.op10_toxicity(spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)


def test_toxicity_odd_rows(spark, docs_of):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    machine = toxicity.train(docs_of(ODD), labels)
    out = toxicity.score(docs_of(ODD), machine)
    assert out.columns == ["doc_id", "text", "lang", "mark", "n_chars", "created", "score", "predicted"]
    assert out.count() == len(ODD)
    empty = toxicity.train(docs_of([]), labels)
    assert toxicity.score(docs_of(ODD), empty).count() == len(ODD)


def test_factors_learn_what_weights_cannot():
    rng = random.Random(2)
    rows, labels = [], []
    for _ in range(3000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [1] * insult + [2] * group + [rng.randrange(10, 40) for _ in range(4)]
        rows.append(sorted(set(words)))
        labels.append(float(insult and group))
    counts = np.array([len(r) for r in rows])
    machine = toxicity.fit(counts, np.array([w for r in rows for w in r], dtype=np.uint64), np.array(labels), epochs=20)
    assert {1, 2} <= set(machine.terms.tolist())
    at = np.searchsorted(machine.terms, np.array([1, 2, 1, 2], dtype=np.uint64))
    alone_insult, alone_group = machine.scores(np.array([1, 1]), at[:2])
    both = machine.scores(np.array([2]), at[2:])[0]
    assert both > 0.7 and alone_insult < 0.3 and alone_group < 0.3


URLS = [
    (1, "https://a.b.net/x"), (2, "http://sub.example.net/en/page?x=1#f"), (3, "HTTP://Example.COM/de/"), (4, "http://example.com/en"), (5, "http://wikipedia.org/fr/a"), (6, "http://notnet/x"),
    (7, None), (8, "no scheme/here"), (9, "ftp://net"), (10, "http://net/"), (11, "http://example.net/en"), (12, "x://y.com?http://z.net/"), (13, "http://fakeexample.com/de/x"), (14, ""), (1, "https://a.b.net/x"),
]


def brute_judge(url):
    url = url or ""
    head, found, rest = url.partition("://")
    if not found:
        return "", "", None
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut].translate(UPPER), rest[cut:]
    path = tail[: min((tail.index(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [h + p for _, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumn("host", F.lit("clash"))
    out = url_filter.judge_urls(pages, queries.URL_RULES).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule) for r in out if r.page_id != 99) and len(out) == len(URLS)
    want = {i: brute_judge(u) for i, u in URLS}
    assert all((r.host, r.path, r.rule) == want[r.page_id] for r in out)
    assert {r.verdict for r in out} <= {"allow", "block"}
    assert url_filter.judge_urls(pages.limit(0), queries.URL_RULES).count() == 0


def test_url_table(spark):
    out = queries.op4_url_rules(spark, SF).collect()
    want = {r.page_id: brute_judge(r.url) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert all((r.host, r.path, r.rule) == want[r.page_id] for r in out) and len(out) == len(want)


def test_rules_do_not_hang_on_what_baskets_keep(spark):
    """Items left out of full baskets are candidates too: the same rules as with room for all, and as by brute force."""
    rng, rows = random.Random(4), []
    for _ in range(900):
        t, u = rng.random() < 0.5, rng.random() < 0.5
        bad = t and u or not t and not u and rng.random() < 0.5
        rows.append(([n for n, there in (("t", t), ("u", u)) if there] + [n for n in "vwxyz" if rng.random() < (0.8 if bad else 0.6)], "block" if bad else "allow"))
    labelled = spark.createDataFrame(rows, "url_tokens array<string>, label string")
    few, all_items = ({(tuple(r.tokens), r.verdict, round(r.confidence, 9)) for r in url_filter.mine_rules(labelled, max_items=k, min_confidence=0.8).collect()} for k in (2, 16))
    counts = Counter((s, label) for tokens, label in rows for k in (1, 2, 3) for s in itertools.combinations(sorted(tokens), k))
    share = sum(label == "block" for _, label in rows) / len(rows)
    own, want = {"block": share, "allow": 1 - share}, set()
    for (s, label), right in counts.items():
        held, p = right + counts[s, "allow" if label == "block" else "block"], own[label]
        sure = right / p / (right / p + (held - right) / (1 - p))
        if right >= 20 and sure >= 0.8 and (right - held * p) / math.sqrt(held * p * (1 - p)) >= 3:
            want.add((s, label, round(sure, 9)))
    assert few == all_items == want and (("t", "u"), "block") in {r[:2] for r in want}


def test_mined_rules_match_by_hand(spark):
    rows = [("http://spam.com/buy/a", "block")] * 30 + [("http://spam.com/news/a", "allow")] * 30 + [("http://good.org/news/b", "allow")] * 40
    asked = spark.createDataFrame([(1, "http://spam.com/buy/zzz"), (2, "http://spam.com/news/q"), (3, "http://unknown.xyz/")], "page_id long, url string")
    out = {r.page_id: r for r in url_filter.judge_urls(asked, (), spark.createDataFrame(rows, "url string, label string"), min_support=0.1).collect()}
    assert out[1].verdict == "block" and "p:buy" in out[1].mined_rule and out[1].confidence == 1.0
    assert out[2].verdict == "allow" and out[3].verdict == "allow" and out[3].mined_rule is None


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    seen = {r.doc_id for r in docs.select("doc_id").collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{LARGER}/labels.parquet").filter("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, LARGER).cache()
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= seen and len(left) == docs.count()
        if name == "toxicity":
            assert len((seen - left) & toxic) > 0.8 * len(toxic)
        seen = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, LARGER)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == seen
    assert len(seen) > 700


def brute_rules(rows, min_urls, share, confidence, most):
    """Token sets of at most so many tokens that tell a label beyond its frequency and chance, by counting every set."""
    from itertools import combinations

    sets, right = Counter(), Counter()
    for tokens, label in rows:
        for k in range(1, most + 1):
            for own in combinations(sorted(tokens), k):
                sets[own] += 1
                right[own, label] += 1
    floor = max(min_urls, share * len(rows))
    out = {}
    for (own, label), n in right.items():
        share = sum(x == label for _, x in rows) / len(rows)
        even = n / share / (n / share + (sets[own] - n) / (1 - share))
        if n >= floor and even >= confidence and (n - sets[own] * share) / (sets[own] * share * (1 - share)) ** 0.5 >= 3:
            out[own, label] = even
    return out


def test_mined_rules_equal_counting_every_set(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(600):
        tokens = {t for t in "abcdef" if rng.random() < 0.5}
        rows.append((sorted(tokens), "block" if {"a", "b"} <= tokens and rng.random() < 0.97 else "allow"))
    want = brute_rules(rows, 20, 0.002, 0.9, 3)
    found = url_filter.mine_rules(spark.createDataFrame(rows, "url_tokens array<string>, label string")).collect()
    assert {(tuple(r.tokens), r.verdict) for r in found} == set(want) and any(label == "block" for _, label in want)
    assert all(r.confidence == pytest.approx(want[tuple(r.tokens), r.verdict]) for r in found)


def test_rules_tell_more_than_a_labels_frequency(spark):
    rng = random.Random(6)
    rows = [([f"t{rng.randrange(4)}", f"u{rng.randrange(3)}"], "allow" if rng.random() < 0.93 else "block") for _ in range(2000)]
    assert url_filter.mine_rules(spark.createDataFrame(rows, "url_tokens array<string>, label string")).count() == 0


def test_long_fixed_paths_are_one_item(spark):
    rows = [([f"p{k}" for k in range(40)], "block")] * 50 + [([f"q{k % 7}", f"r{k % 5}"], "allow") for k in range(100)]
    found = url_filter.mine_rules(spark.createDataFrame(rows, "url_tokens array<string>, label string"), min_support=0.1).collect()
    assert [(len(r.tokens), r.confidence) for r in found if r.verdict == "block"] == [(40, 1.0)]


def test_content_labels(spark):
    plain = "a page with quite a few different words so that it has something to say to its many readers of today and tomorrow"
    pages = [(1, f"<p>{plain}</p>"), (2, "<p>few words</p><script>" + plain + "</script>"), (3, "BUY NOWW!! CHEAP!! PILLS!! " * 10), (4, "again and " * 30), (5, None)]
    out = url_filter.content_labels(spark.createDataFrame([(f"http://h/{i}", h) for i, h in pages], "url string, html string")).collect()
    assert [r.label for r in out] == ["allow", "block", "block", "block", "block"]


def test_words_that_speak_only_in_pairs(spark):
    """Toxic if an insult meets a group; both words are neutral alone, as so many texts without either are toxic that 0.3 of all texts and of those with either word are. Held-out texts of the same making."""
    rng = random.Random(9)
    rows, labels, kinds = [], [], {}
    for i in range(4000):
        insult, group = rng.random() < 0.3, rng.random() < 0.3
        toxic = insult and group or (not insult and not group and rng.random() < 0.4286)
        words = ["insult"] * insult + ["group"] * group + [f"w{rng.randrange(200)}" for _ in range(12)]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
        kinds[i] = insult + group
    share = lambda k: sum(y for i, y in labels if kinds[i] == k) / sum(n == k for n in kinds.values())
    assert share(1) == 0 and share(2) == 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    machine = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") < 3000)
    out = [(kinds[r.doc_id], r.predicted) for r in toxicity.score(docs.filter("doc_id >= 3000"), machine).collect()]
    assert np.mean([p for k, p in out if k == 2]) > 0.9 and np.mean([p for k, p in out if k == 1]) < 0.1
