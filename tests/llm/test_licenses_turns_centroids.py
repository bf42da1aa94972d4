"""License scan, conversation repair and centroid clustering against plain versions."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from cases import ODD  # noqa: E402

from docloom.llm import centroids, conversation_repair, license_scan, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


# License scan


def brute_scan(text, rarities):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    spaced = lambda a, b: " " + " ".join(words[max(0, a) : max(0, b)]) + " "
    base = [(i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    labels, score = {x for _, x in base}, 0.5 if base else 0.0
    for (label, text, phrases), own in zip(license_scan.TEMPLATES, license_scan.rare_places(rarities), strict=True):
        template, index = text.split(), dict(own)
        meets = sorted((i - index[w], index[w]) for i, w in enumerate(words) if w in index)
        for k, (d, _) in enumerate(meets):
            share = len({p for e, p in meets[k : k + 2 * license_scan.RARE] if e - d <= license_scan.SLACK}) / len(own)
            if share < 0.5:
                continue
            sure = True
            for phrase in phrases:
                at = next(j for j in range(len(template)) if template[j : j + len(phrase.split())] == phrase.split())
                low = max(0, d + at - license_scan.SLACK)
                sure &= f" {phrase} " in spaced(low, d + at + 2 * license_scan.SLACK + len(phrase.split()))
            labels |= {label} if sure else set()
            score = max(score, share if sure else share / 2)
    starts = [i for i, _ in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(score, 9)


def scanned(frame):
    return Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in frame.collect())


LICENSED = [
    (20, "Licensed under the Apache License, Version 2.0."), (21, "RELEASED under the mit license; mit dem Hund, der Apache sah"),
    (22, "This work is licensed under the GNU General Public License, version 3. All  rights-reserved CC-BY cc by"),
    (23, "Licensed under CC BY-NC 4.0."), (24, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (25, "the license of the version is under a licensed apache public general gnu"), (26, "licKense mit license caKe"), (27, "cc by " * 3000),
    (28, "gnu lesser general public license " * 500), (29, "all\nrights\nreserved"),
]


def test_scan_odd_rows(docs_of):
    docs = docs_of(ODD + LICENSED)
    rarities = license_scan.rarity(docs)
    out = license_scan.scan(docs, rarities)
    assert out.columns[:6] == ["doc_id", "text", "lang", "mark", "n_chars", "created"]  # the input's own score gives way
    assert scanned(out) == Counter((i, *brute_scan(t, rarities)) for i, t in ODD + LICENSED)
    labels = {r.doc_id: r.labels for r in out.filter("doc_id >= 20").collect()}
    assert labels[20] == "apache-2.0" and labels[21] == "mit" and labels[22] == "cc-by,gpl,gpl-3.0,reserved" and labels[23] == "cc-by,cc-by-nc" and labels[24] == "mit" and labels[25] == "" and labels[28] == "gpl,lgpl"


def test_scan_of_no_rows(docs_of):
    assert license_scan.scan_documents(docs_of([])).count() == 0


def test_scan_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rarities = license_scan.rarity(docs)
    held = defaultdict(int)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for _, t in rows:
        for w in set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))):
            held[w] += 1
    assert all(abs(x - np.log((1 + len(rows)) / (1 + held[w]))) < 1e-12 for w, x in rarities.items())
    assert scanned(queries.op11_license_scan(spark, SF)) == Counter((i, *brute_scan(t, rarities)) for i, t in rows)


# Conversation repair


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, z = " " if role is None else role, " " if text is None else text, zlib.crc32(name.encode()) % 20
        text = "" if z == 1 else re.sub("[.!?]", "", text) if z == 2 else text
        out += [(conv, turn, "user" if z == 4 else role, text)] * (0 if z == 0 else 2 if z == 3 else 1)
    return out


def brute_repair(rows):
    """All ways of edits, compared as (cost, audit): one row of results from (turn, role, text) in order."""
    seen, faults, n = set(), [], len(rows)
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, last, inserted):
        ways = [(0, "", ())] if i == n and last in ("", "a") else []
        if inserted < 3:
            for x, name in (("u", "user"), ("a", "assistant")):
                if x in follow[last]:
                    c, a, t = best(i, x, inserted + 1)
                    ways.append((c + 2, "I" + a, (f"{name}:", *t)))
        if i < n:
            _, role, text = rows[i]
            c, a, t = best(i + 1, last, 0)
            ways.append((c + 3, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                for x, name in (("u", "user"), ("a", "assistant")):
                    if x in follow[last]:
                        c, a, t = best(i + 1, x, 0)
                        ways.append((c + 2 + cut, "R" + a, (f"{name}:{text}", *t)))
                if role[:1] and role[0] in follow[last]:
                    c, a, t = best(i + 1, role[0], 0)
                    ways.append((c + cut, "K" + a, (f"{role}:{text}", *t)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, turns = best(0, "", 0)
    known = {t for t, _, _ in rows if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()


def repaired(frame):
    return Counter((r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame.collect())


def brute_repair_all(rows, ids):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role, text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return Counter((c, *brute_repair(sorted(by[c], key=order))) for c in ids)


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int")


def random_rows(seed, n, convs):
    rnd = random.Random(seed)
    pick = lambda: (rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "User"]), rnd.choice(["", " \t", "yes.", "no", "Why?", "é ", "well! \n"]) + str(rnd.randrange(40)) * rnd.randrange(2))
    return [(rnd.randrange(convs), i // 2 if i % 7 else i, *pick()) for i in range(n)]


def test_repair_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "a"), (1, None, "user", "a"), (1, 5, "assistant", ""), (2, 3, "system", "Be kind."), (3, 1, "user", "x" * 300_000), (4, 1, "user", "Hi."), (4, 2, "assistant", "Hi."), (4, 2, "assistant", "Hi."), (4, 9, "user", "why\nnot? ")]
    frame = frame_of(spark, rows)
    assert repaired(conversation_repair.repair(frame)) == brute_repair_all([(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows], {r[0] for r in rows})
    assert repaired(conversation_repair.repair_all(frame, conversation_repair.damage(frame))) == brute_repair_all(brute_damage(rows), {r[0] for r in rows})
    assert conversation_repair.repair(frame.limit(0)).count() == 0


def test_repair_conversations_cut_anywhere(spark):
    # One conversation has most rows; ranges of a few rows cut it, and others, into many pieces.
    rows = [(c if c % 4 == 0 else 77, t, r, f"{x}{i % 23}") for i, (c, t, r, x) in enumerate(random_rows(3, 600, 12))]
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
    sys.setrecursionlimit(20_000)
    want = brute_repair_all(rows, {r[0] for r in rows})
    for ranges in (1, 7, 60):
        assert repaired(conversation_repair.repair(frame_of(spark, rows).coalesce(1), least_ranges=ranges)) == want


def test_repair_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert repaired(queries.op12_conversation_repair(spark, SF)) == brute_repair_all(brute_damage(rows), {r[0] for r in rows})


@settings(deadline=None, max_examples=150)
@given(st.lists(st.tuples(st.none() | st.integers(0, 5), st.sampled_from(["system", "user", "assistant", "x", ""]), st.sampled_from(["", "a", "a.", "b!", " "])), max_size=8))
def test_repair_one_conversation(rows):
    got = conversation_repair._whole(1, *[[r[k] for r in rows] for k in range(3)])
    assert tuple(got[x] for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) == brute_repair(rows)


# Centroid clustering


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    mark = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    centres = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        centres = [[sum(x) // len(x) for x in zip(*own[n], strict=True)] if n in own else c for n, c in enumerate(centres)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    by = Counter()
    for _, n, d in found:
        by[n] += d
    return Counter((i, n, d, by[n], sum(by.values()), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, n, d in found)


def test_clusters_odd_rows(spark):
    rnd = np.random.default_rng(5)
    v = lambda scale: [float(x) for x in np.float32(rnd.normal(size=64) * scale)]
    same = v(1)
    rows = [(i, v(1)) for i in range(60)] + [(i, same) for i in range(100, 140)] + [(7, v(1)), (7, v(1)), (7, same), (None, v(1)), (None, None), (200, None), (201, []), (202, same[:63]), (203, same + [0.0]), (204, [None] + same[1:]), (205, [float("nan")] + same[1:]), (206, [float("inf")] + same[1:]), (207, [0.0] * 64), (208, [-0.0] * 64)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, cluster int, distance int").repartition(5)
    assert Counter(map(tuple, centroids.cluster_vectors(frame).collect())) == brute_clusters(rows)
    few = rows[:5]
    assert Counter(map(tuple, centroids.cluster_vectors(frame.filter("vec_id < 5")).collect())) == brute_clusters(few)
    assert centroids.cluster_vectors(frame.filter("vec_id = 202")).collect() == []


def test_clusters_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert Counter(map(tuple, queries.op13_centroid_clusters(spark, SF).collect())) == brute_clusters(rows)


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 7, 300, 1 << 20, 1 << 26, 1 << 28, 1 << 45, 1 << 62]))
def test_nearest_is_exact(seed, size):
    rnd = np.random.default_rng(seed)
    c = rnd.integers(-size, size + 1, size=(9, 64))
    c[5] = c[2]
    c[6] = c[2] + (np.arange(64) == 3)
    v = np.concatenate([c, (c[:4] + c[4:8]) // 2, rnd.integers(-size, size + 1, size=(6, 64)), c[2:3] + rnd.integers(-2, 3, size=(8, 64))])
    best, distance = centroids.nearest(v, c)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)), k) for k, y in enumerate(c)) for x in v]
    assert [(int(d), int(k)) for d, k in zip(distance, best, strict=True)] == want


def test_screening_decides_most_rows():
    rnd = np.random.default_rng(1)
    c, v = rnd.integers(-20, 20, size=(16, 64)), rnd.integers(-20, 20, size=(2000, 64))
    low, high = centroids.intervals(v, c)
    assert ((low <= high.min(axis=1, keepdims=True)).sum(axis=1) == 1).mean() > 0.95
