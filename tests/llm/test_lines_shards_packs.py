"""Line dedup, sharding, packing and training order against plain versions."""

import hashlib
import sys
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from cases import ODD  # noqa: E402

from docloom.llm import line_dedup, materialisation, packing, queries, sharding, tokens  # noqa: E402

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute_lines(rows, min_chars=20, min_docs=3):
    order = lambda i: (i is not None, i or 0)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)], key=order) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_line_dedup_odd_rows(docs_of):
    out = line_dedup.dedup_lines(docs_of(ODD))
    assert out.columns == ["doc_id", "text", "lang", "mark", "score", "n_chars", "created", "n_lines", "n_dropped"]
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()) == brute_lines(ODD)


def test_line_dedup_hot_shards(docs_of):
    rows = [(i, f"a line that nearly all of them hold\nown line number {i} of this document") for i in range(300)]
    lost = line_dedup.repeated_lines(docs_of(rows).withColumn("__mark", __import__("pyspark").sql.functions.xxhash64("text")), shard_probes=40)
    assert sorted(r.doc_id for r in lost.collect()) == list(range(299))


def test_line_dedup_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = Counter((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for (i, n, d, t) in brute_lines(rows))
    assert Counter(map(tuple, queries.op2_line_dedup(spark, SF).collect())) == want


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(min_value=-(2**62), max_value=2**62), unique=True, max_size=400))
def test_minimal_perfect_hash(keys):
    h1 = np.array(keys, dtype=np.int64)
    h2 = h1 * 31 + 7
    index, levels = line_dedup.build_mph(h1, h2)
    assert sorted(index.tolist()) == list(range(len(keys)))
    assert (line_dedup.probe_mph(levels, h1, h2) == index).all()


@pytest.mark.parametrize("copies", [0, 2000])
def test_sharding(docs_of, copies):
    rows = [(i, "x" * (i * 37 % 500) + str(i)) for i in range(1500)] + [(10_000 + i, "the same text in many rows") for i in range(copies)] + ODD
    out = sharding.shard_rows(docs_of(rows), shards=8).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    assert all(r.size == len((r.text or "").encode()) + 1 for r in out)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    assert set(by) <= set(range(8))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    long = 150_001  # the one long text cannot be cut
    sizes = [sum(r.size for r in by[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= long + 0.01 * sum(sizes)


def test_ranges_are_as_small_as_asked(spark):
    keys = spark.range(40_000).selectExpr("xxhash64(id) AS __h", "id AS __i", "10L AS __size")
    cuts = sharding.find_splitters(keys, 8 * 64, sharding.RANGE_TOLERANCE)
    rows = sorted((r[0], r[1]) for r in keys.select("__h", "__i").collect())
    at = [0, *[bisect_left(rows, c) for c in cuts], len(rows)]
    assert len(set(cuts)) == 511 and max(b - a for a, b in zip(at, at[1:], strict=False)) <= 1.5 * 40_000 / 512 + 1


def test_many_lost_lines_cost_no_square(docs_of):
    lines = "\n".join(f"a line that all of them hold, number {k}" for k in range(60_000))
    out = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs_of([(i, lines + f"\nown line {i}") for i in range(3)])).collect()}
    assert out == {0: (60_001, 60_000, "own line 0"), 1: (60_001, 60_000, "own line 1"), 2: (60_001, 0, lines + "\nown line 2")}


def test_sharding_of_nothing(docs_of):
    assert sharding.shard_rows(docs_of([])).count() == 0


def test_pack_histogram_places_everything():
    histogram = {7: 5, 3: 11, 2: 4, 1: 1, 8: 2}
    patterns = packing.pack_histogram(histogram, 8)
    used = Counter()
    for pattern, count in patterns:
        assert sum(pattern) <= 8 and count > 0
        for length in pattern:
            used[length] += count
    assert used == histogram


def brute_ids(text, end_id=1):
    found = tokens.encoder(tokens.default_path()).tokenizer.encode(text or "", add_special_tokens=False).ids
    return [*found, end_id]


def check_packs(out, rows, capacity):
    want = Counter()
    for i, t in rows:
        ids = brute_ids(t)
        for start in range(0, len(ids), capacity):
            piece = ids[start : start + capacity]
            want[i, start, len(piece), zlib.crc32(np.array(piece, dtype="<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_packing_odd_rows(docs_of):
    check_packs(packing.pack(docs_of(ODD), capacity=64).collect(), ODD, 64)
    assert packing.pack(docs_of([])).count() == 0


def test_packing_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    packs = check_packs(queries.op9_packed_sequences(spark, SF).collect(), rows, 2048)
    filled = sum(n for own in packs.values() for _, n in own)
    assert filled / (2048 * len(packs)) > 0.97


def test_word_encoder_equals_the_tokenizer():
    import random

    import pyarrow as pa

    rng = random.Random(3)
    odd = ["", None, "can't don'tx it's, o'clock's 'twas", "éa, É. ÅB", "a\xa0b　c", "x%,y %,", "<|endoftext|>a", "İstanbul İ.", "a\x1cd\x85e", "́ a ́b, ≠ a≠"]
    odd += ["".join(rng.choice("aB's,.té́ \n9<|̸İ ") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    encoder = tokens.WordEncoder(tokens.default_path())
    counts, ids = encoder.encode(pa.array(odd, pa.string()))
    at = 0
    for text, n in zip(odd, counts, strict=True):
        assert ids[at : at + n].tolist() == brute_ids(text)[:-1]
        at += n


def test_encoder_equals_a_fresh_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokens.default_path())
    odd = ["x <|startoftext|> <|endoftext|>", "a<|endoftext|>b", "<|EndOfText|> c", None, "", "plain words, 12,5 kg", "<|endoftext|>" * 3, "word " * 3000 + "<|endoftext|>"]
    counts, ids = tokens.WordEncoder(tokens.default_path()).encode(pa.array(odd, pa.string()))
    want = [fresh.encode(t or "", add_special_tokens=False).ids for t in odd]
    assert want[0] == [343, 49406, 49407]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("histogram", [{100: 1000}, {700: 10, 100: 1000}, {1: 5000}, {2048: 3, 1: 1}, {1025: 7, 1023: 7}])
def test_equal_lengths_share_packs(histogram):
    patterns = packing.pack_histogram(histogram, 2048)
    ideal = -(-sum(k * n for k, n in histogram.items()) // 2048)
    assert sum(n for _, n in patterns) <= 1.05 * ideal + 1


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=12))
def test_pack_histogram_equals_one_piece_at_a_time(histogram):
    """Shortest-pack-first by hand: each piece goes on the pack with the fewest ids, or opens one."""
    packs = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            at = min(range(len(packs)), key=packs.__getitem__, default=None)
            if at is None or packs[at] + length > 64:
                packs.append(length)
            else:
                packs[at] += length
    patterns = packing.pack_histogram(histogram, 64)
    assert sorted(f for p, n in patterns for f in [sum(p)] * n) == sorted(packs)
    assert Counter({k: sum(p.count(k) * n for p, n in patterns) for k in histogram}) == histogram


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64, 1000])
def test_feistel_permutes(size):
    assert sorted(materialisation.feistel(np.arange(size), size, 5).tolist()) == list(range(size))


def test_training_order_round_trip(spark, docs_of, tmp_path):
    out = materialisation.training_order(docs_of(ODD), stride=16, shard_rows=64)
    rows = sorted(out.collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows)))
    assert sorted(r.sequence for r in rows) == list(range(len(rows)))
    assert all(r.byte_offset == r.slot % 64 * 64 and r.shard == r.slot // 64 for r in rows)
    want = Counter()
    for i, t in ODD:
        ids = brute_ids(t)
        for k in range(0, len(ids), 16):
            piece = ids[k : k + 16]
            blob = np.array(piece + [0] * (16 - len(piece)), dtype="<u4").tobytes()
            want[i, k // 16, len(piece), blob, zlib.crc32(blob)] += 1
    assert Counter((r.doc_id, r.piece, r.n_tokens, bytes(r.ids), r.ids_crc32) for r in rows) == want
    materialisation.write_shards(out, str(tmp_path / "shards"), shard_rows=64, block_rows=32)
    got = materialisation.read_slots(spark, str(tmp_path / "shards"), 50, 90, stride=16, block_rows=32)
    assert [x.tobytes() for x in got] == [bytes(r.ids) for r in rows[50:140]]
    assert materialisation.training_order(docs_of([])).count() == 0


def test_training_order_query_is_read_from_written_shards(spark, docs_of, tmp_path):
    rows = materialisation.training_order(docs_of(ODD), stride=16, shard_rows=64).drop("ids").collect()
    found = materialisation.materialised_order(docs_of(ODD), stride=16, shard_rows=64, block_rows=32)
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, rows))
    assert found.columns == rows[0].__fields__
    out = queries.op6_training_order(spark, SF)
    files = out.inputFiles()
    assert files and all("shards-" in f for f in files)
    own = {r.slot: r for r in out.collect()}
    blocks = spark.read.parquet(*files).select("block", "shard", "data").collect()
    assert sum(len(b.data) for b in blocks) == 2048 * len(own)
    for b in blocks:
        for i in range(len(b.data) // 2048):
            r = own[b.block * 512 + i]
            assert (r.shard, r.byte_offset, r.ids_crc32) == (b.shard, r.shard_row * 2048, zlib.crc32(b.data[i * 2048 : (i + 1) * 2048]))
    assert materialisation.materialised_order(docs_of([])).count() == 0
