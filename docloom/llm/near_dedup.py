"""Near-duplicate documents by weighted Jaccard similarity of their five-word shingles.

BagMinHash signatures: every shingle with its count is a bar of that height; the bar is cut into cells of doubling height, and each cell runs a Poisson process whose points take a component and a height. A component keeps the earliest point below a bar, so two texts agree in a component with the probability of their weighted Jaccard similarity.
Bands of the signature bring candidates together. Candidates are dealt into blocks of bounded size, each pair of blocks meets in one task, and the multisets of shingles decide. A class is what links of enough similarity connect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialise, mix, slices, windows, word_codes, word_hashes
from docloom.llm.components import connected_components

SHINGLE, BANDS, ROWS = 5, 30, 5
COMPONENTS = BANDS * ROWS
#: Rows handled at once, so that a row's number fits beside the bits of a shingle's hash.
ROW_BITS = 13


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts (in order of text and hash), how many each text has, and the count of each.

    Words lie between ASCII white space, A-Z lower-cased. A text under five words is one shingle, an empty one has none.
    """
    counts, codes, words = word_codes(texts)
    hashes, n = windows(word_hashes(words)[codes], counts, SHINGLE)
    row = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    keys = np.sort((row << np.uint64(64 - ROW_BITS)) | (hashes >> np.uint64(ROW_BITS)))
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(first)
    weights = np.diff(np.append(starts, len(keys)))
    keys = keys[starts]
    row = (keys >> np.uint64(64 - ROW_BITS)).astype(np.int64)
    return keys << np.uint64(ROW_BITS), np.bincount(row, minlength=len(n)), weights


def bag_minhash(elements: np.ndarray, counts: np.ndarray, weights: np.ndarray, components: int = COMPONENTS) -> np.ndarray:
    """Signatures (a row each) of bags given as elements with whole weights; a row without elements is all ones.

    Heights are whole numbers, cut into the cells [0, 1), [1, 2), [2, 4), [4, 8) and so on. A cell that a bar fills partly keeps the points below the bar's top.
    The processes advance together: a process goes on while its next point comes before the last of its row's components is filled for good.
    """
    row = np.repeat(np.arange(len(counts)), counts)
    levels = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64), 0) + 1
    of = np.repeat(np.arange(len(elements)), levels)
    cell = np.arange(len(of)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(cell == 0, 0, 2.0 ** (cell - 1))
    height = np.where(cell == 0, 1.0, low)
    inside = np.minimum((weights[of] - low) / height, 1.0)
    seed, row = mix(elements[of] ^ mix(cell.astype(np.uint64), 5), 6), row[of]
    rate = components * height
    best = np.full(len(counts) * components, np.inf)
    x, live, step = np.zeros(len(of)), np.arange(len(of)), 0
    unit = 1.0 / (1 << 53)
    while len(live):
        step += 1
        with np.errstate(over="ignore"):
            own = mix(seed[live] + np.uint64(step) * np.uint64(0x9E3779B97F4A7C15), 7)
        x[live] -= np.log1p(-(own >> np.uint64(11)).astype(np.float64) * unit) / rate[live]
        last = best.reshape(-1, components).max(axis=1)
        early = x[live] < last[row[live]]
        live, own = live[early], own[early]
        mark = mix(own, 8)
        below = (mark >> np.uint64(32)).astype(np.float64) / (1 << 32) < inside[live]
        place = row[live] * components + (mark & np.uint64(0xFFFFFFFF)).astype(np.int64) % components
        np.minimum.at(best, place[below], x[live][below])
    bits = mix(best.view(np.uint64), 9).astype(np.uint32).reshape(-1, components)
    bits[counts == 0] = 0xFFFFFFFF
    return bits


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row and band."""
    out = np.zeros((len(signatures), BANDS), dtype=np.uint64)
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r], 10)
        return mix(out + np.arange(BANDS, dtype=np.uint64), 11)


def identity() -> list[Column]:
    """What tells texts apart: two hashes and the length."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"), F.octet_length(text).alias("size")]


ID = ["h1", "h2", "size"]


def signatures(docs: DataFrame) -> DataFrame:
    """Signatures of rows with doc_id, h1, h2, size and text: all but the text, the signature's bytes and its band keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    kept = ["doc_id", *ID]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=2 << 20):
            for at in range(0, part.num_rows, 1 << ROW_BITS):
                batch = part.slice(at, 1 << ROW_BITS)
                elements, counts, weights = shingles(batch["text"])
                found = bag_minhash(elements, counts, weights)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(found).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array([s.tobytes() for s in found], pa.binary()), keys], names=[*kept, "signature", "bands"])

    return docs.select(*kept, "text").mapInArrow(sign, f"doc_id {kind}, h1 long, h2 int, size int, signature binary, bands array<long>")


def link_block(own: np.ndarray, found: np.ndarray, side: np.ndarray | None, bags, threshold: float) -> list[tuple[int, int]]:
    """Links that connect all rows of a block which candidates of enough similarity connect.

    ``own`` are the nodes, ``found`` their signatures; with ``side``, only pairs across the two sides count. ``bags(i)`` gives a row's shingles and counts.
    Pairs that share a band and are not yet connected are compared by signature, and exactly where the estimate comes within 0.18 of the threshold, over four standard errors.
    """
    keys = band_keys(found)
    root = np.arange(len(own))
    refuted: set[int] = set()
    links = []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for band in range(BANDS):
        order = np.argsort(keys[:, band], kind="stable")
        ordered = keys[order, band]
        cuts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a < 2:
                continue
            members = order[a:b]
            for k in range(len(members) - 1):
                i = members[k]
                rest = members[k + 1 :]
                tops = np.array([top(j) for j in rest]) if len(rest) < 16 else _tops(root, rest)
                rest = rest[tops != top(i)]
                if side is not None:
                    rest = rest[side[rest] != side[i]]
                if not len(rest):
                    continue
                near = (found[rest] == found[i]).mean(axis=1)
                keep = near >= threshold - 0.18
                for j in rest[keep][np.argsort(-near[keep], kind="stable")]:
                    code = int(min(i, j)) * len(own) + int(max(i, j))
                    if code in refuted or top(i) == top(j):
                        continue
                    if overlap(*bags(i), *bags(j)) >= threshold:
                        root[top(j)] = top(i)
                        links.append((int(own[i]), int(own[j])))
                    else:
                        refuted.add(code)
    return links


def _tops(root: np.ndarray, rows: np.ndarray) -> np.ndarray:
    while (root[root] != root).any():
        root[:] = root[root]
    return root[rows]


def overlap(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags; two empty ones are alike."""
    total = wa.sum() + wb.sum()
    if not total:
        return 1.0
    _, x, y = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    common = np.minimum(wa[x], wb[y]).sum()
    return float(common / (total - common))


def near_classes(docs: DataFrame, threshold: float = 0.8, block_rows: int = 1024, block_bytes: int = 6 << 20) -> DataFrame:
    """(doc_id, h1, h2, size, class_id, n_docs, is_first) of every row: the class of near copies it belongs to.

    Two texts are linked if the weighted Jaccard similarity of their five-word shingles (A-Z lower-cased) is ``threshold`` or more; classes are what links connect. ``class_id`` is the least doc_id of the class (null if it has no other), and ``is_first`` marks the one row that stays; h1, h2 and size tell texts apart.
    Equal texts are one node, so copies are never paired; null and empty texts are equal. Repeated rows are copies. An empty table gives no rows.
    Candidates sharing a band go into blocks of at most ``block_rows`` texts or so and about ``block_bytes``; a larger group of candidates is split, and each pair of its blocks is one unit of work.
    """
    rows = docs.select("doc_id", "text", *identity())
    nodes = rows.groupBy(*ID).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialise(nodes)
    of_node = F.expr("r.h1 = n.h1 AND r.h2 = n.h2 AND r.size = n.size AND r.doc_id <=> n.least")
    sketches = materialise(signatures(rows).alias("r").join(nodes.alias("n"), of_node).select("n.node", "r.size", "signature", "bands"))
    keys = sketches.select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1")
    shared = materialise(keys.join(buckets, "key").select("key", "node", "a"))
    # A node is tied to the least node of its buckets, and a bucket ties the least nodes of its members: few edges, the same components.
    least_of = shared.groupBy("node").agg(F.min("a").alias("m"))
    named = shared.select("key", "node").join(least_of, "node").select("key", "m").distinct()
    lows = named.groupBy("key").agg(F.min("m").alias("low"))
    ties = named.join(lows, "key").filter("m <> low").select(F.col("low").alias("a"), F.col("m").alias("b")).distinct()
    edges = least_of.filter("m <> node").select(F.col("m").alias("a"), F.col("node").alias("b")).unionByName(ties)
    groups = connected_components(edges)
    wanted = groups.join(sketches, "node").select("node", "component", "size", "signature")
    sizes = wanted.groupBy("component").agg(F.count("*").alias("members"), F.sum("size").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("members") / block_rows), F.ceil(F.col("bytes") / block_bytes)).cast("int")
    sizes = materialise(sizes.withColumn("blocks", blocks))
    small = sizes.filter("blocks = 1").agg(F.sum("members"), F.sum("bytes")).first()
    bins = max(1, -(-(small[0] or 0) // block_rows), -(-(small[1] or 0) // block_bytes))
    wanted = wanted.join(sizes.select("component", "blocks"), "component")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    wanted = wanted.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    wanted = wanted.select(
        "node", "own", "signature",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component")).alias("unit"),
        F.when(F.col("blocks") == 1, -1).otherwise(F.least("own", "other")).alias("i"),
        F.greatest("own", "other").alias("j"),
    )
    least = nodes.join(groups.select("node"), "node").select("node", *ID, "least").alias("n")
    texts = rows.alias("r").join(least, of_node).select("n.node", "r.text")
    together = wanted.join(texts, "node")

    def link(table: pa.Table) -> pa.Table:
        own = np.asarray(table["node"], dtype=np.int64)
        own, first = np.unique(own, return_index=True)  # a repeated row brings its text again
        table = table.take(pa.array(first)).combine_chunks()
        found = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype=np.uint32).reshape(-1, COMPONENTS)
        i, j, side = table["i"][0].as_py(), table["j"][0].as_py(), np.asarray(table["own"])
        pieces = []
        texts = table["text"].combine_chunks()
        for at in range(0, len(texts), 1 << ROW_BITS):
            elements, counts, weights = shingles(texts.slice(at, 1 << ROW_BITS))
            # The upper bits held the row's number and are gone, so hashes compare across rows.
            ends = np.cumsum(counts)
            pieces += [(elements[b - n : b], weights[b - n : b]) for b, n in zip(ends, counts, strict=True)]
        links = link_block(own, found, None if i == j or i < 0 else side, pieces.__getitem__, threshold)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    links = together.groupBy("unit", "i", "j").applyInArrow(link, "a long, b long")
    classes = connected_components(links)
    nodes = nodes.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    named = nodes.groupBy("class").agg(F.min("least").alias("class_id"), F.sum("copies").alias("n_docs"), F.min_by("node", F.struct(F.col("least").isNull(), "least", "node")).alias("head"))
    named = materialise(nodes.join(named, "class").select(*ID, "class_id", "n_docs", (F.col("node") == F.col("head")).alias("heads"), "least"))
    out = rows.select("doc_id", *ID).join(named, ID)
    return out.select("doc_id", *ID, "class_id", "n_docs", (F.col("heads") & F.col("doc_id").eqNullSafe(F.col("least"))).alias("is_first"))


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the row with the least doc_id stays, of rows alike in doc_id and text one."""
    first = near_classes(docs, threshold).filter("is_first").select(F.col("doc_id").alias("__first"), *[F.col(c).alias(f"__first_{c}") for c in ID]).distinct()
    marked = docs.select("*", *[c.alias(f"__{n}") for n, c in zip(ID, identity(), strict=True)])
    same = F.col("doc_id").eqNullSafe(F.col("__first"))
    for c in ID:
        same &= F.col(f"__{c}") == F.col(f"__first_{c}")
    return marked.join(first, same, "left_semi").dropDuplicates(["doc_id", *[f"__{c}" for c in ID]]).drop(*[f"__{c}" for c in ID])
