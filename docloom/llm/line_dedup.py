"""Line dedup over a sharded minimal perfect hash.

Distinct lines are known by a 128-bit hash. The hashes are dealt into shards; each shard is a minimal perfect hash with arrays of fingerprints, document counts and last documents.
A document's lines probe the arrays of their shards, a batch at a time; lines are never joined with lines.
A shard that a frequent line makes hot is copied under several salts, by the number of probes it will get.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialise, mix, slices

#: What is stripped from both ends of a line, and the letters lower-cased, are those of ASCII.
WHITE = " \t\n\x0b\x0c\r"


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """Distinct keys of each document: (doc_id, mark of the text, h1, h2, positions)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in slices(batches):
            rows, highs, positions = [], [], []
            for row, text in enumerate(batch["text"].to_numpy(zero_copy_only=False)):
                if text is None or len(text) < min_chars:
                    continue
                own: dict[bytes, list[int]] = {}
                for at, line in enumerate(text.split("\n")):
                    if len(line) >= min_chars:
                        key = line.strip(WHITE)
                        if len(key) >= min_chars:
                            own.setdefault(digest(key.encode().lower()), []).append(at)
                rows.extend([row] * len(own))
                highs.extend(own)
                positions.extend(own.values())
            both = np.frombuffer(b"".join(highs), dtype=np.int64).reshape(-1, 2)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(at), batch["__mark"].take(at), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(positions, pa.list_(pa.int32()))],
                names=["doc_id", "__mark", "h1", "h2", "positions"],
            )

    return docs.select("doc_id", "__mark", "text").mapInArrow(split, f"doc_id {kind}, __mark long, h1 long, h2 long, positions array<int>")


def build_mph(h1: np.ndarray, h2: np.ndarray, load: float = 1.4) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """A minimal perfect hash of distinct keys by levels: keys alone in their cell keep it, the others go to the next level.

    Returns each key's index and, for every level, its size and the sorted cells that are taken.
    """
    index = np.zeros(len(h1), dtype=np.int64)
    left, base, levels = np.arange(len(h1)), 0, []
    while len(left):
        size = max(8, int(load * len(left)))
        cell = cell_of(h1[left], h2[left], len(levels), size)
        order = np.argsort(cell, kind="stable")
        ordered = cell[order]
        alone = np.ones(len(ordered), dtype=bool)
        alone[1:] &= ordered[1:] != ordered[:-1]
        alone[:-1] &= ordered[:-1] != ordered[1:]
        taken = ordered[alone]
        index[left[order[alone]]] = base + np.arange(len(taken))
        levels.append((size, taken))
        base += len(taken)
        left = np.sort(left[order[~alone]])
    return index, levels


def cell_of(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h1.view(np.uint64) ^ mix(h2.view(np.uint64), 2 * level + 1), 2 * level) % np.uint64(size)).astype(np.int64)


def probe_mph(levels: list[tuple[int, np.ndarray]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The index of each key; what isn't in the set gets any index or -1, for the fingerprint to tell."""
    out = np.full(len(h1), -1, dtype=np.int64)
    left, base = np.arange(len(h1)), 0
    for level, (size, taken) in enumerate(levels):
        if not len(left):
            break
        cell = cell_of(h1[left], h2[left], level, size)
        at = np.searchsorted(taken, cell)
        hit = (at < len(taken)) & (taken[np.minimum(at, len(taken) - 1)] == cell) if len(taken) else np.zeros(len(left), dtype=bool)
        out[left[hit]] = base + at[hit]
        base += len(taken)
        left = left[~hit]
    return out


def _blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def build_index(counted: DataFrame) -> DataFrame:
    """One row a shard from (shard, h1, h2, n_docs, last_doc): the hash's levels and its arrays."""

    def build(table: pa.Table) -> pa.Table:
        h1, h2 = (np.asarray(table[c], dtype=np.int64) for c in ("h1", "h2"))
        index, levels = build_mph(h1, h2)
        back = np.argsort(index)
        last = pc.fill_null(table["last_doc"], 0)
        return pa.table(
            {
                "shard": pa.array([table["shard"][0].as_py()], pa.int64()),
                "sizes": pa.array([[s for s, _ in levels]], pa.list_(pa.int64())),
                "cells": pa.array([[_blob(c) for _, c in levels]], pa.list_(pa.binary())),
                "fingerprints": pa.array([_blob(h2[back])], pa.binary()),
                "n_docs": pa.array([_blob(np.asarray(table["n_docs"], dtype=np.int64)[back])], pa.binary()),
                "last_doc": pa.array([_blob(np.asarray(last, dtype=np.int64)[back])], pa.binary()),
                "null_last": pa.array([_blob(np.asarray(pc.is_null(table["last_doc"]))[back])], pa.binary()),
            }
        )

    schema = "shard long, sizes array<long>, cells array<binary>, fingerprints binary, n_docs binary, last_doc binary, null_last binary"
    return counted.groupBy("shard").applyInArrow(build, schema)


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, shard_probes: int = 200_000) -> DataFrame:
    """The lines that each document loses: (doc_id, mark of the text, dropped positions). Needs doc_id, __mark and text."""
    lines = materialise(line_hashes(docs, min_chars))
    total = lines.count()
    shards = -(-total // shard_probes) or 1
    shard = F.pmod("h1", F.lit(shards))
    per_doc = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    counted = per_doc.groupBy("h1", "h2").agg(F.sum("one").alias("n_docs"), F.max("doc_id").cast("long").alias("last_doc"))
    counted = materialise(counted.withColumn("shard", shard))
    index = materialise(build_index(counted))
    hot = lines.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).filter(F.col("n") > 2 * shard_probes)
    hot = materialise(hot.select("shard", F.ceil(F.col("n") / shard_probes).cast("int").alias("copies")))
    copies = F.coalesce("copies", F.lit(1))
    salted = index.join(hot, "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    probes = lines.withColumn("shard", shard).join(hot, "shard", "left")
    probes = probes.withColumn("salt", F.pmod(F.xxhash64("doc_id", "__mark"), copies).cast("int")).drop("copies")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def probe(index: pa.Table, asked: pa.Table) -> pa.Table:
        if index.num_rows and asked.num_rows:
            row = index.slice(0, 1).to_pylist()[0]
            levels = [(s, np.frombuffer(c, dtype=np.int64)) for s, c in zip(row["sizes"], row["cells"], strict=True)]
            h1, h2 = (np.asarray(asked[c], dtype=np.int64) for c in ("h1", "h2"))
            at = probe_mph(levels, h1, h2)
            known = np.frombuffer(row["fingerprints"], dtype=np.int64)
            found = (at >= 0) & (known[at] == h2)
            often = found & (np.frombuffer(row["n_docs"], dtype=np.int64)[at] >= min_docs)
            null = np.asarray(pc.is_null(asked["doc_id"]))
            own = np.asarray(pc.fill_null(asked["doc_id"], 0), dtype=np.int64)
            last, null_last = np.frombuffer(row["last_doc"], dtype=np.int64)[at], np.frombuffer(row["null_last"], dtype=bool)[at]
            keeps = np.where(null, null_last, ~null_last & (own == last))
            asked = asked.filter(pa.array(often & ~keeps))
        else:
            asked = asked.slice(0, 0)
        return asked.select(["doc_id", "__mark", "positions"])

    found = salted.groupBy("shard", "salt").cogroup(probes.select("shard", "salt", "doc_id", "__mark", "h1", "h2", "positions").groupBy("shard", "salt"))
    found = found.applyInArrow(probe, f"doc_id {kind}, __mark long, positions array<int>")
    return found.groupBy("doc_id", "__mark").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("__dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop lines whose key at least ``min_docs`` documents hold, except in the document with the largest doc_id holding it.

    A key is the line without ASCII white space at its ends, A-Z lower-cased; keys under ``min_chars`` code points stay.
    All columns stay; ``text`` becomes the lines kept; n_lines (before) and n_dropped are added. A null or empty text is one empty line and becomes the empty text.
    Rows that share a doc_id count as one document, null included (it orders before all others); they keep their own texts. An empty table gives no rows.
    """
    marked = docs.withColumn("__mark", F.xxhash64("text"))
    lost = repeated_lines(marked, min_chars, min_docs).withColumnsRenamed({"doc_id": "__lost_id", "__mark": "__lost_mark"})
    joined = marked.join(lost, F.col("doc_id").eqNullSafe(F.col("__lost_id")) & (F.col("__mark") == F.col("__lost_mark")), "left")
    joined = joined.withColumn("__lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    n_dropped = F.when(F.col("__dropped").isNull(), 0).otherwise(F.size("__dropped")).cast("long")
    # The places that stay, by one hashed difference, so a text's cost does not grow with lines times lost lines.
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__dropped"))
    kept = F.when(F.col("__dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(places, lambda at: F.get("__lines", at)), "\n"))
    return joined.select(
        *[F.col(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped")], kept.alias("text"), F.size("__lines").cast("long").alias("n_lines"), n_dropped.alias("n_dropped")
    ).select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
