"""Nearest-neighbour search over a chunk table and what is made of its results."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions import vectors

#: Room of a block of vectors, and vectors multiplied at once.
BLOCK_BYTES, TILE = 32 << 20, 1024
#: Tasks of a job over pairs of blocks.
MOST_TASKS = 4096


def nearest(chunks: DataFrame, query: Sequence[float], k: int, tenant: str | None = None, threshold: float = 0.0, key: str = "vec_id") -> DataFrame:
    """The k rows of a tenant most alike to a vector by cosine, by key among equals; then those of at least the threshold.

    The threshold is applied after the limit, so fewer than k rows may come back. Rows without a direction come last.
    """
    given = F.array(*[F.lit(float(x)) for x in query])
    rows = chunks if tenant is None else chunks.filter(F.col("tenant") == tenant)
    top = rows.withColumn("similarity", vectors.cosine(F.col("embedding"), given)).orderBy(F.desc_nulls_last(F.round("similarity", 9)), key).limit(k)
    return top if threshold <= 0 else top.filter(F.col("similarity") >= threshold)


def nearest_each(queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", block: int | None = None) -> DataFrame:
    """(query_id, key, similarity, rank): for every query its k nearest rows.

    Blocks of queries meet blocks of rows in one job (see ``_meet``). A meeting keeps k rows a query, so what is ranked at the end does not grow with the vectors' length; a window ranks them.
    """

    def best_of(ids: np.ndarray, given: np.ndarray, names: np.ndarray, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i in range(0, len(ids), TILE):
            found, best = np.zeros((len(ids[i : i + TILE]), 0), dtype=np.int64), np.zeros((len(ids[i : i + TILE]), 0))
            for j in range(0, len(names), TILE):
                best = np.hstack([best, np.round(given[i : i + TILE] @ matrix[j : j + TILE].T, 9)])
                found = np.hstack([found, np.broadcast_to(names[j : j + TILE], (len(found), len(names[j : j + TILE])))])
                order = np.lexsort((found, -best), axis=1)[:, :k]
                best, found = np.take_along_axis(best, order, 1), np.take_along_axis(found, order, 1)
            yield np.repeat(ids[i : i + TILE], found.shape[1]), found.ravel(), best.ravel()

    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return _meet(queries, rows, key, block, best_of).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def within_each(queries: DataFrame, rows: DataFrame, at_least: float, key: str = "vec_id", block: int | None = None, group: str | None = None) -> DataFrame:
    """(query_id, key, similarity): for every query all rows but itself whose cosine, to six digits, is at least the threshold (above 0); with ``group`` only rows with the query's value in that column, which is not null.

    Blocks of queries meet blocks of rows in one job (see ``_meet``).
    """

    def alike_of(ids: np.ndarray, given: np.ndarray, names: np.ndarray, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i in range(0, len(ids), TILE):
            for j in range(0, len(names), TILE):
                alike = np.round(given[i : i + TILE] @ matrix[j : j + TILE].T, 6)
                q, r = np.nonzero((alike >= at_least) & (ids[i : i + TILE, None] != names[j : j + TILE]))
                yield ids[i + q], names[j + r], alike[q, r]

    return _meet(queries, rows, key, block, alike_of, group)


def links(rows: DataFrame, at_least: float, key: str = "vec_id", block: int | None = None) -> DataFrame:
    """(a, b, similarity): every two rows of a table, both ways round, whose cosine, to six digits, is at least the threshold (above 0).

    Rows are dealt by a hash into blocks of about ``block`` vectors (by default as many as fill ``BLOCK_BYTES``, fewer where that leaves tasks without work). Every two blocks, and each with itself, are one unit that serves both ways, so a row moves once for each block. What a unit finds leaves it tile by tile: memory holds two blocks and a tile, however many rows are alike. Nothing passes the driver but a count and a length. Rows without a key or a vector are left out; one without a direction is like no other.
    """
    spark = rows.sparkSession
    given = rows.filter(F.col("embedding").isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("__key"), F.col("embedding").alias("__vector"))
    n, length = given.agg(F.count("*"), F.max(F.size("__vector"))).first()
    most = block or max(TILE, BLOCK_BYTES // (8 * max(1, length or 1)))
    # Units are as many as 8 a core, so that tasks end alike, but a block is no smaller than a tile for it.
    blocks = max(1, -(-n // most), min(-(-n // TILE), math.isqrt(16 * spark.sparkContext.defaultParallelism)))
    own, other = F.pmod(F.xxhash64("__key"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = given.withColumn("__own", own).withColumn("__other", other).withColumns({"__i": F.least("__own", "__other"), "__j": F.greatest("__own", "__other")}).drop("__other")

    def unit(names: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (i, j) = pa.Table.from_batches(list(batches)), (name.as_py() for name in names)
        sides = [table.filter(pc.equal(table["__own"], name)) for name in (i, j)]
        if not all(side.num_rows for side in sides):
            return
        (ids, left), (others, right) = (_directions(side, "__key") for side in sides)
        for at in range(0, len(ids), TILE):
            for to in range(at if i == j else 0, len(others), TILE):
                alike = left[at : at + TILE] @ right[to : to + TILE].T
                q, r = np.nonzero(alike > at_least - 1e-6)  # few are left to be rounded
                alike = np.round(alike[q, r], 6)
                kept = (alike >= at_least) & (ids[at + q] != others[to + r]) & ((i != j) | (at + q < to + r))
                a, b, alike = ids[at + q[kept]], others[to + r[kept]], alike[kept]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((a, b), (b, a), (alike, alike))], ["a", "b", "similarity"])

    units = blocks * (blocks + 1) // 2
    return dealt.repartition(min(units, MOST_TASKS), "__i", "__j").groupBy("__i", "__j").applyInArrow(unit, "a long, b long, similarity double")


def _meet(queries: DataFrame, rows: DataFrame, key: str, block: int | None, compare: Callable[..., Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], group: str | None = None) -> DataFrame:
    """(query_id, key, similarity) as ``compare`` finds them for every block of queries and every block of rows.

    Both sides are dealt by a hash into blocks of about ``block`` vectors (by default as many as fill ``BLOCK_BYTES``), and each pair of blocks is one unit. A row moves once for each block of queries and the other way round, so blocks of equal size move least; nothing passes the driver but two counts and a length. Rows without a key or a vector are left out; keys are taken to be distinct. With ``group`` each value's queries and rows are dealt by themselves, in blocks for the largest group.
    """
    spark = rows.sparkSession
    same = F.lit(0) if group is None else F.col(group)
    asked, given = (side.filter(F.col("embedding").isNotNull() & F.col(key).isNotNull() & same.isNotNull()).select(F.col(key).cast("long").alias(name), F.col("embedding").alias("__vector"), same.alias("__g")) for side, name in ((queries, "query_id"), (rows, key)))
    if block is None:
        one = given.select(F.size("__vector")).first()
        block = max(TILE, BLOCK_BYTES // (8 * max(1, one[0] if one else 1)))
    most = lambda side: side.groupBy("__g").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.count("*")).first()
    (n_asked, _), (n_given, n_groups) = most(asked), most(given)
    across, down = max(1, -(-n_asked // block)), max(-(-spark.sparkContext.defaultParallelism // max(1, n_groups)), -(-n_given // block))
    asked = asked.withColumns({"__q": F.pmod(F.xxhash64("query_id"), F.lit(across)), "__r": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long")))})
    given = given.withColumns({"__r": F.pmod(F.xxhash64(key), F.lit(down)), "__q": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long")))})

    def unit(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(compare(*_directions(left, "query_id"), *_directions(right, key))) if left.num_rows and right.num_rows else []
        ids, names, alike = (np.concatenate([f[c] for f in found]) if found else np.zeros(0) for c in range(3))
        return pa.table({"query_id": pa.array(ids.astype(np.int64)), key: pa.array(names.astype(np.int64)), "similarity": pa.array(alike)})

    return asked.groupBy("__g", "__q", "__r").cogroup(given.groupBy("__g", "__q", "__r")).applyInArrow(unit, f"query_id long, {key} long, similarity double")


def _directions(table: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray]:
    """The keys and the vectors of a block, at length one; a vector without a direction stays at nought."""
    vectors = table["__vector"].combine_chunks()
    matrix = np.asarray(vectors.flatten(), dtype=np.float64).reshape(table.num_rows, -1)
    return np.asarray(table[key], dtype=np.int64), matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def redundancy(queries: DataFrame, rows: DataFrame, at_least: float = 0.95, key: str = "vec_id") -> DataFrame:
    """(key, n_links, redundant) for every query: how many other rows are that near, and whether one of them has a smaller key. A null vector has no links."""
    links = within_each(queries, rows, at_least, key).groupBy("query_id").agg(F.count("*").alias("n_links"), F.min(key).alias("__first"))
    found = queries.select(key).join(links.withColumnRenamed("query_id", key), key, "left")
    return found.select(key, F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.col("__first") < F.col(key), F.lit(False)).alias("redundant"))


def confidence(similarity: Column, status: Column, content: Column) -> Column:
    """Similarity raised for finished documents and long passages, lowered for unfinished ones and short passages, at most 1."""
    by_status = F.when(status.isin("completed", "processed"), 1.1).when(status == "processing", 0.9).otherwise(1.0)
    by_length = F.when(F.length(content) < 50, 0.8).when(F.length(content) > 500, 1.05).otherwise(1.0)
    return F.least(F.lit(1.0), similarity * by_status * by_length)


def answer_context(hits: DataFrame, group: Sequence[str], used: int = 3) -> DataFrame:
    """For each group of ranked hits: the context of the first few, the number of hits and the answer's confidence.

    Hits have rank, filename, page, content and similarity. Confidence is the mean similarity times 1.2, at most 0.95.
    """
    block = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(": "), F.col("filename"), F.lit(", Page "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit("]\n"), "content")
    listed = F.array_sort(F.collect_list(F.when(F.col("rank") <= used, F.struct("rank", block.alias("block")))))
    return hits.groupBy(*group).agg(
        F.array_join(F.transform(listed, lambda x: x["block"]), "\n\n").alias("context"),
        F.count("*").alias("n_hits"),
        F.least(F.round(F.avg("similarity") * 1.2, 6), F.lit(0.95)).alias("confidence"),
    )


def with_snippet(hits: DataFrame, most: int = 200) -> DataFrame:
    return hits.withColumn("snippet", tx.snippet(F.col("content"), most))
