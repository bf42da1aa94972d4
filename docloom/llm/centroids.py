"""Centroid clustering of integer vectors: exact assignments, screened by fast float32 products.

A batch's squared distances to all centroids are screened by one float32 matrix product whose rounding error has a proven bound. A centroid stays on a vector's shortlist if its interval meets that of the best; a shortlist of several is recomputed in integers, where the smaller number wins a tie. So the result is that of exact arithmetic on every machine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialise

#: Half a unit in the last place of a float32.
UNIT = 2.0**-24
#: Up to this size squared distances over 64 components fit in 64 bits.
SMALL = 1 << 27
LONGEST = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, dims: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, v): the kept vectors with each component x as floor(scale * x).

    Kept are vectors of exactly ``dims`` components, none null, infinite or NaN, whose integers fit in 64 bits; null vectors and all others have no row.
    """
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double") * scale) < 2.0**63, F.lit(False)))
    return vectors.filter((F.size("embedding") == dims) & fits).select("vec_id", v.alias("v"))


def first_centroids(kept: DataFrame, k: int = 16, seed: int = 1) -> list[list[int]]:
    """The k vectors with the least lowercase-hex sha256 of ``seed:vec_id``, or all if there are fewer. Equal ids go by their components; a vector without an id comes after all others."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in kept.orderBy(mark.asc_nulls_last(), "v").select("v").limit(k).collect()]


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, as 64-bit integers where they must fit, else as Python integers."""
    if not a.size or max(a.max(), b.max()) <= SMALL and min(a.min(), b.min()) >= -SMALL:
        d = a - b
        return np.einsum("ij,ij->i", d, d)
    d = a.astype(object) - b.astype(object)
    return (d * d).sum(axis=1)


def intervals(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of |c|^2 - 2 v.c for each vector and centroid from a float32 product.

    For n components the product, its inputs rounded to float32, lies within g * |v| * |c| of v.c in any order of summation, where g = (n + 2) u / (1 - (n + 2) u). The float64 steps around it add less than 2^-48 of what they handle. Overflow gives the whole line.
    """
    n = v.shape[1] + 2
    g = n * UNIT / (1 - n * UNIT) * (1 + 2.0**-40)
    with np.errstate(over="ignore", invalid="ignore"):
        product = (v.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
        norms = [np.sqrt(np.square(x.astype(np.float64)).sum(axis=1)) * (1 + 2.0**-40) for x in (v, c)]
        squares = np.array([float(sum(int(x) ** 2 for x in row)) for row in c])
        score = squares - 2 * product
        width = 2 * g * np.outer(*norms) + 2.0**-48 * (squares + 2 * np.abs(product))
        low, high = score - width, score + width
    wild = ~(np.isfinite(low) & np.isfinite(high))
    low[wild], high[wild] = -np.inf, np.inf
    return low, high


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector (the smaller among equals) and the exact squared distance."""
    low, high = intervals(v, c)
    listed = low <= high.min(axis=1, keepdims=True)
    best = listed.argmax(axis=1)
    several = np.flatnonzero(listed.sum(axis=1) > 1)
    if several.size:
        row, number = np.nonzero(listed[several])
        exact = exact_distances(v[several[row]], c[number])
        table = np.full((several.size, len(c)), np.inf if exact.dtype == object else LONGEST, dtype=exact.dtype)
        table[row, number] = exact
        best[several] = table.argmin(axis=1)
    return best, exact_distances(v, c[best])


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all lists of one length, as rows."""
    flat = np.asarray(column.flatten(), dtype=np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def cluster_sums(kept: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and exact component sums of each centroid's vectors. A task sends one row a centroid; the driver gets one number for each centroid and component."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch["v"])
            best, _ = nearest(v, centroids)
            wide = v.astype(object) if max(v.max(), -v.min()) > 1 << 40 else v
            for k in np.unique(best):
                own = wide[best == k]
                n, total = found.get(int(k), (0, [0] * v.shape[1]))
                found[int(k)] = (n + len(own), [a + int(b) for a, b in zip(total, own.sum(axis=0), strict=True)])
        rows = [(k, n, [Decimal(x) for x in total]) for k, (n, total) in found.items()]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)], ["cluster", "n", "total"])

    parts = kept.mapInArrow(sums, "cluster int, n long, total array<decimal(38,0)>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("at", "part")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("part").alias("part"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(each.collect(), key=lambda r: (r["cluster"], r["at"])):
        out.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["part"]))
    return out


def refine(kept: DataFrame, centroids: list[list[int]], rounds: int = 3) -> list[list[int]]:
    """Each round replaces every centroid that has vectors by floor(sum / count) of their components; the others stay."""
    for _ in range(rounds):
        found = cluster_sums(kept, np.array(centroids, dtype=np.int64))
        centroids = [[s // found[k][0] for s in found[k][1]] if k in found else c for k, c in enumerate(centroids)]
    return centroids


def assign(kept: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of every vector; a distance beyond 64 bits is null."""
    c = np.array(centroids, dtype=np.int64)
    kind = kept.schema["vec_id"].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best, distance = nearest(matrix(batch["v"]), c)
                fits = pa.array([int(x) if x <= LONGEST else None for x in distance] if distance.dtype == object else distance, pa.int64())
                yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(best, pa.int32()), fits], ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(label, f"vec_id {kind}, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector of (vec_id, embedding).

    See :func:`integer_vectors` for what is kept, :func:`first_centroids` for the start. Every round reads the vectors once more; no key is shuffled but centroid numbers with their sums, so no group of equal vectors meets in a task. The driver holds k centroids and their sums.
    Repeated ids and vectors are rows of their own; a null id stays null; extra columns are not read; fewer vectors than k give as many centroids; no vector gives no row. A sum beyond 64 bits, or over a distance beyond them, is null.
    """
    kept = integer_vectors(vectors, dims, scale)
    start = first_centroids(kept, k, seed)
    if not start:
        kind = kept.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = refine(kept, start, rounds)
    labelled = materialise(assign(kept, centroids))
    sums = labelled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("distance").isNull()).alias("beyond")).collect()
    by = {r["cluster"]: None if r["beyond"] else int(r["total"]) for r in sums}
    whole = None if None in by.values() else sum(by.values())

    def long(x: int | None):
        return F.lit(x if x is not None and x <= LONGEST else None).cast("long")

    own = F.get(F.array(*[long(by.get(i, 0)) for i in range(len(centroids))]), F.col("cluster"))
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    mark = F.get(F.array(*map(F.lit, marks)), F.col("cluster"))
    return labelled.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), long(whole).alias("inertia"), mark.alias("centroid_sha256"))
