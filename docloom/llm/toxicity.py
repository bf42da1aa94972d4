"""Toxicity scores by a factorization machine over hashed terms.

Terms are words and the starts of words, as 64-bit hashes; a text's terms count once each. The machine adds a weight for each term and the product of two terms' factors for each pair, so that two terms together can say more than both alone.
Most terms say nothing: weights are held at zero unless the texts speak against it clearly. Factors go to terms with a weight, and to terms that say something only in pairs: those which the strongest directions of the co-occurrences, weighted by what the weights leave unexplained, point out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import group_sums, materialise, slices, word_codes, word_hashes
from docloom.llm.tokens import PUNCTUATION

#: Lengths of a word's starts that are terms of their own.
STARTS = (4, 6)
#: Rows scored, and entries added up, at once.
SCORED, ADDED = 1000, 1 << 18


@dataclass
class Machine:
    """Sorted term hashes with their weights and factors; terms that training did not keep weigh nothing."""

    bias: float
    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probabilities for texts with so many kept terms each, at their places in ``terms``."""
        if len(counts) > SCORED:
            ends = np.concatenate(([0], np.cumsum(counts)))
            cuts = range(0, len(counts), SCORED)
            return np.concatenate([self.scores(counts[a : a + SCORED], at[ends[a] : ends[min(a + SCORED, len(counts))]]) for a in cuts])
        row = np.repeat(np.arange(len(counts)), counts)
        total = self.bias + np.bincount(row, self.weights[at], len(counts))
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            total += 0.5 * (np.bincount(row, v, len(counts)) ** 2 - np.bincount(row, v * v, len(counts)))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def word_terms(words: pa.Array) -> np.ndarray:
    """The term hashes of each word, a column for the word and for each of its starts (its number in the two low bits); punctuation at its ends is left out."""
    stems = pc.utf8_lower(pc.ascii_trim(words, PUNCTUATION))
    out = []
    for column, length in enumerate((None, *STARTS)):
        distinct = (stems if length is None else pc.utf8_slice_codeunits(stems, 0, length)).dictionary_encode()
        hashes = word_hashes(distinct.dictionary, column) & ~np.uint64(3) | np.uint64(column)
        out.append(hashes[np.asarray(distinct.indices, dtype=np.int64)])
    return np.stack(out, axis=1)


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct terms each text has, and their hashes."""
    counts, codes, words = word_codes(texts)
    row = np.repeat(np.arange(len(counts)), counts)
    pairs = np.unique(row * max(1, len(words)) + codes)
    row, code = pairs // max(1, len(words)), pairs % max(1, len(words))
    terms = word_terms(words)[code].ravel()
    row = np.repeat(row, 1 + len(STARTS))
    order = np.lexsort((terms, row))
    terms, row = terms[order], row[order]
    first = np.ones(len(terms), dtype=bool)
    first[1:] = (terms[1:] != terms[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[first], minlength=len(counts)), terms[first]


def added(to: np.ndarray, of: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums over entries of ``values[of]``, by ``to``, a slice of entries at a time."""
    out = np.zeros(size)
    for at in range(0, len(to), ADDED):
        out += np.bincount(to[at : at + ADDED], values[of[at : at + ADDED]], size)
    return out


def pair_directions(row: np.ndarray, at: np.ndarray, n_terms: int, rest: np.ndarray, spread: np.ndarray, words: np.ndarray, directions: int, least_texts: int, clear: float = 6.0) -> np.ndarray:
    """Factors (a row a term, mostly zero) for pairs of terms that explain what is left.

    The matrix of co-occurrences weighted by the residuals ``rest``, scaled by the terms' frequencies, has large positive directions where terms speak in pairs; a subspace iteration finds them without forming it.
    Only terms in ``words`` that ``least_texts`` texts hold take part. Of each direction, terms at a fifth of its largest or more stay, if some pair of them is ``clear``: its residuals lie that many standard deviations from none.
    """
    freq = np.bincount(at, minlength=n_terms)
    able = words & (freq >= least_texts)
    own = able[at]
    row, at = row[own], at[own]
    out = np.zeros((n_terms, directions))
    if not able.any():
        return out
    scale = np.where(able, 1 / np.sqrt(np.maximum(freq, 1) + least_texts), 0.0)
    diagonal = scale**2 * added(at, row, rest, n_terms)

    def times(v: np.ndarray) -> np.ndarray:
        w = np.empty_like(v)
        for f in range(v.shape[1]):
            sums = added(row, at, v[:, f] * scale, len(rest)) * rest
            w[:, f] = scale * added(at, row, sums, n_terms) - diagonal * v[:, f]
        return w

    basis = np.linalg.qr(np.random.default_rng(5).normal(size=(n_terms, min(2 * directions, n_terms))) * able[:, None])[0]
    for _ in range(15):
        basis = np.linalg.qr(times(basis))[0]
    values, turns = np.linalg.eigh(basis.T @ times(basis))
    for f, k in enumerate(np.argsort(-values)[:directions]):
        u = basis @ turns[:, k]
        picked = np.flatnonzero(np.abs(u) >= 0.2 * np.abs(u).max())[:64]
        held = np.zeros((len(rest), len(picked)))
        place = np.full(n_terms, -1)
        place[picked] = np.arange(len(picked))
        some = place[at] >= 0
        held[row[some], place[at[some]]] = 1
        z = (held.T @ (held * rest[:, None])) / np.sqrt(held.T @ (held * spread[:, None]) + 1e-9)
        np.fill_diagonal(z, 0)
        if values[k] > 0 and np.abs(z).max() >= clear:
            keep = np.abs(z).max(axis=0) >= clear
            out[picked[keep], f] = u[picked[keep]] / np.abs(u[picked]).max()
    return out


def fit(
    counts: np.ndarray, terms: np.ndarray, labels: np.ndarray, factors: int = 4, min_texts: int = 3, epochs: int = 8, rate: float = 0.3, l1: float = 12.0, l2: float = 0.1, batch: int = 64, seed: int = 7, pair_texts: int = 50
) -> Machine:
    """Train by mini-batches on the logistic loss: weights by follow-the-regularised-leader with an L1 penalty, factors by Adagrad.

    In the first ``epochs`` only terms with a weight have factors. Then terms that speak in pairs (``pair_directions``, of whole words in ``pair_texts`` texts or more) get theirs, and if there are any, as many epochs follow.
    Terms in fewer than ``min_texts`` texts are left out, and those without a weight or a pair at the end.
    """
    rng = np.random.default_rng(seed)
    kept, freq = np.unique(terms, return_counts=True)
    kept = kept[freq >= min_texts]
    at, known = _places(kept, terms)
    counts = group_sums(known, counts)
    at = at[known].astype(np.int32)
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    del known, terms
    share = min(max(labels.mean() if len(labels) else 0.0, 1e-3), 1 - 1e-3)
    bias, bias_square = float(np.log(share / (1 - share))), 1e-8
    z, n = np.zeros(len(kept)), np.zeros(len(kept))
    vectors, square = rng.normal(0, 0.05, (len(kept), factors)), np.full((len(kept), factors), 1e-8)

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((1 + np.sqrt(n)) / rate + l2), 0.0)

    paired = np.zeros(len(kept), dtype=bool)
    for epoch in range(2 * epochs if len(labels) else 0):
        if epoch == epochs:
            w = weight(z, n)
            now = Machine(bias, kept, w, vectors * (w != 0)[:, None]).scores(counts, at)
            found = pair_directions(row, at, len(kept), labels - now, now * (1 - now), kept & np.uint64(3) == 0, factors, pair_texts)
            paired = found.any(axis=1) & (w == 0)
            if not paired.any():
                break
            vectors[paired], square[paired] = 0.3 * found[paired], 1e-8
        order = rng.permutation(len(counts))
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            size = counts[rows]
            own = np.repeat(np.arange(len(rows)), size)
            used = at[np.repeat(ends[rows] - size - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            places, back = np.unique(used, return_inverse=True)
            w = weight(z[places], n[places])
            alive = (w != 0) | paired[places]
            live = alive[back]
            v, row_live, place_live = vectors[used[live]], own[live], back[live]
            sums = np.stack([np.bincount(row_live, v[:, f], len(rows)) for f in range(factors)], axis=1)
            squares = np.bincount(row_live, (v * v).sum(1), len(rows))
            margin = bias + np.bincount(own, w[back], len(rows)) + 0.5 * ((sums**2).sum(1) - squares)
            error = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels[rows]
            g = np.bincount(back, error[own], len(places))
            z[places] += g - (np.sqrt(n[places] + g * g) - np.sqrt(n[places])) / rate * w
            n[places] += g * g
            pull = error[row_live][:, None] * (sums[row_live] - v)
            touched = places[alive]
            for f in range(factors):
                g = np.bincount(place_live, pull[:, f], len(places))[alive] + 0.01 * vectors[touched, f]
                square[touched, f] += g * g
                vectors[touched, f] -= 0.05 * g / np.sqrt(square[touched, f])
            g = float(error.mean())
            bias_square += g * g
            bias -= 0.1 * g / np.sqrt(bias_square)
    w = weight(z, n)
    told = (w != 0) | paired
    return Machine(bias, kept[told], w[told], vectors[told])


def _places(kept: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each term stands in the sorted ``kept``, and whether it does."""
    if not len(kept):
        return np.zeros(terms.shape, dtype=np.int64), np.zeros(terms.shape, dtype=bool)
    at = np.minimum(np.searchsorted(kept, terms), len(kept) - 1)
    return at, kept[at] == terms


def train(docs: DataFrame, labels: DataFrame, train_on=None, max_rows: int = 20_000, least_spread: float = 6.0, pair_share: float = 0.0025, **options) -> Machine:
    """Fit on at most ``max_rows`` labelled rows: those whose ids have the smallest hashes, all of them if there are fewer.

    ``labels`` has doc_id and toxic; a document with several labels takes the largest, null labels and ids are left out. ``train_on`` is a condition on doc_id that a teaching row must meet.
    Spark counts each term's texts by label first. Terms go to the driver if their share of toxic texts lies ``least_spread`` squared deviations or more from the common one (three texts at least), and whole words also if a share of ``pair_share`` of the texts, and 50 of them, hold them: those may say something in pairs though nothing alone.
    So the driver receives a bounded number of terms, of the chosen rows only.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if train_on is not None:
        known = known.filter(train_on)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            counts, terms = term_hashes(batch["text"])
            if wanted is not None:
                _, hit = _places(wanted, terms)
                counts, terms = group_sums(hit, counts), terms[hit]
            ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(terms.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], lists], names=["doc_id", "toxic", "terms"])

    schema = f"doc_id {kind}, toxic int, terms array<bigint>"
    share = chosen.agg(F.avg("toxic")).first()[0] or 0.0
    spread = max(share * (1 - share), 1e-9)
    counted = rows.mapInArrow(extract, schema).select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    alone = (F.col("n") >= 3) & (F.pow(F.col("k") - F.col("n") * share, F.lit(2)) >= least_spread * spread * F.col("n"))
    often = (F.col("term").bitwiseAND(F.lit(3)) == 0) & (F.col("n") >= max(50, int(pair_share * chosen.count())))
    telling = counted.filter(alone | often)
    wanted = np.sort(np.asarray(telling.select("term").toArrow()["term"].combine_chunks()).view(np.uint64))
    table = rows.mapInArrow(lambda batches: extract(batches, wanted), schema).toArrow()
    order = np.asarray(pc.sort_indices(table, [("doc_id", "ascending")]))
    counts = np.asarray(pc.list_value_length(table["terms"]), dtype=np.int64)[order]
    labels = np.asarray(table["toxic"], dtype=np.float64)[order]
    terms = np.asarray(table["terms"].take(pa.array(order)).combine_chunks().flatten(), dtype=np.int64).view(np.uint64)
    del table
    return fit(counts, terms, labels, **options)


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` to every row; only the text counts, null as the empty text.

    All columns stay (a score or predicted column of the input is replaced). The machine is broadcast; its size is bounded by the training sample.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(machine)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    @F.arrow_udf("double")
    def toxic(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            out = []
            for part in slices(iter([pa.RecordBatch.from_arrays([whole], names=["text"])])):
                counts, codes, words = word_codes(part["text"])
                at, hit = _places(sent.value.terms, word_terms(words))
                some = np.flatnonzero(hit.any(axis=1)[codes])  # the few tokens that bring a term the machine knows
                row = np.repeat(np.arange(len(counts)), counts)[some]
                size = max(1, len(sent.value.terms))
                pairs = np.unique((row[:, None] * size + at[codes[some]])[hit[codes[some]]])
                out.append(sent.value.scores(np.bincount(pairs // size, minlength=len(counts)), pairs % size))
            yield pa.array(np.concatenate(out) if out else np.zeros(0))

    return docs.select(*kept).withColumn("score", toxic("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
