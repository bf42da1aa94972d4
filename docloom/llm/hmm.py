"""A hidden Markov language model over whole corpora.

Latent states emit word classes: a hash of the word into a fixed number of classes, one class for rare words and one for the end of a text. A class emits its words by their counts. So the matrices have a fixed size, while word counts follow the corpus and stay in tables.
Rare words are those that training has once or never; the unseen ones count as one word together, whose share comes from the words seen once and twice.
Texts are coded once, a block of texts a row. Baum-Welch counts are summed over blocks by Spark; the scaled forward recursion then gives every text's exact log-likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import group_sums, materialise, slices, word_codes, word_hashes

CLASSES = 8192
RARE, END = CLASSES, CLASSES + 1
#: Tokens of a training window: all tokens are used, a longer text as several windows.
WINDOW = 256


def code_blocks(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row a block of texts: its documents, their word codes and the block's words with their training counts, most frequent first."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for number, batch in enumerate(slices(batches)):
            counts, codes, words = word_codes(batch["text"])
            held = np.asarray(pc.fill_null(batch["held_out"], False))
            freq = np.bincount(codes, minlength=len(words))
            order = np.argsort(-freq, kind="stable")
            place = np.empty(len(words), dtype=np.int32)
            place[order] = np.arange(len(words))
            taught = np.bincount(codes[np.repeat(~held, counts)], minlength=len(words))[order]
            words = words.take(pa.array(order))
            classes = (word_hashes(words) % np.uint64(CLASSES)).astype(np.int32)
            one = [batch["doc_id"], pa.array(held), pa.array(counts), pa.array(place[codes]), words, pa.array(taught), pa.array(classes)]
            blob = pa.array([place[codes].tobytes()], pa.binary())
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (one[0], one[1], one[2], one[4], one[5], one[6])]
            block = pa.array([first + number], pa.int64())
            yield pa.RecordBatch.from_arrays([block, *lists[:3], blob, *lists[3:]], names=["block", "doc_ids", "held", "lengths", "codes", "words", "taught", "classes"])

    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    schema = f"block long, doc_ids array<{kind}>, held array<boolean>, lengths array<long>, codes binary, words array<string>, taught array<long>, classes array<int>"
    return rows.mapInArrow(code, schema)


def count_words(blocks: DataFrame) -> DataFrame:
    """(block, at, class, n, first): the training count of each block's words in the whole corpus; ``first`` marks one row of each word."""
    each = blocks.select("block", F.posexplode(F.arrays_zip("words", "taught", "classes")).alias("at", "x"))
    each = each.select("block", "at", F.col("x.words").alias("word"), F.col("x.taught").alias("taught"), F.col("x.classes").alias("class"))
    # Sums are made before the exchange; a common word, which has a row in every block, meets its sum in a join whose large partitions Spark splits.
    sums = each.groupBy("word").agg(F.sum("taught").alias("n"), F.min("block").alias("__first"))
    return each.join(sums.hint("merge"), "word").select("block", "at", "class", "taught", "n", (F.col("block") == F.col("__first")).alias("first"))


def _forward(start: np.ndarray, move: np.ndarray, emit: np.ndarray, lengths: np.ndarray, classes: np.ndarray, backward: bool = False):
    """Log10 likelihood of sequences side by side; with ``backward`` also the expected counts of starts, moves and emissions.

    Sequences go longest first, so those still running at a step are a prefix; each step is rescaled to sum to one.
    """
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths[order[0]]) if len(order) else 0
    running = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
    begin = (np.cumsum(lengths) - lengths)[order]
    states = len(start)
    logs = np.zeros(len(lengths))
    alphas, scales, total = [], [], np.zeros(len(lengths))
    alpha = None
    for t in range(longest):
        n = running[t]
        seen = emit[classes[begin[:n] + t]]
        alpha = (start if t == 0 else alpha[:n] @ move) * seen
        scale = alpha.sum(axis=1)
        alpha = alpha / scale[:, None]
        total[:n] += np.log10(scale)
        if backward:
            alphas.append(alpha)
            scales.append(scale)
    logs[order] = total
    if not backward:
        return logs
    moves, starts = np.zeros((states, states)), np.zeros(states)
    gammas, beta = np.zeros((len(classes), states), dtype=np.float32), None
    for t in range(longest - 1, -1, -1):
        n = running[t]
        now = np.ones((n, states))
        if t + 1 < longest:
            m = running[t + 1]
            ahead = emit[classes[begin[:m] + t + 1]] * beta / scales[t + 1][:, None]
            moves += (alphas[t][:m].T @ ahead) * move
            now[:m] = ahead @ move.T
        beta = now
        gamma = alphas[t] * beta
        gammas[begin[:n] + t] = gamma
        if t == 0:
            starts += gamma.sum(axis=0)
    return logs, starts, moves, np.stack([np.bincount(classes, gammas[:, k], END + 1) for k in range(states)])


def _windows(lengths: np.ndarray) -> np.ndarray:
    n = -(-lengths // WINDOW)
    row = np.repeat(np.arange(len(lengths)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return np.minimum(WINDOW, lengths[row] - at * WINDOW)


def _prepare(blocks: DataFrame, counts: DataFrame, totals: tuple, ends: int) -> DataFrame:
    """Blocks with word classes in place of word codes, ends included, and each document's base score and score of its words within their classes."""
    n_all, v_all = totals[0], totals[1]
    kind = blocks.schema["doc_ids"].dataType.simpleString()
    sent = blocks.sparkSession.sparkContext.broadcast(totals)

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        pack = np.asarray(table["n"], dtype=np.int64).tobytes()
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int64()), "counts": pa.array([pack], pa.binary())})

    known = counts.select("block", "at", "n").groupBy("block").applyInArrow(gather, "block long, counts binary")
    joined = blocks.drop("words", "taught").join(known, "block", "left")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, class_n, once, unseen = sent.value
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch[c][at] for c in batch.schema.names}
                lengths = np.asarray(row["lengths"].values, dtype=np.int64)
                codes = np.frombuffer(row["codes"].as_py() or b"", dtype=np.int32)
                n = np.frombuffer(row["counts"].as_py() or b"", dtype=np.int64)
                classes = np.array(row["classes"].values, dtype=np.int64)
                base = np.log10((n + 1) / (n_all + v_all + 1))
                classes[n < 2] = RARE
                within = np.log10(np.where(n > 1, n / np.maximum(class_n[classes], 1), np.where(n == 1, (1 - unseen) / max(once, 1), unseen)))
                sums = [group_sums(x[codes], lengths) for x in (base, within, n > 0)]
                out = np.empty(len(codes) + len(lengths), dtype=np.uint16)
                last = np.cumsum(lengths + 1) - 1
                keep = np.ones(len(out), dtype=bool)
                keep[last] = False
                out[last], out[keep] = END, classes[codes]
                columns = [
                    pa.array([row["doc_ids"].as_py()], pa.list_(row["doc_ids"].type.value_type)),
                    pa.array([row["held"].as_py()], pa.list_(pa.bool_())),
                    pa.array([lengths + 1]),
                    pa.array([out.tobytes()], pa.binary()),
                    pa.array([sums[2].astype(np.int64) + (ends > 0)]),
                    pa.array([sums[0] + np.log10((ends + 1) / (n_all + v_all + 1))]),
                    pa.array([sums[1].astype(float)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_ids", "held", "lengths", "classes", "n_known", "base", "within"])

    return joined.mapInArrow(prepare, f"doc_ids {kind}, held array<boolean>, lengths array<long>, classes binary, n_known array<long>, base array<double>, within array<double>")


def _expect(coded: DataFrame, model: tuple) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """One pass of Baum-Welch over the training documents: log10 likelihood and expected counts.

    Each task adds up its blocks; tasks' sums are added in rounds of sixteen, so no group receives more, however many tasks there are.
    """
    parts = max(1, coded.rdd.getNumPartitions())
    sent = coded.sparkSession.sparkContext.broadcast(model)
    states = len(model[0])

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, TaskContext.get().partitionId() // 16
        for batch in batches:
            for at in range(batch.num_rows):
                lengths, held = np.asarray(batch["lengths"][at].values, dtype=np.int64), np.asarray(batch["held"][at].values)
                classes = np.frombuffer(batch["classes"][at].as_py(), dtype=np.uint16)
                classes, lengths = classes[np.repeat(~held, lengths)].astype(np.int64), lengths[~held]
                logs, starts, moves, emissions = _forward(*sent.value, _windows(lengths), classes, backward=True)
                own = np.concatenate(([logs.sum()], starts, moves.ravel(), emissions.ravel()))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py(), dtype=np.float64) for chunk in table["sums"].chunks for b in chunk)
        return pa.table({"part": pa.array([table["part"][0].as_py() // 16], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, sums binary"
    added = coded.select("lengths", "held", "classes").mapInArrow(expect, schema).groupBy("part").applyInArrow(add, schema)
    parts = -(-parts // 16)
    while parts > 1:
        added, parts = added.groupBy("part").applyInArrow(add, schema), -(-parts // 16)
    rows = added.collect()  # one row
    total = np.frombuffer(rows[0]["sums"], dtype=np.float64) if rows else np.zeros(1 + states + states**2 + states * (END + 1))
    starts, moves, emissions = np.split(total[1:], [states, states + states**2])
    return float(total[0]), starts, moves.reshape(states, states), emissions.reshape(states, -1)


def _initial(prior: np.ndarray, states: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States that last, each with its own random tilt of the corpus's class frequencies."""
    rng = np.random.default_rng(seed)
    tilt = prior * np.exp(rng.normal(0, 0.8, (states, len(prior))))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return np.full(states, 1 / states), move, np.ascontiguousarray((tilt / tilt.sum(axis=1, keepdims=True)).T)


def _maximise(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, prior: np.ndarray, weight: float = 50.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smoothed maximum: every state keeps a share of the corpus's class frequencies, so nothing has probability zero."""
    start = (starts + 1) / (starts + 1).sum()
    move = (moves + 1) / (moves + 1).sum(axis=1, keepdims=True)
    emit = emissions + weight * prior
    return start, move, np.ascontiguousarray((emit / emit.sum(axis=1, keepdims=True)).T)


def score_documents(docs: DataFrame, held_out: Column, states: int = 6, rounds: int = 4, seed: int = 11) -> DataFrame:
    """Train on the documents for which ``held_out`` is not true and score all.

    Tokens are the words between ASCII white space, A-Z lower-cased, then one end. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10); a text's score sums, over all state paths, the probabilities of its tokens.
    A word that training lacks has the probability of the one unseen word. A null or empty text is the end alone; a null ``held_out`` counts as false; repeated rows are scored each. Without training rows, all words are unknown; an empty table gives no rows.
    """
    spark = docs.sparkSession
    blocks = materialise(code_blocks(docs, held_out))
    counts = materialise(count_words(blocks))
    first, taught, n = F.col("first"), F.col("taught"), F.col("n")
    by_class = counts.groupBy("class").agg(
        F.sum("taught").alias("all"), F.sum(F.when(n > 1, taught).otherwise(0)).alias("often"),
        F.count_if(first & (n > 0)).alias("words"), F.count_if(first & (n == 1)).alias("once"), F.count_if(first & (n == 2)).alias("twice"),
    ).collect()  # at most CLASSES rows
    class_n = np.zeros(END + 1, dtype=np.int64)
    for r in by_class:
        class_n[r["class"]] = r["often"]
    once, twice = sum(r["once"] for r in by_class), sum(r["twice"] for r in by_class)
    ends = blocks.select(F.explode("held").alias("h")).agg(F.count_if(~F.col("h"))).first()[0]
    n_all, v_all = sum(r["all"] for r in by_class) + ends, sum(r["words"] for r in by_class) + (ends > 0)
    unseen = (once + 1) / (once + 2 * twice + 2)
    coded = materialise(_prepare(blocks, counts, (n_all, v_all, class_n, once, unseen), ends))
    class_n[RARE], class_n[END] = once, ends
    prior = (class_n + 1e-3) / (class_n + 1e-3).sum()
    prior[RARE], prior[END] = max(prior[RARE], 1e-4), max(prior[END], 1e-4)
    prior /= prior.sum()
    model = _initial(prior, states, seed)
    for _ in range(rounds):
        _, starts, moves, emissions = _expect(coded, model)
        model = _maximise(starts, moves, emissions, prior)
    sent = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                lengths = np.asarray(batch["lengths"][at].values, dtype=np.int64)
                classes = np.frombuffer(batch["classes"][at].as_py(), dtype=np.uint16).astype(np.int64)
                logs = _forward(*sent.value, lengths, classes)
                own = [batch[c][at].values for c in ("doc_ids", "held", "lengths", "n_known", "base")]
                whole = np.asarray(batch["within"][at].values) + logs
                yield pa.RecordBatch.from_arrays(
                    [*own[:4], pa.array(np.full(len(lengths), n_all, dtype=np.int64)), own[4], pa.array(whole)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return coded.mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
