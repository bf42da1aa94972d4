"""Training-order materialisation: token sequences at the slots of a keyed permutation, in fixed-stride shards.

Every text becomes pieces of at most ``stride`` ids, padded to the stride. Pieces are numbered 0 to n-1; a Feistel network with cycle-walking permutes the numbers.
A slot's place in the output follows from arithmetic alone: shard, row and byte offset; reading can start at any slot.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import tokens
from docloom.llm.common import LARGE_ROWS, materialise, mix, partitions, shared_path, slices


def feistel(numbers: np.ndarray, size: int, key: int, rounds: int = 6) -> np.ndarray:
    """A permutation of 0..size-1 that the key fixes. Numbers that leave the range walk on until they are back."""
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for r in range(rounds):
            left, right = right, left ^ (mix(right, key * rounds + r) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


Batches = Iterator[pa.RecordBatch]
ABOUT = ("doc_id", "piece", "n_tokens", "sequence", "slot")


def chunks(docs: DataFrame, stride: int, path: str, end_id: int, pad_id: int) -> DataFrame:
    """Pieces of every document, some megabytes of text a row: the task, the number of pieces it made before, doc_id, piece and n_tokens of each piece, and the ids, padded to the stride and compressed."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Batches) -> Batches:
        encoder, part, first = tokens.encoder(path), TaskContext.get().partitionId(), 0
        for batch in slices(batches, limit=2 << 20):
            counts, ids = encoder.encode(batch["text"])
            total = counts + 1
            n = -(-total // stride)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            out = np.full(len(row) * stride, pad_id, dtype="<u4")
            base = (np.cumsum(n) - n) * stride
            out[np.repeat(base - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))] = ids
            out[base + counts] = end_id
            lists = [listed(x) for x in (batch["doc_id"].take(pa.array(row)), pa.array(piece), pa.array(np.minimum(stride, total[row] - piece * stride)))]
            data = pa.array([zstandard.compress(out.tobytes())], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first]), pa.array([len(row)]), *lists, data], names=["part", "first", "n", *ABOUT[:3], "data"])
            first += len(row)

    return docs.select("doc_id", "text").mapInArrow(cut, f"part int, first long, n long, doc_id array<{kind}>, piece array<long>, n_tokens array<long>, data binary")


def listed(values: pa.Array) -> pa.ListArray:
    """One list that holds all the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def fixed_blobs(data: np.ndarray, size: int) -> pa.Array:
    """A binary column of values of one size from their bytes."""
    n = data.size // size
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * size)
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(data)])


def numbered(docs: DataFrame, key: int, stride: int, end_id: int, pad_id: int, path: str | None) -> tuple[DataFrame, Callable[[Batches], Batches], int]:
    """The written chunks, a function that turns them into rows (doc_id, piece, n_tokens, sequence, slot, ids) in a task, and the number of sequences.

    A sequence's number is its place in the written chunks: the number of sequences of the tasks before, one figure a task, and its place in its own task.
    """
    cut = materialise(chunks(docs, stride, path or tokens.default_path(), end_id, pad_id), **LARGE_ROWS)
    sums = {r["part"]: r["n"] for r in cut.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a number for each partition
    size, before = 0, {}
    for part in sorted(sums):
        before[part], size = size, size + sums[part]
    sent = docs.sparkSession.sparkContext.broadcast(before)

    def rows(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(batch.num_rows):
                sequence = sent.value[batch["part"][at].as_py()] + batch["first"][at].as_py() + np.arange(batch["n"][at].as_py())
                ids = np.frombuffer(zstandard.decompress(batch["data"][at].as_py()), dtype=np.uint8)
                lists = [batch[c][at].values for c in ABOUT[:3]]
                yield pa.RecordBatch.from_arrays([*lists, pa.array(sequence), pa.array(feistel(sequence, size, key)), fixed_blobs(ids, 4 * stride)], names=[*ABOUT, "ids"])

    return cut, rows, size


def training_order(docs: DataFrame, key: int = 20_240_501, stride: int = 512, shard_rows: int = 8192, end_id: int = 1, pad_id: int = 0, path: str | None = None) -> DataFrame:
    """Every sequence with its number, its slot in training order and its place in the shards.

    Columns: doc_id, piece, n_tokens, ids, ids_crc32, sequence, slot, shard, shard_row, byte_offset. A null or empty text is one sequence of the end id; rows alike are sequences of their own.
    Sequences are numbered as they lie in the input, partition by partition: the same partitions give the same order. Only one count a partition reaches the driver. An empty table gives no rows.
    """
    cut, rows, _ = numbered(docs, key, stride, end_id, pad_id, path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = cut.mapInArrow(rows, f"doc_id {kind}, piece long, n_tokens long, sequence long, slot long, ids binary")
    return out.select(
        "doc_id", "piece", "n_tokens", "ids", F.crc32("ids").alias("ids_crc32"), "sequence", "slot",
        F.expr(f"slot div {shard_rows} AS shard"), F.expr(f"slot % {shard_rows} AS shard_row"), F.expr(f"(slot % {shard_rows}) * {4 * stride}L AS byte_offset"),
    )


def parcels(batches: Batches, shard_rows: int) -> Batches:
    """Rows of (doc_id, piece, n_tokens, sequence, slot, ids), gathered by shard within each batch, ids compressed."""
    for batch in batches:
        shard = np.asarray(batch["slot"]) // shard_rows
        order = np.argsort(shard, kind="stable")
        batch, shard = batch.take(pa.array(order)), shard[order]
        starts = np.flatnonzero(np.diff(shard, prepend=-1))
        ends = np.append(starts[1:], len(shard))
        ids = blob_bytes(batch["ids"])
        width = len(ids) // max(1, len(shard))
        lists = [pa.ListArray.from_arrays(pa.array(np.append(starts, len(shard)).astype(np.int32)), batch[c]) for c in ABOUT]
        data = [zstandard.compress(ids[a * width : b * width].tobytes()) for a, b in zip(starts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(shard[starts]), *lists, pa.array(data, pa.binary())], names=["shard", *ABOUT, "data"])


def blob_bytes(column: pa.Array) -> np.ndarray:
    """The bytes of a column of binary values without nulls, without a copy."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]


def write_shards(ordered: DataFrame, path: str, shard_rows: int = 8192, block_rows: int = 512, rows: Callable[[Batches], Batches] | None = None, size: int | None = None) -> None:
    """Write slots in order as Parquet blocks of a fixed number of fixed-stride rows, range-partitioned by slot.

    ``ordered`` has the rows of ``training_order``, or what the function ``rows`` turns into such rows within a task. Slots are 0 to ``size`` - 1.
    Block k holds the slots from k * block_rows on; each of its rows takes the same number of bytes, so a reader finds any slot by arithmetic.
    Beside its bytes a block lists the doc_id, piece, n_tokens and sequence of its rows. ``block_rows`` must divide ``shard_rows``. The last block may be shorter.
    Sequences move once, those of a batch bound for one shard as one compressed parcel; a task holds one shard at a time.
    """
    size = ordered.count() if size is None else size
    if rows is None:
        ordered = ordered.select(*ABOUT, "ids")
        types = [ordered.schema[c].dataType.simpleString() for c in ABOUT]
    else:
        types = [ordered.schema["doc_id"].dataType.elementType.simpleString(), "bigint", "bigint", "bigint", "bigint"]
    lists = {c: f"{c} array<{t}>" for c, t in zip(ABOUT, types, strict=True)}

    def pack(batches: Batches) -> Batches:
        return parcels(rows(batches) if rows else batches, shard_rows)

    def blocks(table: pa.Table) -> Batches:
        shard, slots = table["shard"][0].as_py(), np.concatenate([np.asarray(x.values) for x in table["slot"]])
        ids = np.frombuffer(b"".join(zstandard.decompress(x.as_py()) for x in table["data"]), dtype=np.uint8).reshape(len(slots), -1)
        order = np.argsort(slots)
        flat = {c: pc.list_flatten(table[c].combine_chunks()).take(pa.array(order)) for c in ABOUT[:4]}
        for at in range(0, len(slots), block_rows):
            own = order[at : at + block_rows]
            head = [pa.array([shard]), pa.array([int(slots[own[0]]) // block_rows]), pa.array([len(own)]), pa.array([ids[own].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(head + [listed(x.slice(at, block_rows)) for x in flat.values()], names=["shard", "block", "n_rows", "data", *flat])

    def shards(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            own = np.asarray(batch["shard"])
            cuts = [0, *np.flatnonzero(np.diff(own)) + 1, len(own)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and b > a and held[0]["shard"][0] != batch["shard"][a]:
                    yield from blocks(pa.Table.from_batches(held))
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from blocks(pa.Table.from_batches(held))

    parts, n_shards = partitions(ordered.sparkSession), max(1, -(-size // shard_rows))
    packed = ordered.mapInArrow(pack, f"shard long, {', '.join(lists.values())}, data binary")
    dealt = packed.repartitionById(parts, F.expr(f"cast(shard * {parts} div {n_shards} AS int)")).sortWithinPartitions("shard")
    out = dealt.mapInArrow(shards, f"shard long, block long, n_rows long, data binary, {', '.join(lists[c] for c in ABOUT[:4])}")
    out.write.mode("overwrite").option("compression", "zstd").options(**LARGE_ROWS).parquet(path)


def placed(spark: SparkSession, path: str, shard_rows: int = 8192, block_rows: int = 512, stride: int = 512) -> DataFrame:
    """Every sequence of the written shards, its place and checksum taken from the blocks read back: shard and bytes as stored, row and offset by a row's place in its block."""
    width = 4 * stride
    stored = spark.read.parquet(path)
    kind = stored.schema["doc_id"].dataType.elementType.simpleString()

    def rows(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(batch.num_rows):
                data, n = batch["data"][at].as_buffer(), batch["n_rows"][at].as_py()
                view = memoryview(data)
                sums = pa.array([zlib.crc32(view[i * width : (i + 1) * width]) for i in range(n)], pa.int64())
                slot = batch["block"][at].as_py() * block_rows + np.arange(n)
                row = slot - batch["shard"][at].as_py() * shard_rows
                lists = [batch[c][at].values for c in ABOUT[:4]]
                shard = pa.array(np.full(n, batch["shard"][at].as_py()))
                yield pa.RecordBatch.from_arrays([*lists[:3], sums, lists[3], pa.array(slot), shard, pa.array(row), pa.array(row * width)], names=names)

    names = ["doc_id", "piece", "n_tokens", "ids_crc32", "sequence", "slot", "shard", "shard_row", "byte_offset"]
    return stored.mapInArrow(rows, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:]))


def materialised_order(docs: DataFrame, key: int = 20_240_501, stride: int = 512, shard_rows: int = 8192, block_rows: int = 512, end_id: int = 1, pad_id: int = 0, path: str | None = None) -> DataFrame:
    """The shards written to the shared folder, and every sequence as it was found there (the columns of ``training_order`` without ids)."""
    spark = docs.sparkSession
    cut, rows, size = numbered(docs, key, stride, end_id, pad_id, path)
    where = shared_path(spark, "shards")
    write_shards(cut, where, shard_rows, block_rows, rows, size)
    return placed(spark, where, shard_rows, block_rows, stride)


def read_slots(spark: SparkSession, path: str, start: int, count: int, stride: int = 512, block_rows: int = 512) -> Iterator[np.ndarray]:
    """The ids of so many slots from a slot on, one after the other: a resumed run reads only the blocks it needs, and holds one partition of them at a time."""
    first, last = start // block_rows, (start + count - 1) // block_rows
    for r in spark.read.parquet(path).filter(F.col("block").between(first, last)).orderBy("block").select("block", "data").toLocalIterator():
        ids = np.frombuffer(r["data"], dtype="<u4").reshape(-1, stride)
        at = r["block"] * block_rows
        yield from ids[max(0, start - at) : start + count - at]
