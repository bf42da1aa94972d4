"""What several operators share: scratch tables, text batches and word codes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master, whose tasks run in the driver, may do without and takes a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(spark, "_docloom_scratch", None):
        spark._docloom_scratch = tempfile.mkdtemp(prefix="docloom-")
    return spark._docloom_scratch


def shared_path(spark: SparkSession, name: str = "scratch") -> str:
    """A new path in the shared folder. Its files go when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


#: Parquet options for rows of a megabyte or so: a reader holds a row group at once.
LARGE_ROWS = {"parquet.block.size": 4 << 20, "parquet.block.row.count.limit": 4, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def materialise(df: DataFrame, **options) -> DataFrame:
    """Write a frame to the shared folder once and read it back: cut lineage that survives lost executors.

    The files go when the session's JVM ends. ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), dtype=np.int64)
        start, ends = 0, np.cumsum(sizes)
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def word_codes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space: how many a text has, a code for each, and the distinct words.

    Null is taken as the empty text; only A-Z are lower-cased.
    """
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    counts = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    flat = pc.list_flatten(lists)
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
    if empty.any():  # an empty text is split into one empty word
        keep = np.ones(len(flat), dtype=bool)
        keep[(np.cumsum(counts) - counts)[empty & (counts > 0)]] = False
        flat, counts = flat.filter(pa.array(keep)), np.where(empty, 0, counts)
    coded = flat.dictionary_encode()
    return counts, np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def strings(words: pa.Array) -> list[str]:
    """The words as Python strings, faster than one by one."""
    return words.to_numpy(zero_copy_only=False).tolist()


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in strings(words)), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit scramble."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of so many words, and how many each text has; a shorter text has one run, an empty one none."""
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    starts = np.cumsum(counts) - counts
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    ends = np.repeat(starts + counts, n)
    out = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            inside = at + k < ends
            part = np.where(inside, hashes[np.minimum(at + k, len(hashes) - 1)] if len(hashes) else 0, np.uint64(0))
            out = out * np.uint64(0xD6E8FEB86659FD93) + part + inside.astype(np.uint64)
    return mix(out), n


def group_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def doc_number(column: str = "doc_id"):
    """crc32 of an id written as text, as the contracts deal out their folds; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def empty_like(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)
