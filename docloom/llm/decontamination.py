"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so a question with other values keeps its template. Windows of template words of the texts meet those of the benchmark in a hash join; a bit filter of fixed size, sent to the tasks, keeps windows that cannot match out of the exchange.
An item counts as found where enough of its windows occur and its placeholders take values consistently: one value of the item always stands for one value of the text.
An item of seven words or more, all of whose windows are rich in placeholders, has wider ones in their place, of up to ten words.
Windows as written go through the same filter and join, so that items of few words, and copies in another letter case, are found literally.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialise, mix, slices, strings, windows, word_codes, word_hashes
from docloom.llm.tokens import PUNCTUATION

#: Words taken as units behind a number, and as numbers.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds ounce ounces ml l liter liters litre litres "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent % dollar dollars euro euros cent cents "
    "degree degrees °c °f mph km/h kw kwh watt watts volt volts hz khz mhz ghz kb mb gb tb"
).split()
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
WIDTH, WIDE, WIDEST, FILTER_BITS = 5, 7, 10, 25
#: An item of fewer words counts only as a whole text: a single word stands in too many.
LEAST_WORDS = 3
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3


def templates(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Words of each text, then for each word its template hash, its type and its code; last the distinct words, in lower case without punctuation at their ends.

    A number is digits with points, signs and the like, or a number word. A unit follows a number. A name starts with its only capital, and not at the start of a text or sentence. Words of punctuation alone are left out.
    """
    counts, codes, words = word_codes(texts, lower=False)
    stems = pc.ascii_trim(words, PUNCTUATION.replace("%", ""))
    lower = pc.utf8_lower(stems)
    number = np.asarray(pc.or_(pc.match_substring_regex(lower, r"^\pN[\pN.,:/%-]*$"), pc.is_in(lower, pa.array(NUMBER_WORDS))), dtype=bool)
    unit = np.asarray(pc.is_in(lower, pa.array(UNITS)), dtype=bool)
    capital = np.asarray(pc.match_substring_regex(stems, r"^\p{Lu}[^\p{Lu}]*$"), dtype=bool)
    ends = np.asarray(pc.match_substring_regex(words, r"[.!?:]['\")\]]*$"), dtype=bool)
    blank = np.asarray(pc.equal(pc.binary_length(stems), 0), dtype=bool)
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.ones(len(codes), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | ends[codes[:-1]]
    keep = ~blank[codes]
    codes, row, first = codes[keep], row[keep], first[keep]
    kind = np.zeros(len(codes), dtype=np.int8)
    kind[capital[codes] & ~first] = NAME
    kind[number[codes]] = NUMBER
    after = np.zeros(len(codes), dtype=bool)
    after[1:] = (kind[:-1] == NUMBER) & (row[1:] == row[:-1])
    kind[after & unit[codes]] = UNIT
    distinct = lower.dictionary_encode()
    hashes = word_hashes(distinct.dictionary)[np.asarray(distinct.indices, dtype=np.int64)]
    own = np.where(kind == LITERAL, hashes[codes], mix(kind.astype(np.uint64), 99))
    return np.bincount(row, minlength=len(counts)), own, kind, codes, lower


def _led_windows(plain: np.ndarray, own: np.ndarray, kind: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of template windows whose first word, if a name, stands as it is written: an item's first word has its capital from its place. Also where that is so."""
    if not len(own):
        return np.zeros(len(start), dtype=np.uint64), np.zeros(len(start), dtype=np.int64)
    last, out = len(own) - 1, np.zeros(len(start), dtype=np.uint64)
    named = kind[np.minimum(start, last)] == NAME
    with np.errstate(over="ignore"):
        for k in range(size):
            at = np.minimum(start + k, last)
            out = mix(out ^ (np.where(named, plain[at], own[at]) if k == 0 else own[at]), 200 + size)
    return out, named.astype(np.int64)


def _all_windows(rows: DataFrame, key: str, widths: tuple[int, ...], bits=None) -> DataFrame:
    """(key, h, at, width, n_windows, slots) of each window; with ``bits``, of those that the filter lets pass.

    Width 0 stands for template windows, those of five words with more literals than placeholders; ``slots`` are the values at the placeholders, in order. A negative width stands for template windows of so many words with a literal in them: without ``bits`` only a text has them that has none of width 0, of ten words, or of all its words if they are fewer.
    The other widths are runs of so many words as they are written, but for case and punctuation at their ends. Without ``bits`` a text under five words has one run, the whole of it, and a text of placeholders alone none; with ``bits`` a run under three words must be all of its text.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=4 << 20):
            counts, own, kind, codes, words = templates(batch["text"])
            plain = word_hashes(words)[codes] if widths else own
            held = np.concatenate(([0], np.cumsum(kind != LITERAL)))
            ends = np.cumsum(counts)
            worded = held[ends] - held[ends - counts] < counts
            plainly = np.ones(len(counts), dtype=bool)  # texts without a template window of five
            for width in (0, *widths):
                size = abs(width) or WIDTH
                hashes, n = windows(plain if width > 0 else own, counts, size)
                row = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(ends - counts, n) + at
                keep = np.repeat(counts, n) >= size
                slots = np.zeros(len(row), dtype=np.int64) if width > 0 else held[np.minimum(start + size, len(kind))] - held[start]
                if width > 0:
                    hashes = mix(hashes, 100 + width)
                    if bits is None:
                        keep &= np.repeat(worded & ((counts == width) | (width == WIDTH)), n)
                    elif width < LEAST_WORDS:
                        keep &= np.repeat(counts == width, n)
                elif width:
                    hashes, named = _led_windows(plain, own, kind, start, size)
                    slots = slots - named
                    keep &= slots < size
                    if bits is None:
                        keep &= np.repeat(plainly & (np.minimum(counts, WIDEST) == size), n)
                else:
                    keep &= 2 * slots < WIDTH
                    plainly[row[keep]] = False
                total = np.bincount(row[keep], minlength=len(n))
                if bits is not None:
                    table = bits.value
                    for salt in (1, 2):
                        place = (mix(hashes, salt) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                        keep &= (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                took = np.flatnonzero(keep)
                values: list[list[str]] = [[] for _ in took]
                for i in np.flatnonzero(slots[took]):
                    a = start[took[i]] + (1 if width < 0 and kind[start[took[i]]] == NAME else 0)
                    values[i] = strings(words.take(pa.array(codes[a : start[took[i]] + size][kind[a : start[took[i]] + size] != LITERAL])))
                yield pa.RecordBatch.from_arrays(
                    [batch[key].take(pa.array(row[took])), pa.array(hashes[took].view(np.int64)), pa.array(at[took]), pa.array(np.full(len(took), width, dtype=np.int32)), pa.array(total[row[took]]), pa.array(values, pa.list_(pa.string()))],
                    names=[key, "h", "at", "width", "n_windows", "slots"],
                )

    kind_of = rows.schema[key].dataType.simpleString()
    return rows.select(key, "text").mapInArrow(find, f"{key} {kind_of}, h long, at long, width int, n_windows long, slots array<string>")


def _filter_of(items: DataFrame) -> np.ndarray:
    """2**25 bits that tell which window hashes the benchmark may have: 4 MB, whatever its size."""

    @F.pandas_udf("array<int>")
    def place(h: pd.Series) -> pd.Series:
        own = h.to_numpy().view(np.uint64)
        return pd.Series(list(np.stack([mix(own, s) >> np.uint64(64 - FILTER_BITS) for s in (1, 2)], axis=1).astype(np.int32)))

    places = items.select(F.explode(place("h")).alias("p"))
    words = places.groupBy(F.shiftright("p", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, p & 31)")).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 5), dtype=np.uint32)
    for batch in words.toArrow().to_batches():  # at most 2**20 rows
        out[np.asarray(batch["word"])] = np.asarray(batch["bits"]).astype(np.uint32)
    return out.view(np.uint8)


def find_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.4, literal_coverage: float = 0.6) -> DataFrame:
    """Which documents hold which benchmark items: (doc_id, item_id, n_windows, n_found, coverage, n_slots, changed_slots).

    A pair is returned if at least ``coverage`` of the item's template windows, or of its windows as written, are in the document with consistent slots: an old value has one new value, which others may share. From ``literal_coverage`` of the windows as written on, slots do not matter.
    An item under five words is found where all of it is, one under three where it is the whole text. ``changed_slots`` counts the item's values that stand for another value in the document: above 0 for a question with new parameters.
    Windows on the diagonal (place in the document less place in the item) where most of them lie decide which values belong together.
    Null and empty texts hold nothing; items of placeholders alone match nothing. Repeated rows count once; rows sharing a doc_id (null too) are one document. Empty tables give no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id"), "text").filter(F.col("item_id").isNotNull())
    items = materialise(_all_windows(items, "item_id", (*range(1, WIDTH + 1), *range(-WIDEST, -WIDE + 1))).dropDuplicates(["item_id", "at", "width", "h"]))
    widths = tuple(sorted(r["width"] for r in items.filter("width <> 0").select("width").distinct().collect()))  # at most eleven
    bits = spark.sparkContext.broadcast(_filter_of(items))
    found = _all_windows(docs.select("doc_id", "text"), "doc_id", widths, bits)
    a, b = found.alias("a"), items.alias("b")
    pairs = a.join(b, ["h", "width"]).select(
        "a.doc_id", "b.item_id", "b.n_windows", F.col("a.at").alias("doc_at"), F.col("b.at").alias("item_at"), (F.col("width") > 0).alias("plain"), F.arrays_zip(F.col("b.slots").alias("old"), F.col("a.slots").alias("new")).alias("slots")
    )
    pairs = pairs.withColumn("diagonal", F.col("doc_at") - F.col("item_at"))
    kinds = {"": ~F.col("plain"), "plain_": F.col("plain")}
    lines = pairs.groupBy("doc_id", "item_id", "diagonal").agg(
        *[F.max(F.when(own, F.col("n_windows"))).alias(f"{k}n_windows") for k, own in kinds.items()],
        *[F.collect_set(F.when(own, F.col("item_at"))).alias(f"{k}at") for k, own in kinds.items()],
        F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"),
    )
    whole = lines.groupBy("doc_id", "item_id").agg(
        *[F.max(f"{k}n_windows").alias(f"{k}n_windows") for k in kinds],
        *[F.size(F.array_distinct(F.flatten(F.collect_list(f"{k}at")))).cast("long").alias(f"{k}n_found") for k in kinds],
        F.max_by("slots", F.struct(F.size("at"), -F.col("diagonal"))).alias("slots"),
    )
    olds = F.transform("slots", lambda s: s["old"])
    whole = whole.withColumns(
        {
            "coverage": F.coalesce(F.col("n_found") / F.col("n_windows"), F.lit(0.0)),
            "plain_coverage": F.coalesce(F.col("plain_n_found") / F.col("plain_n_windows"), F.lit(0.0)),
            "n_slots": F.size(F.array_distinct(olds)).cast("long"),
            "changed_slots": F.size(F.array_distinct(F.filter("slots", lambda s: s["old"] != s["new"]))).cast("long"),
        }
    )
    by_template = (F.col("coverage") >= coverage) & (F.size("slots") == F.col("n_slots"))
    as_written = (F.col("plain_coverage") >= literal_coverage) | ((F.col("plain_coverage") >= coverage) & (F.size("slots") == F.col("n_slots")))
    shown = [F.when(by_template, F.col(c)).otherwise(F.col(f"plain_{c}")).alias(c) for c in ("n_windows", "n_found", "coverage")]
    return whole.filter(by_template | as_written).select("doc_id", "item_id", *shown, "n_slots", "changed_slots")
