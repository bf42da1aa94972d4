"""Order MinHash fingerprints in DataFrame operations only.

A text's k-mers are runs of three tokens; a token is up to 16 characters of a word with the white space before it. Equal k-mers are numbered in text order, so a k-mer and its number occur once.
A hash deals the k-mers among the sketches; each sketch ranks its own first, then all others, by a hash of its own, so long texts are sampled evenly and short ones fill every sketch. It selects two minimal ones, the least of each of two halves that a bit of the k-mer's hash makes, another bit for each sketch. Their hash in the order in which they stand in the text is the sketch, so it changes when words change and when they change places.
A sketch one of whose halves is empty, which a text of n k-mers has once in 2 ** (n - 1) sketches, is that of its only least k-mer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialise, partitions

#: Fixed value: a token of a text.
TOKEN = r"(?s)\s*\S{1,16}|\s+"
#: A sketch is kept as 6 bits of its number and 26 bits of its hash; a place in the text has 28 bits.
SKETCHES, HASH_BITS, AT_BITS, GROUP = 64, 26, 28, 8
_LOW = (1 << AT_BITS) - 1


def order_minhash(rows: DataFrame, keys: Sequence[str], text: str, dealt: bool = False) -> DataFrame:
    """One row for each value of ``keys``: the keys and ``pairs``, the sketches as sorted integers (number in the high bits, hash of the tuple in the low ones).

    Rows are moved once, by key, before texts are cut up; ``dealt`` says that they already lie together by some of the keys. A text with no token has no pairs.
    """
    rows = rows if dealt else rows.repartition(*keys)
    words = rows.select(*keys, F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("__words"))
    words = words.select(*keys, "__words", F.posexplode_outer("__words").alias("__at", "__word"))
    kmer = F.xxhash64("__word", F.get("__words", F.col("__at") + 1), F.get("__words", F.col("__at") + 2))
    kmers = words.select(*keys, "__at", F.when(F.col("__at").isNotNull(), kmer).alias("__kmer"))
    # The hash stands first in the order, where it decides nearly every comparison.
    number = F.row_number().over(Window.partitionBy("__kmer", *keys).orderBy("__at"))
    hashed = kmers.select(*keys, "__at", F.when(F.col("__at").isNotNull(), F.xxhash64("__kmer", number)).alias("__h"))
    # A k-mer goes through its sketches in groups: one row for all of them makes code too wide to compile, one for each sketch costs a look-up each.
    grouped = hashed.withColumn("__g", F.explode(F.array([F.lit(g) for g in range(0, SKETCHES, GROUP)])))
    least = [F.expr(f"min(CASE WHEN {_second(i)} = {bit} THEN {_element(i)} END)").alias(f"__{half}{i}") for i in range(GROUP) for half, bit in (("a", 0), ("b", 1))]
    part = F.expr(f"CASE WHEN __a0 IS NULL AND __b0 IS NULL THEN cast(array() AS array<int>) ELSE array({', '.join(map(_sketch, range(GROUP)))}) END")
    parts = grouped.groupBy(*keys, "__g").agg(*least).select(*keys, part.alias("__part"))
    return parts.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("__part"))).alias("pairs"))


def _second(i: int) -> str:
    """1 if a k-mer is in the second half of the group's sketch ``i``: one bit of its hash, another for each sketch."""
    return f"getbit(__h, __g + {i})"


def _element(i: int) -> str:
    """A k-mer's rank for the group's sketch ``i`` in the high bits (those of its own cell first, then by the sketch's hash), its place in the text in the low ones."""
    ranked = f"xxhash64(__h ^ (__g + {i + 1}))"
    return f"(if(shiftrightunsigned(__h, 58) = __g + {i}, {ranked} | shiftleft(1L, 63), {ranked} & {(1 << 63) - 1}L) & {~_LOW}L | __at)"


def _sketch(i: int) -> str:
    """The hash of the two halves' least elements in text order, or of the only one, as an integer with the sketch's number."""
    a, b = f"shiftright(__a{i}, {AT_BITS})", f"shiftright(__b{i}, {AT_BITS})"
    mark = f"if(__b{i} IS NULL OR (__a{i} & {_LOW}) <= (__b{i} & {_LOW}), hash({a}, {b}), hash({b}, {a}))"
    return f"shiftleft(__g + {i}, {HASH_BITS}) | ({(1 << HASH_BITS) - 1} & {mark})"


def as_text(pairs: Column) -> Column:
    """Eight hex digits for each sketch that the text fills."""
    return F.array_join(F.transform(pairs, lambda p: F.lpad(F.lower(F.hex(p.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the sketches filled in either text that agree; 1 for two texts that fill none."""
    same = F.size(F.array_intersect(a, b))
    filled = F.size(F.array_union(F.transform(a, lambda p: F.shiftrightunsigned(p, HASH_BITS)), F.transform(b, lambda p: F.shiftrightunsigned(p, HASH_BITS))))
    return F.when(filled == 0, F.lit(1.0)).otherwise(same / filled)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row; a null text counts as empty and has the empty fingerprint. Needs doc_id and text."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("__t", F.xxhash64("text"))
    texts = keyed.select("__t", F.xxhash64(F.reverse("text")).alias("__u"), "text")
    marks = order_minhash(texts.dropDuplicates(["__t", "__u"]), ["__t", "__u"], "text")
    owners = keyed.select("doc_id", "__t", F.xxhash64(F.reverse("text")).alias("__u"))
    return owners.join(marks, ["__t", "__u"]).select("doc_id", as_text(F.col("pairs")).alias("fingerprint"))


def neighbours(docs: DataFrame) -> DataFrame:
    """For each (k, t) its length n, its number of rows, and k, t and n of the rows before and after it in the order of (k, t); the ends meet.

    Only keys move: a range exchange, a lead and lag within each range, and the first and last key of each range (a row a partition) to close the gaps.
    """
    spark = docs.sparkSession
    keys = docs.groupBy("k", "t").agg(F.first("n").alias("n"), F.count("*").alias("copies"))
    ranged = materialise(keys.repartitionByRange(partitions(spark), "k", "t").withColumn("range", F.spark_partition_id()))
    key = F.struct("k", "t", "n")
    ends = ranged.groupBy("range").agg(F.min(key).alias("first"), F.max(key).alias("last")).orderBy("range").collect()
    around = [(r["range"], ends[i - 1]["last"], ends[(i + 1) % len(ends)]["first"]) for i, r in enumerate(ends)]
    kind = "struct<k:long,t:long,n:int>"
    gaps = spark.createDataFrame(around, f"range int, __before {kind}, __after {kind}")
    order = Window.partitionBy("range").orderBy("k", "t")
    linked = ranged.withColumns({"previous": F.lag(key).over(order), "next": F.lead(key).over(order)}).join(F.broadcast(gaps), "range")
    return linked.select("k", "t", "n", "copies", F.coalesce("previous", "__before").alias("previous"), F.coalesce("next", "__after").alias("next"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has the last floor(n_chars / 2) characters replaced by the first as many (or all) of the next document's, in the order of doc_id, then of a hash of the text; after the last row comes the first. A single row follows itself.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. A null text counts as empty; a null doc_id orders first; rows alike in both are one document, returned as often as it occurs. An empty table gives no rows.
    """
    low = -(1 << 63)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumns({"t": F.xxhash64("text"), "n": F.length("text")})
    links = materialise(neighbours(keyed))
    if (links.agg(F.max("copies")).first()[0] or 0) > 1:
        keyed = keyed.dropDuplicates(["k", "t"])
    # A text's tokens take many times its room, so texts are dealt finer than other rows.
    linked = keyed.select("k", "t", "text").repartition(4 * partitions(docs.sparkSession), "k", "t").join(links.hint("merge"), ["k", "t"])
    heads = linked.select(F.col("previous.k").alias("k"), F.col("previous.t").alias("t"), F.left("text", F.floor(F.col("previous.n") / 2).cast("int")).alias("head"))
    both = linked.join(heads.hint("merge"), ["k", "t"])
    edited = F.concat(F.left("text", F.col("n") - F.floor(F.col("n") / 2).cast("int")), "head")
    texts = both.select("k", "t", F.explode(F.array(F.struct(F.lit(0).alias("kind"), "text"), F.struct(F.lit(1).alias("kind"), edited.alias("text")))).alias("x"))
    sketches = order_minhash(texts.select("k", "t", "x.kind", "x.text"), ["k", "t", "kind"], "text", dealt=True)
    sketches = sketches.groupBy("k", "t").agg(F.max(F.when(F.col("kind") == 0, F.col("pairs"))).alias("own"), F.max(F.when(F.col("kind") == 1, F.col("pairs"))).alias("changed"))
    facts = both.select("k", "t", "n", "copies", "previous", F.sha2(edited, 256).alias("edited_sha256"))
    done = materialise(facts.join(sketches.hint("merge"), ["k", "t"]))
    following = done.select(F.col("previous.k").alias("k"), F.col("previous.t").alias("t"), F.col("own").alias("after"))
    out = done.drop("previous").join(following, ["k", "t"])
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        F.when(F.col("k") != low, F.col("k")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
