"""Token counts by rule, costs and chunk options as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What adds to (or takes from) a count, by weight; products are cut to whole numbers.
LEGAL_PATTERNS = (
    (r"\b(?:\d+\s+[A-Z][a-z]+\.?\s+\d+|[A-Z][a-z]+\s+v\.?\s+[A-Z][a-z]+)\b", 2.0),
    (r"\b(?:§|Section|Sec\.?)\s*\d+(?:\.\d+)*\b", 1.5),
    (r"(?i)\b(?:whereas|therefore|provided\s+that|subject\s+to|notwithstanding|pursuant\s+to)\b", 0.5),
    (r"\b\d+\s+[A-Z][a-z]+\.?\s+\d+d?\s+\d+\b", 2.5),
    (r"\b(?:Inc\.|Corp\.|LLC|Ltd\.|L\.P\.|P\.C\.|LLP)\b", -0.5),
)


def char_tokens(text: Column, per: int = 4) -> Column:
    """Characters over four, rounded down; 0 for null."""
    return F.coalesce(F.floor(F.length(text) / per), F.lit(0)).cast("long")


def legal_tokens(text: Column, base: Column) -> Column:
    """A base count adjusted for citations, statutes, legal terms, case law and abbreviations."""
    out = base
    for pattern, weight in LEGAL_PATTERNS:
        found = F.regexp_count(text, F.lit(pattern))
        part = F.floor(found * abs(weight)).cast("long")
        out = out + part if weight > 0 else out - part
    return out


def cost(tokens: Column, per_thousand: float = 0.0001) -> Column:
    return F.round(tokens / 1000 * per_thousand, 6)


def optimal_chunk_size(tokens: Column, chunks: int = 10) -> Column:
    return F.greatest(F.lit(100), F.floor(tokens / chunks)).cast("long")


def optimal_overlap(size: Column, long_context: Column) -> Column:
    """15 % of the size (12.5 % without a long context), from 50 to 200."""
    share = F.when(long_context, size * 0.15).otherwise(size * 0.125)
    return F.greatest(F.lit(50), F.least(F.lit(200), F.floor(share))).cast("long")


def valid_overlap(size: Column, overlap: Column) -> Column:
    """An overlap of the size or more becomes a quarter of it, a negative one none."""
    return F.when(overlap < 0, 0).when(overlap >= size, F.floor(size / 4)).otherwise(overlap).cast("long")
