"""License scan in column expressions only: a positional index of rare licence words.

Each template (a licence's notice or the sentence its text opens with) is indexed by its rarest words, by document frequency over the whole corpus. A text's words are looked up; a hit gives, for each posting, the place where the template would begin. A template is a candidate where enough of its words agree on that place, give or take ``SLACK`` words, and is found if its mandatory phrases stand there word for word.
All is done within a row, so nothing is shuffled by document; only counts of the licence words move.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of the contract and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label, words of a notice or opening, mandatory phrases in it.
TEMPLATES = (
    ("agpl", "gnu affero general public license", ("affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document artistic license 2 0", ("artistic license 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsl-1.0", "boost software license version 1 0", ("boost software license",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    ("epl", "accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", ("express or implied warranty in no event will the authors be held liable",)),
)

#: A word as the contract has it, capitals included; case is folded on words, not on texts.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a template in the index, and by how many words their places may disagree.
RARE, SLACK = 6, 4
Rarity = dict[str, float]


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def fold(word: str) -> str:
    """SQL that lower-cases A to Z alone."""
    return f"translate({word}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def licence_words(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, words, _ in templates for w in words.split()})


def rarity(docs: DataFrame, templates=TEMPLATES) -> Rarity:
    """log((1 + documents) / (1 + documents that hold the word)) of each word of the templates, over all rows of ``docs`` (text). The driver gets one count a word."""
    words = licence_words(templates)
    found = docs.select(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)).alias("words"))
    own = f"array_distinct(transform(filter(words, w -> lower(w) IN ({_quoted(words)})), w -> {fold('w')}))"
    rows = found.select(F.explode(F.expr(f"concat(array(''), {own})")).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in rows}
    return {w: math.log((1 + counts.get("", 0)) / (1 + counts.get(w, 0))) for w in words}


def rare_places(rarities: Rarity, templates=TEMPLATES, rare: int = RARE) -> list[list[tuple[str, int]]]:
    """For each template its ``rare`` rarest words (by the alphabet among equals), each with the place where it stands first."""
    out = []
    for _, text, _ in templates:
        words = text.split()
        chosen = sorted(set(words), key=lambda w: (-rarities.get(w, 0.0), w))[:rare]
        out.append(sorted((w, words.index(w)) for w in chosen))
    return out


def scan(docs: DataFrame, rarities: Rarity, templates=TEMPLATES, base=BASE, rare: int = RARE, slack: int = SLACK) -> DataFrame:
    """The columns of ``docs`` (text) but for clashing ones, with n_words, n_base, first_word, last_word, base_labels, labels and score.

    n_base counts all places of base phrases, first_word and last_word are the least and greatest of their starts (words from 0), null without one. Labels of templates are added to the base ones; both lists are distinct, sorted and joined by commas, empty without a label.
    score is the largest share of a template's indexed words that agree on a place, halved where its mandatory phrases are lacking; at least 0.5 with a base phrase; 0 without a candidate.
    A null text counts as empty; repeated rows are judged alike; a text of any length is one row.
    """
    places = rare_places(rarities, templates, rare)
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, own in enumerate(places):
        for word, at in own:
            postings.setdefault(word, []).append((t, at))
    starts = sorted({phrase.split()[0] for phrase, _ in base})
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kept = [c for c in docs.columns if c not in made]
    held = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row")
    rows = docs.select(held, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)).alias("__words"))

    known = sorted({*postings, *starts})
    hit = f"lower(w) IN ({_quoted(known)}) AND {fold('w')} IN ({_quoted(known)})"
    hits = f"filter(transform(__words, (w, i) -> IF({hit}, struct({fold('w')} AS w, i AS i), NULL)), h -> h IS NOT NULL)"
    rows = rows.select("__row", "__words", F.expr("cast(size(__words) AS long)").alias("n_words"), F.expr(hits).alias("__hits"))

    def stands(phrase: str, at: str) -> str:
        """Whether the phrase's words stand from a place on."""
        return " AND ".join(f"{fold(f'get(__words, {at} + {k})')} = '{w}'" if k else f"{fold(f'get(__words, {at})')} = '{w}'" for k, w in enumerate(phrase.split()))

    found = " ".join(f"WHEN h.w = '{phrase.split()[0]}' AND {stands(phrase, 'h.i')} THEN struct(h.i AS i, '{label}' AS label)" for phrase, label in base)
    based = f"filter(transform(__hits, h -> CASE {found} END), x -> x IS NOT NULL)"

    entries = [f"'{w}', array({', '.join(f'struct({t} AS t, {at} AS p)' for t, at in own)})" for w, own in sorted(postings.items())]
    index = f"map({', '.join(entries)})"
    # (template, place where it would begin, place in it) of every posting, those of a template together and in order.
    meets = f"sort_array(flatten(transform(filter(__hits, h -> h.w IN ({_quoted(sorted(postings))})), h -> transform(element_at({index}, h.w), q -> struct(q.t AS t, h.i - q.p AS d, q.p AS p)))))"
    rows = rows.select("__row", "__words", "n_words", F.expr(based).alias("__base"), F.expr(f"CASE WHEN size(__hits) > 0 THEN {meets} ELSE array() END").alias("__meets"))

    # From each entry the next few of its template: those within the slack vote for one place.
    reach = 2 * rare
    near = f"filter(slice(__meets, i + 1, {reach}), y -> y.t = x.t AND y.d - x.d <= {slack})"
    shares = f"element_at(array({', '.join(str(len(own)) for own in places)}), x.t + 1)"
    votes = f"transform(__meets, (x, i) -> struct(x.t AS t, x.d AS d, size(array_distinct(transform({near}, y -> y.p))) / {shares} AS share))"
    needed = f"filter({votes}, x -> x.share >= 0.5)"
    rows = rows.select("__row", "__words", "n_words", "__base", F.expr(needed).alias("__near"))

    def phrase_near(t: int, phrase: str) -> str:
        """Whether the phrase stands about where the template has it."""
        text, own = templates[t][1].split(), phrase.split()
        at = next((k for k in range(len(text)) if text[k : k + len(own)] == own), 0)
        low = f"greatest(0, x.d + {at - slack})"
        window = f"slice(__words, {low} + 1, greatest(0, least(x.d + {at + 2 * slack + len(own)}, n_words) - {low}))"
        return f"contains(concat(' ', {fold(f'array_join({window}, \" \")')}, ' '), ' {phrase} ')"

    checks = " ".join(f"WHEN {t} THEN {' AND '.join(phrase_near(t, p) for p in phrases)}" for t, (_, _, phrases) in enumerate(templates))
    names = f"element_at(array({_quoted(label for label, _, _ in templates)}), x.t + 1)"
    judged = f"transform(__near, x -> struct(x.share AS share, IF(CASE x.t {checks} END, {names}, NULL) AS label))"
    rows = rows.select("__row", "n_words", "__base", F.expr(judged).alias("__judged"))

    own_labels = "transform(__base, x -> x.label)"
    more = "transform(filter(__judged, x -> x.label IS NOT NULL), x -> x.label)"
    joined = lambda labels: F.expr(f"array_join(array_sort(array_distinct({labels})), ',')")
    best = "coalesce(array_max(transform(__judged, x -> IF(x.label IS NULL, x.share / 2, x.share))), 0D)"
    start = "transform(__base, x -> cast(x.i AS long))"
    return rows.select(
        *[F.col("__row").getField(c).alias(c) for c in kept],
        "n_words",
        F.expr("cast(size(__base) AS long)").alias("n_base"),
        F.expr(f"array_min({start})").alias("first_word"),
        F.expr(f"array_max({start})").alias("last_word"),
        joined(own_labels).alias("base_labels"),
        joined(f"concat({own_labels}, {more})").alias("labels"),
        F.expr(f"greatest({best}, IF(size(__base) > 0, 0.5D, 0D))").alias("score"),
    )


def scan_documents(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """:func:`scan` with the rarities of the same rows: the texts are read twice."""
    return scan(docs, rarity(docs, templates), templates, base)


def found_column() -> Column:
    """Whether a scanned row has a label."""
    return F.col("labels") != ""
