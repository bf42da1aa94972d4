"""Token ids of whole texts by a public tokenizer, a word at a time.

The default vocabulary drops white space and never joins letters to the punctuation behind them, so a text's ids are those of its words in turn.
Words repeat, so each worker encodes a distinct word once and gathers the ids by code.
The few texts that hold the string of a special token go to the tokenizer whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docloom.llm.common import group_sums, strings, word_codes

#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that a worker remembers before it starts afresh.
REMEMBERED = 600_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts for a tokenizer file whose words are independent of their neighbours."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.lengths = np.zeros(1 << 12, dtype=np.int64)
        self.starts = np.zeros(1 << 12, dtype=np.int64)
        self.ids, self.used = np.zeros(1 << 14, dtype=np.uint32), 0

    def _learn(self, words: list[str]) -> None:
        first, count = len(self.known), len(words)
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=count)
        while first + count > len(self.lengths):
            self.lengths, self.starts = np.resize(self.lengths, 2 * len(self.lengths)), np.resize(self.starts, 2 * len(self.starts))
        while self.used + lengths.sum() > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.lengths[first : first + count] = lengths
        self.starts[first : first + count] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + lengths.sum()] = np.fromiter((i for e in found for i in e), dtype=np.uint32, count=int(lengths.sum()))
        self.used += int(lengths.sum())
        self.known.update(zip(words, range(first, first + count), strict=True))

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where each word is kept; what is new is encoded first."""
        distinct = words.dictionary_encode()
        listed = strings(distinct.dictionary)
        if new := [w for w in listed if w not in self.known]:
            self._learn(new)
        known = self.known
        return np.fromiter((known[w] for w in listed), dtype=np.int64, count=len(listed))[np.asarray(distinct.indices)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and all ids in turn."""
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), dtype=bool)
        for token in self.special:
            whole |= np.asarray(pc.match_substring(texts, token, ignore_case=True), dtype=bool)
        if not whole.any():
            return self._encode(texts)
        counts, ids = self._encode(pc.if_else(pa.array(whole), "", texts))
        found = [e.ids for e in self.tokenizer.encode_batch_fast(strings(texts.filter(pa.array(whole))), add_special_tokens=False)]
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for at, own in zip(np.flatnonzero(whole).tolist(), found, strict=True):
            parts[at], counts[at] = np.array(own, dtype=ids.dtype), len(own)
        return counts, np.concatenate(parts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED:
            self._forget()
        counts, codes, words = word_codes(texts)
        # Punctuation at the end of a word is a piece of its own where a letter or digit stands before it.
        stem = pc.ascii_rtrim(words, PUNCTUATION)
        apart = pc.fill_null(pc.match_substring_regex(stem, "[0-9a-z]$"), False)
        stem = pc.if_else(apart, stem, words)
        tail = pa.array([w[len(s) :] for w, s in zip(strings(words), strings(stem), strict=True)], pa.string())
        at, end = self._places(stem), self._places(tail)
        own = self.lengths[at] + self.lengths[end]
        kept = pa.ListArray.from_arrays(pa.array(np.append(self.starts[: len(self.known)], self.used).astype(np.int32)), pa.array(self.ids[: self.used]))
        # Ids of the distinct words, stem and tail in turn, then of all words by code.
        pool = kept.take(pa.array(np.column_stack((at, end)).ravel())).flatten()
        pool = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(own))).astype(np.int32)), pool)
        ids = np.asarray(pool.take(pa.array(codes)).flatten())
        return group_sums(own[codes], counts), ids


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
