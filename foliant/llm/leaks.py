"""Problem 7: passages of evaluation items in training documents, by spaced-seed hashing.

Both sides become token streams (words; single characters for languages written without spaces). Fixed masks over a
window of positions ignore some of them; the hash of the others is the join key. Every hit names a document position and
an item position, thus a diagonal; along it the overlap is verified exactly (runs of equal tokens) and tolerantly (runs
that may hold single substitutions).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spaced seeds: 1 is a position that counts. The first spans the shortest run of words, the second tolerates more.
WORD_MASKS = ("11011011", "1110010111")
CHAR_MASKS = ("110111011011", "11110010111101")
WORD_RUN, CHAR_RUN = 8, 12
SHARE = 1 / 3

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_ACCENTS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff]")
_CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿]")
_HIDDEN = re.compile("[­​-‏⁠﻿]|(?<=\\w)-[ \t]*\r?\n[ \t]*")


def fold(text: str) -> str:
    """Lower case without markup, hidden characters and accents."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _ACCENTS.sub("", unicodedata.normalize("NFKD", text)))
    return _HIDDEN.sub("", text).casefold()


def words(folded: str) -> list[str]:
    return [w.replace("’", "'") for w in _WORD.findall(folded)] if "’" in folded else _WORD.findall(folded)


def chars(folded: str) -> list[str]:
    return [c for c in folded if c.isalnum()]


class Items:
    """A block of items, hashed."""

    def __init__(self, rows: list[tuple[int, str, str]]) -> None:
        """rows: item id, language, text."""
        self.vocabulary: dict[str, int] = {}
        self.ids, self.streams, self.by_char = [], [], []
        seen = set()
        for item, lang, text in rows:
            folded = fold(text or "")
            by_char = (lang or "").lower()[:2] in ("zh", "ja") or len(_CJK.findall(folded)) > len(folded) / 3
            stream = chars(folded) if by_char else words(folded)
            if item is None or not stream or (item, tuple(stream)) in seen:
                continue
            seen.add((item, tuple(stream)))
            self.ids.append(item)
            self.by_char.append(by_char)
            self.streams.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in stream], np.int64))
        self.masks = {False: [self._seeds(m, False) for m in WORD_MASKS], True: [self._seeds(m, True) for m in CHAR_MASKS]}

    def _seeds(self, mask: str, by_char: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        offsets = np.flatnonzero(np.frombuffer(mask.encode(), np.uint8) == 49)
        hashes, item, at = [], [], []
        for k, s in enumerate(self.streams):
            if self.by_char[k] == by_char and len(s) >= len(mask):
                h = seed_hashes(s, offsets, len(mask))
                hashes.append(h)
                item.append(np.full(len(h), k))
                at.append(np.arange(len(h)))
        if not hashes:
            return offsets, np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        h, i, a = np.concatenate(hashes), np.concatenate(item), np.concatenate(at)
        order = np.argsort(h, kind="stable")
        return offsets, h[order], i[order], a[order]

    def hits(self, stream: np.ndarray, by_char: bool) -> set[tuple[int, int]]:
        """(item index, diagonal) of every seed that the document shares with an item."""
        found: set[tuple[int, int]] = set()
        for (offsets, hashes, item, at), mask in zip(self.masks[by_char], CHAR_MASKS if by_char else WORD_MASKS, strict=True):
            if len(stream) < len(mask) or not len(hashes):
                continue
            own = seed_hashes(stream, offsets, len(mask))
            known = np.flatnonzero((stream[: len(own)] > 0))  # masks begin with a 1: an unknown first token can't hit
            low = np.searchsorted(hashes, own[known], "left")
            high = np.searchsorted(hashes, own[known], "right")
            for p, a, b in zip(known[high > low], low[high > low], high[high > low], strict=True):
                found.update((int(item[k]), int(p - at[k])) for k in range(a, b))
        return found

    def match(self, text: str) -> list[tuple]:
        """(item id, tokens, exactly covered, tolerantly covered, longest exact run) of each item found in the text."""
        out: dict[int, tuple] = {}
        folded = fold(text)
        for by_char in (False, True):
            if by_char not in self.by_char or (by_char and not _CJK.search(folded)):
                continue
            get = self.vocabulary.get
            stream = np.array([get(w, 0) for w in (chars(folded) if by_char else words(folded))], np.int64)
            cover: dict[int, list[np.ndarray]] = {}
            longest: dict[int, int] = {}
            least = CHAR_RUN if by_char else WORD_RUN
            for k, d in self.hits(stream, by_char):
                s = self.streams[k]
                lo, hi = max(0, -d), min(len(s), len(stream) - d)
                same = s[lo:hi] == stream[lo + d : hi + d]
                exact, tolerant = cover.setdefault(k, [np.zeros(len(s), bool), np.zeros(len(s), bool)])
                for a, b in runs(same):
                    if b - a >= least:
                        exact[lo + a : lo + b] = True
                        longest[k] = max(longest.get(k, 0), b - a)
                near = same.copy()
                near[1:-1] |= same[:-2] & same[2:]  # a single substitution between equal tokens
                for a, b in runs(near):
                    if b - a >= least:
                        tolerant[lo + a : lo + b] = True
            for k, (exact, tolerant) in cover.items():
                if tolerant.any():
                    row = (self.ids[k], len(exact), int(exact.sum()), int(tolerant.sum()), longest.get(k, 0))
                    if row[2:] > out.get(self.ids[k], (0, 0, -1))[2:]:
                        out[self.ids[k]] = row
        return list(out.values())


def seed_hashes(stream: np.ndarray, offsets: np.ndarray, span: int) -> np.ndarray:
    n = len(stream) - span + 1
    h = np.zeros(n, np.uint64)
    s = stream.astype(np.uint64)
    for o in offsets:
        h = (h ^ s[o : o + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def runs(same: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def find_leaks(docs: DataFrame, items: DataFrame, block: int = 20_000) -> DataFrame:
    """(doc_id, item_id, item_tokens, exact_tokens, tolerant_tokens, longest_run, share, tolerant_share): each pair with
    a verified overlap of at least the shortest run.

    docs: (doc_id, text), read once for each block of items and never shuffled; items: (item_id, lang, text), a held-out
    set that comes through the driver in blocks of `block` items, one partition at a time, so that no block grows with the
    corpus. Items shorter than the shortest run match nothing, nor do null or empty texts and null ids; repeated rows of
    documents give repeated rows, repeated items count once; an empty table gives no rows.
    """
    rows = items.select("item_id", "lang", "text").where("item_id is not null and text is not null").distinct().orderBy("item_id", "lang", "text").toLocalIterator()
    schema = "doc_id long, item_id long, item_tokens int, exact_tokens int, tolerant_tokens int, longest_run int"
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    out = None
    while (part := [tuple(r) for r in islice(rows, block)]) or out is None:
        index = Items(part)

        def run(batches: Iterator[pd.DataFrame], index: Items = index) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [(doc, *m) for doc, text in zip(batch["doc_id"], batch["text"], strict=True) for m in index.match(text)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "item_tokens", "exact_tokens", "tolerant_tokens", "longest_run"])

        found = docs.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumn("share", F.col("exact_tokens") / F.col("item_tokens")).withColumn(
        "tolerant_share", F.col("tolerant_tokens") / F.col("item_tokens")
    )
