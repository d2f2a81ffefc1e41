"""Problem 6: ids of a whole corpus by a public byte-level BPE.

Tree reduction over a monoid. A text longer than `leaf` code points is cut in halves, the halves are encoded
recursively, and two neighbours are joined by re-encoding a window around their border. The window grows until both
its ends are points at which every encoding has a token border, so all tokens outside it are final. Decoding
concatenates the tokens' bytes up the same tree.

Why the ends are safe: the tokenizer first splits a text by a pattern whose matches depend only on the text from where
they begin, and no match holds a letter or digit followed by white space or by one of the marks in `_SAFE`. The splitter
thus always stops between the two, whatever stands before or after, and merges never cross a stop of the splitter.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
LEAF = 2048
WINDOW = 64

#: Letters and digits of every Unicode version, before white space or a mark that starts no contraction.
_SAFE = re.compile("[A-Za-z0-9À-ÖØ-öø-ÿа-яА-Яぁ-ゖァ-ヺ一-龥](?=[ \n\t.,;:!?。、，！？：；])")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file; kept once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = [0] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


#: Fixed value: the splitting pattern of the byte_bpe tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _drop_end(ids: list[int], sizes: list[int], n_bytes: int) -> int:
    """How many tokens remain when the last n_bytes bytes are cut off; -1 if that would cut a token."""
    k = len(ids)
    while n_bytes > 0:
        k -= 1
        n_bytes -= sizes[ids[k]]
    return k if n_bytes == 0 else -1


def _drop_start(ids: list[int], sizes: list[int], n_bytes: int) -> int:
    k = 0
    while n_bytes > 0:
        n_bytes -= sizes[ids[k]]
        k += 1
    return k if n_bytes == 0 else -1


def _last_safe(text: str, start: int, end: int, window: int) -> int:
    """The last safe point in (start, end), or start."""
    size = window
    while True:
        low = max(start, end - size)
        at = -1
        for m in _SAFE.finditer(text, low, end):
            at = m.end()
        if at > 0 and at < end:
            return at
        if low == start:
            return start
        size *= 2


def _first_safe(text: str, start: int, end: int, window: int) -> int:
    """The first safe point in (start, end), or end."""
    m = _SAFE.search(text, start, end)
    return m.end() if m and m.end() < end else end


def encode(text: str, path: str, pattern: str = PATTERN, leaf: int = LEAF, window: int = WINDOW) -> list[int]:
    """The ids of a text, equal to those of encoding it as a whole."""
    enc, sizes = encoding(path, pattern)

    def tree(a: int, b: int) -> list[int]:
        if b - a <= leaf:
            return enc.encode_ordinary(text[a:b])
        mid = (a + b) // 2
        left, right = tree(a, mid), tree(mid, b)
        l, r = _last_safe(text, a, mid, window), _first_safe(text, mid, b, window)
        while True:
            keep = _drop_end(left, sizes, len(text[l:mid].encode())) if l > a else 0
            skip = _drop_start(right, sizes, len(text[mid:r].encode())) if r < b else len(right)
            if keep >= 0 and skip >= 0:
                return left[:keep] + enc.encode_ordinary(text[l:r]) + right[skip:]
            l, r = (a if keep < 0 else l), (b if skip < 0 else r)

    return tree(0, len(text))


def decode(ids: list[int], path: str, pattern: str = PATTERN, leaf: int = LEAF) -> str:
    """The text of ids: the bytes of each half, joined up the tree."""
    enc, _ = encoding(path, pattern)

    def tree(a: int, b: int) -> bytes:
        if b - a <= leaf:
            return enc.decode_bytes(ids[a:b])
        mid = (a + b) // 2
        return tree(a, mid) + tree(mid, b)

    return tree(0, len(ids)).decode("utf-8", "replace")


def encode_corpus(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k",
    tokenizers: str = TOKENIZERS,
    leaf: int = LEAF,
) -> DataFrame:
    """(id_col, ids): one row per row of docs, without a shuffle.

    A null or empty text gives an empty list; a null id stays null; repeated rows stay repeated; other columns are
    ignored, whatever their names. Strings of special tokens are ordinary text. No rows in give no rows out.
    """
    path = f"{tokenizers}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 512):
                part = [encode(t, path, PATTERN, leaf) if t else [] for t in texts[at : at + 512]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(part, pa.list_(pa.int32()))], names=[id_col, "ids"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
