"""Problem 5: text of scanned pages, without its noise.

Furniture (page numbers, running headers) is told by its place, the page's number and the book's title, author and
repeated lines. Words broken over lines or blocks are joined unless the corpus writes the compound with its hyphen.
Misread words: words are counted over the whole corpus, and skip-gram vectors are learned from the pairs of neighbouring
words. A rare word is linked to frequent ones that differ from it by plausible glyph edits only (both have the same
skeleton, in which easily confused glyphs are one) and whose vectors are near its own; a word that keeps other company
than its link is a word of its own and stays. Each occurrence is corrected to the link that its neighbours expect, or not
at all if they expect none. What is left is reflowed into paragraphs.

The vectors are those skip-gram with negative sampling tends to: its optimum is the shifted matrix of pointwise mutual
information, which is factorised here. So no text moves for the training: tasks send counts of pairs.

No group grows with a book: counts are summed map-side, links are joins on skeletons, and neighbouring blocks meet in
buckets of BUCKET pages; what crosses buckets is told by one row a bucket, however many pages lie between.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import checkpointed

BUCKET = 40
LINE_CHARS = 90  # of a recurring line that is a header; titles and authors may be longer
#: A short first line that isn't the book's title or author must recur on that many pages, and on that share of the book's.
HEADER_PAGES, HEADER_SHARE = 3, 0.05
FREQUENT, TIMES = 5, 8  # a link's target occurs that often, and that many times as often as the rare word
FREQUENT_ODD, TIMES_ODD = 1, 1  # the same for a word with a glyph that no word has
#: Words around that make up a word's company; the vectors' length; the share of all words that makes one a context, so that there are at most 2,000.
WINDOW, DIMENSIONS, CONTEXT_SHARE = 4, 48, 5e-4
#: A link holds if its vector is nearer to the word's company than this share of all frequent words of letters: at one occurrence, and over all of them.
#: With fewer than LEAST_REFERENCE such words there is nothing to compare with, and links hold.
NEAR_HERE, NEAR_ALL, LEAST_REFERENCE = 0.7, 0.85, 16
#: With OWN occurrences or more a word's company must also be as close to the link's as this share of how close it is to itself.
OWN, OWN_SHARE = 3, 0.7
SCALE = 1000  # vectors are summed as whole numbers, so that sums don't depend on their order
BROADCAST_WORDS = 200_000
KEY = ["book_id", "page_number", "block_ix"]

#: How glyphs are misread (what is read, what is printed): letter groups first, then single glyphs.
GROUPS = (("cl", "d"), ("rn", "m"), ("ri", "n"), ("ii", "u"), ("vv", "w"))
SINGLES = {"c": "e", "@": "a", "f": "t", "0": "o", "l": "i", "1": "i", "|": "i", "!": "i", "b": "h", "9": "g", "q": "g", "5": "s", "ſ": "s", "ß": "h", "8": "h", "$": "s", "€": "e", "4": "a", "3": "e", "7": "t"}
VARIANTS = {"6": ("e", "h")}
MOST_EDITS = 3
_SINGLE = str.maketrans(SINGLES)
#: Hyphens at a line's end, and words beside a page's number.
HYPHENS = "-­¬‐‑"
PAGE_WORDS = "p|pp|pg|page|pag|pág|página|pagina|seite|s|p\\.|стр|страница|第"

_END_HYPHEN = re.compile(f"([^\\W\\d_](?:[^\\s]*[^\\W_])?)[{HYPHENS}]\\s*$")
_BREAK = re.compile(f"(\\S*[^\\W_])[{HYPHENS}][ \\t]*\\r?\\n[ \\t]*([^\\W_]\\S*)")
_MAY_BREAK = re.compile(f"[{HYPHENS}][ \\t]*\\r?\\n")
_PAGE = re.compile(
    rf"^[\W_]*(?:(?:{PAGE_WORDS})[.\s]*)?([0-9oOlI|iSsBvxcVXC]{{1,8}})\s*(?:(?:/|von|of|de|di|sur)\s*([0-9oOlI|SB]{{1,5}}))?\s*页?[\W_]*$", re.IGNORECASE
)
_SPLIT = re.compile(r"[\s—–/…]+")
_KEEP = re.compile(f"({_SPLIT.pattern})")
_STRIP = ".,;:!?\"“”„«»()[]{}¿¡'’‘*·•"
_SENTENCE_END = re.compile(r"[.!?…][\"'”’»“)\]]*$")
_DIGIT = str.maketrans("oOlI|iSsB", "001111558")


def fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


#: What is read for what is printed, letter by letter: the edits that a link may hold, in this direction only.
EDITS = (*GROUPS, ("ii", "ü"), ("m", "rn"), ("fi", "ñ"), ("c", "e"), ("c", "é"), ("@", "a"), ("f", "t"), ("0", "o"), ("l", "i"), ("l", "í"), ("1", "l"),
         ("1", "i"), ("|", "l"), ("|", "i"), ("!", "l"), ("b", "h"), ("9", "g"), ("q", "g"), ("5", "s"), ("ſ", "s"), ("b", "ß"), ("6", "é"), ("6", "b"),
         ("6", "ó"), ("8", "b"), ("$", "s"), ("€", "e"), ("4", "a"), ("3", "e"), ("7", "t"), ("i", "l"), ("t", "ł"))


def single_skeleton(word: str) -> str:
    return fold(word.replace("ﬁ", "fi").replace("ﬂ", "fl")).translate(_SINGLE)


@lru_cache(maxsize=200_000)
def skeletons(word: str) -> tuple[str, ...]:
    """The word with all glyphs that are easily confused made one, with and without letter groups.

    A word with more ambiguous glyphs than MOST_EDITS has none: each would have to be an edit.
    """
    plain = fold(word.replace("ﬁ", "fi").replace("ﬂ", "fl"))
    if sum(c in VARIANTS for c in plain) > MOST_EDITS:
        return ()
    grouped = plain
    for read, printed in GROUPS:
        grouped = grouped.replace(read, printed)
    out = []
    for way, w in (("g", grouped), ("s", fold(word))):
        made = [way]
        for c in w:
            made = [m + x for m in made for x in VARIANTS.get(c, (SINGLES.get(c, c),))]
        out += made
    return tuple(dict.fromkeys(out))


def misreading(read: str, printed: str) -> bool:
    """Whether a word can be another one misread: all that differs are EDITS, at least one, MOST_EDITS at most."""

    def go(i: int, j: int, left: int) -> bool:
        while i < len(read) and j < len(printed) and read[i] == printed[j]:
            if any(read.startswith(a, i) and printed.startswith(b, j) and go(i + len(a), j + len(b), left - 1) for a, b in EDITS if left and a[0] == read[i] and b[0] == printed[j]):
                return True
            i, j = i + 1, j + 1
        if i == len(read) and j == len(printed):
            return True
        return left > 0 and any(read.startswith(a, i) and printed.startswith(b, j) and go(i + len(a), j + len(b), left - 1) for a, b in EDITS)

    return read != printed and go(0, 0, MOST_EDITS)


def line_key(line: str) -> str:
    """A line's letters, glyphs made one: equal for a header and its misread or differently cased copies."""
    return single_skeleton("".join(c for c in line if c.isalnum() or c in "@$|€"))


def roman(text: str) -> int | None:
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    t = text.lower()
    if not t or any(c not in values for c in t):
        return None
    total = sum(-values[c] if k + 1 < len(t) and values[c] < values[t[k + 1]] else values[c] for k, c in enumerate(t))
    return total if total > 0 else None


def is_page_number(line: str, page: int) -> bool:
    """Whether a line is the page's number, with or without ornaments, a word for page and the number of pages."""
    m = _PAGE.match(line.strip())
    if not m:
        return False
    digits = m.group(1).translate(_DIGIT)
    if digits.isdigit() and int(digits) == page:
        return True
    return m.group(2) is None and roman(m.group(1)) == page


def split_furniture(line: str, page: int) -> tuple[str, bool]:
    """(the line without a page number beside it, whether there was one): up to four tokens at either end."""
    tokens = line.split()
    for k in range(min(4, len(tokens) - 1), 0, -1):
        for mark, rest in ((tokens[-k:], tokens[:-k]), (tokens[:k], tokens[k:])):
            if is_page_number(" ".join(mark), page) and any(c.isalpha() for t in rest for c in t):
                return " ".join(rest).strip(" |·•–—-[]()"), True
    return line, False


def near(a: str, b: str) -> bool:
    """Equal but for a seventh of the letters."""
    if a == b:
        return bool(a)
    if not a or not b or abs(len(a) - len(b)) > max(1, len(b) // 7) or len(b) < 5:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= max(1, len(b) // 7)


def words_of(text: str) -> list[str]:
    low = text.lower()
    parts = _SPLIT.split(low) if any(c in low for c in "—–/…") else low.split()
    return [w for w in [t.strip(_STRIP) for t in parts] if w]


def across_lines(body: str, way: str | Callable[[re.Match], str]) -> str:
    """A text with its broken words put together in a way of re.sub; most texts have none, which is told at once."""
    return _BREAK.sub(way, body) if _MAY_BREAK.search(body) else body


def is_odd(word: str) -> bool:
    """Whether a word holds a glyph that no word has."""
    return any(c in "@0159|€$ſ" for c in word) and sum(c.isalpha() for c in word) >= 2


def is_word(word: str) -> bool:
    return sum(c.isalpha() for c in word) >= 3 or any(c in "@0159" for c in word) and sum(c.isalpha() for c in word) >= 2 and not word[0].isdigit()


# ---------------------------------------------------------------- furniture

LINES = "book_id string, page_number int, key string"


def header_keys(blocks: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, bucket, keys, first_page): the line keys of each book's running headers and its first page, for each bucket of its pages.

    The book's title and author, and short first lines that recur on HEADER_PAGES pages and HEADER_SHARE of the book's.
    Each page counts a line once; counts are summed before they are shuffled, and only the keys that recur are gathered
    per book: by the share there are at most a few dozen, however long the book.
    """

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for book, page, kind, text in zip(b["book_id"], b["page_number"], b["block_type"], b["text"], strict=True):
                first = text.strip().split("\n", 1)[0].strip()
                if 2 < len(first) <= LINE_CHARS and kind != "table_cell":
                    key = line_key(split_furniture(first, page)[0])
                    if len(key) > 2 and not any(c.isdigit() for c in first[:2]):
                        out.append((book, page, key))
            yield pd.DataFrame(out, columns=["book_id", "page_number", "key"])

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"book_id": b["book_id"], "key": [line_key(n or "") for n in b["name"]]})

    known = books.where("book_id is not null").select("book_id", F.explode(F.array("title", "author")).alias("name")).where("name is not null")
    known = known.distinct().mapInPandas(named, "book_id string, key string").where("length(key) > 2")
    first = blocks.select("book_id", "page_number").distinct().groupBy("book_id").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.count("*").alias("book_pages"))
    again = (
        blocks.select("book_id", "page_number", "block_type", "text").mapInPandas(lines, LINES).distinct()
        .groupBy("book_id", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= HEADER_PAGES)
        .join(first, "book_id").where(F.col("pages") >= HEADER_SHARE * F.col("book_pages")).select("book_id", "key")
    )
    keys = known.unionByName(again).distinct().groupBy("book_id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    buckets = F.explode(F.sequence(F.floor(F.col("first_page") / BUCKET), F.floor(F.col("last_page") / BUCKET)))
    return first.join(keys, "book_id", "left").select("book_id", buckets.alias("bucket"), F.coalesce("keys", F.array().cast("array<string>")).alias("keys"), "first_page")


BODY = "book_id string, page_number int, block_ix int, block_type string, body string, header boolean, pagenum boolean, prose boolean"


def strip_furniture(blocks: DataFrame, headers: DataFrame) -> DataFrame:
    """Blocks with their body, without headers and page numbers: KEY, block_type, body, header, pagenum, prose.

    Only the first and last lines of a block can be furniture; tables have none. prose: the body is running text.
    """

    def one(page: int, kind: str, text: str, keys: list[str], first_page: int) -> tuple[str, bool, bool]:
        lines = text.split("\n")
        header = pagenum = False
        if kind == "table_cell":
            return text, False, False
        longest = max(LINE_CHARS, 2 * max(map(len, keys), default=0))
        for at in (0, -1):
            while lines:
                line = lines[at].strip()
                if not line:
                    lines.pop(at)
                    continue
                if len(line) > longest:
                    break
                if is_page_number(line, page):
                    pagenum = True
                    lines.pop(at)
                    continue
                rest, number = split_furniture(line, page)
                if page > first_page and any(near(line_key(rest), k) for k in keys):
                    header, pagenum = True, pagenum or number
                    lines.pop(at)
                    continue
                break
        return "\n".join(lines), header, pagenum

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [one(*row) for row in zip(b["page_number"], b["block_type"].fillna(""), b["text"], b["keys"], b["first_page"], strict=True)]
            out = b[[*KEY, "block_type"]].copy()
            out["body"], out["header"], out["pagenum"] = ([m[k] for m in made] for k in range(3))
            out["prose"] = [
                kind not in ("table_cell", "heading", "subheading") and (kind == "paragraph" or len(m[0]) > 60) and any(c.isalpha() for c in m[0])
                for kind, m in zip(out["block_type"], made, strict=True)
            ]
            yield out

    # by book and bucket, so that no book is one task's work
    return blocks.join(headers, ["book_id", "bucket"]).select(*KEY, "block_type", "text", "keys", "first_page").mapInPandas(run, BODY)


# ---------------------------------------------------------------- broken words


def is_break(left: str, right: str) -> bool:
    """Whether a hyphen between these may break a word: not after a digit or sign, nor before a sign."""
    return bool(left) and bool(right) and left[-1].isalpha() and (right[0].isalpha() or right[0].isdigit())


def tell(word: str) -> str:
    return word.strip(_STRIP).lower()


WORDS = "word string, n long, book_id string, page_number int, block_ix int, left string, right string"


def words_and_breaks(bodies: DataFrame) -> DataFrame:
    """Rows of (word, n): a task's counts of the words of running text, words at breaks aside; and of KEY, left, right: words broken over lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        count: Counter = Counter()
        for b in batches:
            out = []
            for book, page, ix, body in zip(*(b[k] for k in KEY), b["body"], strict=True):
                if _MAY_BREAK.search(body):
                    for m in _BREAK.finditer(body):
                        left, right = tell(m.group(1)), tell(m.group(2))
                        if is_break(left, right):
                            out.append((book, page, ix, left, right))
                    body = _BREAK.sub(" ", body)
                count.update(words_of(body))
            broken = pd.DataFrame(out, columns=[*KEY, "left", "right"])
            yield broken.assign(word=None, n=0)[[f.split()[0] for f in WORDS.split(", ")]]
        counted = pd.DataFrame(list(count.items()), columns=["word", "n"])
        if count:
            yield counted.assign(book_id=None, page_number=0, block_ix=0, left=None, right=None)

    return bodies.where("prose").select(*KEY, "body").mapInPandas(run, WORDS)


def breaks_across(bodies: DataFrame) -> DataFrame:
    """(KEY, left, right): words that a block's end breaks off, with the beginning of the next running text of the book, however far.

    Blocks are ordered within buckets of pages; what follows a bucket's last block is told by one row a bucket.
    """
    tail, head = F.regexp_extract("body", r"(\S+)\s*\z", 1), F.regexp_extract("body", r"\A\s*(\S+)", 1)
    here = Window.partitionBy("book_id", "bucket").orderBy("page_number", "block_ix")
    edges = bodies.where("prose").select(*KEY, F.floor(F.col("page_number") / BUCKET).alias("bucket"), tail.alias("tail"), head.alias("head"))
    edges = edges.withColumn("next", F.lead("head").over(here)).withColumn("at", F.row_number().over(here))
    following = edges.where("at = 1").select("book_id", "bucket", F.lead("head").over(Window.partitionBy("book_id").orderBy("bucket")).alias("far"))
    ends = edges.where(F.col("tail").rlike(f"[{HYPHENS}]$")).join(following, ["book_id", "bucket"]).select(*KEY, "tail", F.coalesce("next", "far", F.lit("")).alias("next"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for book, page, ix, tail, following in zip(*(b[k] for k in KEY), b["tail"], b["next"], strict=True):
                m = _END_HYPHEN.search(tail)
                left, right = tell(m.group(1)) if m else "", tell(following)
                if left and (right[:1].isalpha() or right[:1].isdigit() or not right):
                    out.append((book, page, ix, left, right))
            yield pd.DataFrame(out, columns=[*KEY, "left", "right"])

    return ends.mapInPandas(run, "book_id string, page_number int, block_ix int, left string, right string")


def judge_breaks(breaks: DataFrame, counts: DataFrame) -> DataFrame:
    """breaks with compound: the corpus writes left-right with its hyphen, and more often than in one word."""
    hyphened = counts.where("word like '%-%'").select(F.col("word").alias("compound_word"), F.col("n").alias("compound_n"))
    joined = counts.select(F.col("word").alias("joined_word"), F.col("n").alias("joined_n"))
    return (
        breaks.withColumn("compound_word", F.concat_ws("-", "left", "right")).withColumn("joined_word", F.concat("left", "right"))
        .join(hyphened, "compound_word", "left").join(joined, "joined_word", "left")
        .withColumn("compound", (F.col("right") != "") & (F.coalesce("compound_n", F.lit(0)) > F.coalesce("joined_n", F.lit(0))))
        .select(*KEY, "left", "right", "across", "joined_word", "compound")
    )


# ---------------------------------------------------------------- misread words


def links(counts: DataFrame) -> DataFrame:
    """(word, target, n, odd): rare words and the frequent ones, n times, that they can be a misreading of."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(w, n, is_odd(w), s) for w, n in zip(b["word"], b["n"], strict=True) if is_word(w) for s in skeletons(w)]
            yield pd.DataFrame(out, columns=["word", "n", "odd", "skeleton"])

    each = counts.mapInPandas(run, "word string, n long, odd boolean, skeleton string")
    # of the frequent words of one skeleton all stay: few spellings share one
    target = each.where("not odd").select(F.col("word").alias("target"), F.col("n").alias("target_n"), "skeleton")
    usual = (F.col("target_n") >= FREQUENT) & (F.col("target_n") >= TIMES * F.col("n"))
    enough = usual | (F.col("odd") & (F.col("target_n") >= FREQUENT_ODD) & (F.col("target_n") >= TIMES_ODD * F.col("n")))
    pairs = each.join(target, "skeleton").where((F.col("word") != F.col("target")) & enough)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[misreading(w, t) for w, t in zip(b["word"], b["target"], strict=True)]]

    kinds = "word string, target string, n long, odd boolean"
    return pairs.select("word", "target", F.col("target_n").alias("n"), "odd").distinct().mapInPandas(check, kinds)


class Company:
    """Vectors of the words that occur around others (contexts), and of what stands around a place in a text."""

    def __init__(self, words: list[str], pairs: np.ndarray, seed: int = 7) -> None:
        """words: the contexts; pairs: how often each two of them are neighbours (symmetric)."""
        self.index = {w: k for k, w in enumerate(words)}
        k = len(words)
        share = pairs.sum(0) ** 0.75  # as skip-gram draws its negative samples
        share = share / max(share.sum(), 1e-9)
        with np.errstate(divide="ignore", invalid="ignore"):
            info = np.log(pairs / np.maximum(pairs.sum(1, keepdims=True), 1) / share)
        info = np.where(np.isfinite(info) & (info > 0), info, 0.0)
        basis = np.random.default_rng(seed).standard_normal((k, min(k, DIMENSIONS + 16)))
        for _ in range(4 if k else 0):
            basis = np.linalg.qr(info @ (info.T @ basis))[0]
        _, values, right = np.linalg.svd(basis.T @ info, full_matrices=False)
        made = np.zeros((k + 1, DIMENSIONS))  # the last row is of what is no context
        made[:k, : len(values)] = (right.T * np.sqrt(values))[:, :DIMENSIONS]
        self.vectors = np.round(made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9), 4).astype(np.float32)

    def places(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(context of each word of the texts, -1 if it is none, with WINDOW empty places around each text; where each text begins)."""
        none, get = len(self.index), self.index.get
        gap = [none] * WINDOW
        ids, starts = list(gap), []
        for words in texts:
            starts.append(len(ids))
            ids += [get(w, none) for w in words]
            ids += gap
        return np.array(ids, np.int32), np.array(starts, np.int64)

    def around(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The company of each place: the unit vector of the mean of its neighbours', or 0 without one."""
        total = np.zeros((len(at), DIMENSIONS), np.float32)
        for step in range(-WINDOW, WINDOW + 1):
            if step:
                total += self.vectors[ids[at + step]]
        return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)


def learn_company(bodies: DataFrame, counts: DataFrame) -> Company:
    """The vectors of all words with at least CONTEXT_SHARE of the corpus: pairs are counted over all running text, a task's at once."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    words = sorted(r["word"] for r in counts.where(F.col("n") >= max(FREQUENT, int(total * CONTEXT_SHARE))).select("word").collect())
    index, k = {w: i for i, w in enumerate(words)}, len(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(k * k, np.int64)
        for b in batches:
            ids: list[int] = []
            for body in b["body"]:
                ids += [index.get(w, -1) for w in words_of(across_lines(body, r"\1\2"))]
                ids += [-1] * WINDOW
            a = np.array(ids, np.int64)
            for d in range(1, WINDOW + 1):
                one, two = a[:-d], a[d:]
                both = (one >= 0) & (two >= 0)
                found += np.bincount(np.minimum(one, two)[both] * k + np.maximum(one, two)[both], minlength=k * k)
        at = np.flatnonzero(found)
        if len(at):
            yield pd.DataFrame({"pair": at.astype(np.int32), "n": found[at]})

    pairs = np.zeros((k, k))
    if k:
        made = bodies.where("prose").select("body").mapInPandas(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        at, n = made["pair"].to_numpy(), made["n"].to_numpy()
        pairs[at // k, at % k] = n
        pairs = pairs + pairs.T
    return Company(words, pairs)


def companies(bodies: DataFrame, company: Company, wanted: set[str] | None) -> DataFrame:
    """(word, n, v ARRAY<BIGINT>): how often each wanted word (all, if None) has company, and the sum of its vectors times SCALE."""
    columns = [f"v{d}" for d in range(DIMENSIONS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place: dict[str, int] = {}
        number, total = np.zeros(1024, np.int64), np.zeros((1024, DIMENSIONS), np.int64)
        for b in batches:
            texts = [words_of(across_lines(body, r"\1\2")) for body in b["body"]]
            ids, starts = company.places(texts)
            at, word = [], []
            for start, words in zip(starts.tolist(), texts, strict=True):
                for k, w in enumerate(words):
                    if wanted is None or w in wanted:
                        at.append(start + k)
                        word.append(place.setdefault(w, len(place)))
            if len(place) > len(number):
                more = max(len(place), 2 * len(number)) - len(number)
                number, total = np.pad(number, (0, more)), np.pad(total, ((0, more), (0, 0)))
            for low in range(0, len(at), 8192):  # as much as the processor keeps at hand
                v = np.rint(company.around(ids, np.array(at[low : low + 8192], np.int64)) * SCALE).astype(np.int64)
                w = np.array(word[low : low + 8192], np.int64)
                order = np.argsort(w, kind="stable")
                ws, first = np.unique(w[order], return_index=True)
                total[ws] += np.add.reduceat(v[order], first)
                number[ws] += np.add.reduceat(v[order].any(1).astype(np.int64), first)
        if place:
            yield pd.DataFrame({"word": list(place), "n": number[: len(place)]} | {c: total[: len(place), k].copy() for k, c in enumerate(columns)})

    kinds = "word string, n long, " + ", ".join(f"{c} long" for c in columns)
    made = bodies.where("prose").select("body").mapInPandas(run, kinds)
    summed = made.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns])
    return summed.select("word", "n", F.array(*columns).alias("v")).where("n > 0")


TARGETS = "array<struct<n:bigint,target:string,vector:array<float>,proven:boolean>>"


def unit(sums: np.ndarray) -> np.ndarray:
    return sums / np.maximum(np.linalg.norm(sums, axis=-1, keepdims=True), 1e-9)


def units(known: DataFrame) -> np.ndarray:
    """The unit vectors of companies, in the order of their words: 4 bytes a number, made by the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"word": b["word"], "v": [unit(np.asarray(v, float)).astype(np.float32) for v in b["v"]]})

    found = known.select("word", "v").mapInPandas(run, "word string, v array<float>").toArrow()
    if not len(found):
        return np.zeros((0, DIMENSIONS), np.float32)
    made = found["v"].combine_chunks().flatten().to_numpy().reshape(len(found), DIMENSIONS)
    return made[np.argsort(found["word"].to_numpy().astype(str), kind="stable")]


def keeps_company(own: np.ndarray, times: int, other: np.ndarray, other_times: int, reference: np.ndarray) -> bool:
    """Whether a word (sum of its vectors, number) keeps the company of another one: near it, and about as close to it as to itself."""
    own, other = own / SCALE, other / SCALE
    each = float(own @ other) / (times * other_times)
    itself = (float(own @ own) - times) / (times * (times - 1))
    nearer = float((reference @ unit(own).astype(reference.dtype) < float(unit(other) @ unit(own)) + 1e-6).mean()) if len(reference) else 1.0
    return nearer >= NEAR_ALL and each >= OWN_SHARE * itself


def judge_links(pairs: DataFrame, known: DataFrame, reference: np.ndarray) -> DataFrame:
    """(word, targets): links that aren't refuted, with the unit vectors of the targets; proven if the company of all occurrences says so.

    pairs: links; known: companies. Odd words can't be words of their own. Words with fewer than OWN occurrences in company
    are left to be judged where they stand.
    """
    own = known.select("word", F.col("n").alias("own_n"), F.col("v").alias("own"))
    other = known.select(F.col("word").alias("target"), F.col("n").alias("other_n"), F.col("v").alias("other"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for word, target, n, odd, own_n, own, other_n, other in b.itertuples(index=False):
                has = other is not None and other_n > 0
                vector = unit(np.asarray(other, float)).astype(np.float32).tolist() if has else None
                proven = bool(odd)
                if not odd and has and own is not None and own_n >= OWN:
                    proven = keeps_company(np.asarray(own, float), int(own_n), np.asarray(other, float), int(other_n), reference)
                    if not proven:
                        continue
                out.append((word, n, target, vector, proven))
            yield pd.DataFrame(out, columns=["word", "n", "target", "vector", "proven"])

    joined = pairs.join(own, "word", "left").join(other, "target", "left").select("word", "target", "n", "odd", "own_n", "own", "other_n", "other")
    judged = joined.mapInPandas(run, "word string, n long, target string, vector array<float>, proven boolean")
    return judged.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("n", "target", "vector", "proven")), asc=False).cast(TARGETS).alias("targets"))


def in_context(around: np.ndarray, targets: list, odd: bool, reference: np.ndarray) -> str | None:
    """The target that a place's company expects: the nearest, a more frequent one before others; None if it is too far."""
    if not around.any():
        sure = [t for t in targets if t["proven"]]
        return max(sure, key=lambda t: (t["n"], t["target"]))["target"] if sure else None
    close = [float(around @ np.asarray(t["vector"], np.float32)) if t["vector"] is not None else 0.0 for t in targets]
    best = max(range(len(targets)), key=lambda k: (close[k] + 0.05 * float(np.log(targets[k]["n"])), targets[k]["target"]))
    near = not len(reference) or float((reference @ around < close[best] + 1e-6).mean()) >= NEAR_HERE
    return targets[best]["target"] if odd or near else None


FIXED = "book_id string, page_number int, block_ix int, block_type string, text string, open boolean, header boolean, pagenum boolean, prose boolean, hyphen boolean, misread boolean, kept boolean"


def repair(bodies: DataFrame, judged: DataFrame, linked: DataFrame, company: Company, reference: np.ndarray) -> DataFrame:
    """Blocks with joined and corrected text (FIXED): hyphen and misread tell what was repaired; open: the text goes on; kept: the hyphen at its end is a compound's."""

    def occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # broken words in one and with their hyphen: one of both is in the repaired text
            out = {
                (book, page, ix, w)
                for book, page, ix, body in zip(*(b[k] for k in KEY), b["body"], strict=True)
                for way in dict.fromkeys(across_lines(body, x) for x in (r"\1\2", r"\1-\2"))
                for w in words_of(way)
                if is_word(w)
            }
            yield pd.DataFrame(sorted(out), columns=[*KEY, "word"])

    if linked.count() <= BROADCAST_WORDS:
        # few enough misread words: every task gets them, and no words are shuffled
        table_of = {r["word"]: [t.asDict() for t in r["targets"]] for r in linked.collect()}
        found = None
    else:
        table_of = None
        words = bodies.where("prose").select(*KEY, "body").mapInPandas(occurrences, "book_id string, page_number int, block_ix int, word string")
        found = words.join(linked, "word").groupBy(*KEY).agg(F.collect_list(F.struct("word", "targets")).alias("links"))
    broken = judged.groupBy(*KEY).agg(
        F.collect_set(F.when(F.col("compound") & ~F.col("across"), F.concat_ws("-", "left", "right"))).alias("compounds"),
        F.max(~F.col("compound")).alias("hyphen"), F.max(F.col("compound") & F.col("across")).alias("kept"),
    )

    def one(body: str, table: dict, compounds: set) -> tuple[str, bool]:
        def join(m: re.Match) -> str:
            left, right = tell(m.group(1)), tell(m.group(2))
            whole = is_break(left, right) and f"{left}-{right}" not in compounds
            return m.group(1) + m.group(2) if whole else f"{m.group(1)}-{m.group(2)}"

        text = re.sub(r"\s*\n\s*", " ", across_lines(body, join)).strip() if "\n" in body else body.strip()
        odd_text = any(c in text for c in "@0159ſ")
        wrong = odd_text and any(_ODD.search(t) and not _CODE.search(t) for t in (t.strip(_STRIP) for t in text.split(" ")))
        # split as words are counted, separators kept
        tokens = _KEEP.split(text)
        plain = [tell(t) for t in tokens[::2]]
        here = [k for k, w in enumerate(plain) if w in table]
        if here:
            coded = in_code(tokens) if _CODE.search(text) else ()
            words = [k for k, w in enumerate(plain) if w]
            order = {k: at for at, k in enumerate(words)}
            ids, starts = company.places([[plain[k] for k in words]])
            around = company.around(ids, starts[0] + np.array([order[k] for k in here]))
            for k, place in zip(here, around, strict=True):
                if 2 * k in coded:
                    continue
                new = in_context(place, table[plain[k]], is_odd(plain[k]), reference)
                if new is not None:
                    core = tokens[2 * k].strip(_STRIP)
                    shaped = new.upper() if core.isupper() and len(core) > 1 else new.capitalize() if core[:1].isupper() else new
                    tokens[2 * k], wrong = tokens[2 * k].replace(core, shaped), True
            text = "".join(tokens)
        return text, wrong

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[[*KEY, "block_type", "header", "pagenum", "prose"]].copy()
            texts, misread, opened = [], [], []
            for body, prose, found, compounds in zip(b["body"], b["prose"], b["links"], b["compounds"], strict=True):
                text, wrong = body, False
                if prose:
                    table = table_of if table_of is not None else {x["word"]: x["targets"] for x in found} if found is not None else {}
                    text, wrong = one(body, table, set(compounds) if compounds is not None else set())
                texts.append(text)
                misread.append(wrong)
                opened.append(bool(prose and text and not _SENTENCE_END.search(text)))
            out["text"], out["misread"], out["open"] = texts, misread, opened
            for name in ("hyphen", "kept"):
                out[name] = [h is not None and h == True for h in b[name]]  # noqa: E712
            yield out[[f.split()[0] for f in FIXED.split(", ")]]

    if found is None:
        bodies = bodies.withColumn("links", F.lit(None).cast(f"array<struct<word:string,targets:{TARGETS}>>"))
    else:
        bodies = bodies.join(found, KEY, "left")
    return bodies.join(broken, KEY, "left").select(*KEY, "block_type", "body", "header", "pagenum", "prose", "links", "compounds", "hyphen", "kept").mapInPandas(run, FIXED)


#: A glyph that no word has between letters.
_ODD = re.compile(r"[^\W\d_]{2,}[@0159ſ][^\W\d_]|[^\W\d_][@0159ſ][^\W\d_]{2,}")
_CODE = re.compile(r"https?:|\S@\S+\.\w|_|=")


def in_code(tokens: list[str]) -> set[int]:
    """Places of tokens (every second one is a separator) that are a part of an address or of code, which isn't corrected."""
    out: set[int] = set()
    group: list[int] = []
    for k in range(0, len(tokens), 2):
        group.append(k)
        if k + 1 == len(tokens) or any(c.isspace() for c in tokens[k + 1]):
            if len(group) > 1 and _CODE.search("".join(tokens[group[0] : k + 1])):
                out.update(group)
            group = []
    return out


def clean_blocks(blocks: DataFrame, books: DataFrame) -> DataFrame:
    """FIXED rows of all blocks of (book_id, page_number, block_ix, text, block_type).

    Repeated rows count once, of rows that differ under one key the least text; null keys and null texts are left out, empty
    texts give empty ones; books without a row, title or author are known by their recurring lines only; other columns are
    ignored; empty tables give no rows.
    """
    rows = blocks.where("book_id is not null and page_number is not null and block_ix is not null and text is not null").select(*KEY, "text", "block_type")
    # texts are shuffled once, to their buckets: repeated rows and the headers' keys meet them there
    placed = rows.withColumn("bucket", F.floor(F.col("page_number") / BUCKET)).repartition("book_id", "bucket")
    once = placed.groupBy("book_id", "bucket", "page_number", "block_ix").agg(F.min(F.struct("text", "block_type")).alias("b")).select(*KEY, "bucket", "b.*")
    bodies = strip_furniture(once, header_keys(rows, books))  # repeated rows are no further pages
    bodies = checkpointed(bodies)  # read by every step below
    # distinct words, and places of broken words: each is used several times below
    words = checkpointed(words_and_breaks(bodies))
    counts = checkpointed(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    within = words.where("word is null").select(*KEY, "left", "right", F.lit(False).alias("across"))
    judged = checkpointed(judge_breaks(within.unionByName(breaks_across(bodies).withColumn("across", F.lit(True))), counts))
    whole = counts.unionByName(judged.where("not compound and right != ''").groupBy(F.col("joined_word").alias("word")).agg(F.count("*").alias("n")))
    pairs = checkpointed(links(whole.groupBy("word").agg(F.sum("n").alias("n"))))
    company = learn_company(bodies, counts)
    names = pairs.select(F.explode(F.array("word", "target")).alias("word"))
    # words to compare with: all that are frequent, made of letters
    frequent = counts.where((F.col("n") >= FREQUENT) & F.col("word").rlike(r"^\p{L}{3,}$")).select("word")
    names = checkpointed(names.unionByName(frequent).distinct())
    # few enough words with links or to compare with: only theirs are summed up
    wanted = {r["word"] for r in names.collect()} if names.count() <= 2 * BROADCAST_WORDS else None
    known = checkpointed(companies(bodies, company, wanted))
    reference = units(known.join(frequent, "word", "left_semi"))
    if len(reference) < LEAST_REFERENCE:
        reference = reference[:0]
    return repair(bodies, judged, checkpointed(judge_links(pairs, known, reference)), company, reference)


def noise_of(fixed: DataFrame) -> DataFrame:
    """(book_id, page_number, block_ix, noise): what each block held."""
    kinds = F.array(*[F.when(F.col(c), F.lit(c)) for c in ("hyphen", "misread", "header", "pagenum")])
    return fixed.select(*KEY, F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("noise")).distinct()


KEPT = "\x00"  # ends a text whose last hyphen is a compound's


def joined(pieces: list[str]) -> str:
    """Texts that continue each other, as one: by a space, or without the hyphen that a text before ends with, unless KEPT follows it."""
    out: list[str] = []
    tail = ""  # the last word so far
    for text in pieces:
        if out and out[-1].endswith(KEPT):
            out[-1] = out[-1].removesuffix(KEPT)
            tail = ""
        elif out and _END_HYPHEN.search(tail):
            out[-1] = re.sub(f"[{HYPHENS}]\\s*$", "", out[-1])
            tail = re.sub(f"[{HYPHENS}]\\s*$", "", tail)
        elif out:
            out.append(" ")
            tail = ""
        out.append(text)
        tail = (tail + text).rstrip()
        tail = tail[max((k + 1 for k, c in enumerate(tail) if c.isspace()), default=0) :]
    return "".join(out).removesuffix(KEPT)


FRAGMENTS = "book_id string, bucket long, page_number int, block_ix int, pieces array<string>, first boolean, last boolean, open boolean"


def paragraphs(fixed: DataFrame) -> DataFrame:
    """(book_id, page_number, block_ix, text): the book's paragraphs, at the block where each begins, in reading order.

    Running text that breaks off is continued by the next running text of the book that begins in lower case or with a
    digit, over any number of pages. Each bucket makes its fragments; whether its first continues the bucket before, and
    where that paragraph began, is told by one row a bucket without text. Only the fragments at the edges of buckets are
    shuffled again; a paragraph's text is gathered in the row that it makes.
    """
    text = F.when(F.col("kept"), F.concat("text", F.lit(KEPT))).otherwise(F.col("text")) if "kept" in fixed.columns else F.col("text")
    rows = fixed.where("text != ''").select("book_id", "page_number", "block_ix", text.alias("text"), "prose", "open", F.floor(F.col("page_number") / BUCKET).alias("bucket"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["page_number", "block_ix"], kind="stable")
        out: list[list] = []
        current: int | None = None  # the paragraph of the last running text
        for book, page, ix, text, prose, opened, bucket in g[["book_id", "page_number", "block_ix", "text", "prose", "open", "bucket"]].itertuples(index=False):
            starts_low = text[:1].islower() or text[:1].isdigit()
            if prose and current is not None and starts_low and out[current][7]:
                out[current][4].append(text)
                out[current][7] = opened
            else:
                out.append([book, bucket, page, ix, [text], bool(prose and current is None and starts_low), False, bool(prose and opened)])
                if prose:
                    current = len(out) - 1
        if current is not None:
            out[current][6] = True
        for r in out:
            if not (r[5] or r[6] and r[7]):
                r[4] = [joined(r[4])]
        return pd.DataFrame(out, columns=["book_id", "bucket", *KEY[1:], "pieces", "first", "last", "open"])

    # read for the buckets' rows, and for the fragments inside and at the edges of buckets
    fragments = checkpointed(rows.groupBy("book_id", "bucket").applyInPandas(run, FRAGMENTS))
    order = Window.partitionBy("book_id").orderBy("bucket")
    carried = (
        fragments.where("last").select("book_id", "bucket", F.struct("page_number", "block_ix").alias("start"), "open", F.col("first").alias("through"))
        .withColumn("goes_on", F.coalesce(F.lag("open").over(order), F.lit(False)))
        .withColumn("head", F.last(F.when(~(F.col("through") & F.col("goes_on")), F.col("start")), ignorenulls=True).over(order))
        .select("book_id", "bucket", "goes_on", F.lag("head").over(order).alias("head"))
    )
    edges = fragments.where("first or (last and open)").join(carried, ["book_id", "bucket"])
    head = F.when(F.col("first") & F.col("goes_on"), F.col("head")).otherwise(F.struct("page_number", "block_ix"))
    edges = edges.groupBy("book_id", head.alias("at")).agg(F.sort_array(F.collect_list(F.struct("page_number", "block_ix", "pieces"))).alias("parts"))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[KEY].assign(text=[joined(list(p)) for p in b["pieces"]])

    made = "book_id string, page_number int, block_ix int, text string"
    edges = edges.select("book_id", "at.*", F.flatten("parts.pieces").alias("pieces")).mapInPandas(whole, made)
    return fragments.where("not (first or (last and open))").select(*KEY, F.col("pieces")[0].alias("text")).unionByName(edges)
