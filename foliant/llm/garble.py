"""Problem 4: text that was decoded with the wrong encoding, found and restored.

Smoothed character n-gram models (order 3, one per language) are trained on clean records. A chain takes a text back to
bytes by the encoding it was wrongly read with and decodes them by another. Every chain is scored by the models on the
words that hold something but ASCII; the likeliest is applied if it gains more than a margin, validated on clean records
that the models did not see. Chains repeat, so that doubly wrong texts and texts with two kinds of damage are restored.
"""

from __future__ import annotations

import codecs
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import LANGUAGES, SENTENCE, label_code

#: Encodings tried on either side of a chain.
SINGLE = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866")
MULTI = ("gb18030", "cp932", "euc_jp", "big5")
LOST = "�"
WEIGHTS = (0.62, 0.25, 0.12, 0.01)  # of order 3, 2, 1, and of what was never seen
SEEN, USUAL = 1e-3, 1e-2
ROUNDS = 3
KEPT = 200_000  # words whose scores a worker keeps
COUNTED = 200_000  # distinct words of which a task counts characters at once
HELD = 5  # one of so many clean records is held out, by a hash of its text
LEAST_MARGIN = 6.0

#: Between words: only signs that are no second byte of a wide character.
_SPLIT = re.compile("[ \t\r\n<>()\"',.;:!?/=&#]+")
_CUT = re.compile(f"({_SPLIT.pattern})")
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf4][\x80-\xbf]{3}")
_CONTROL = re.compile("[\x80-\x9f]")
_LATIN9 = re.compile("[€ŠšŽžŒœŸ]")
_REFERENCE = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z]+\d*);")


@lru_cache(maxsize=None)
def table_of(encoding: str) -> tuple[str, object]:
    """(decoding table, encoding map) of a single-byte encoding; bytes that it leaves open stand for themselves."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            chars.append(chr(b))
    table = "".join(chars)
    return table, codecs.charmap_build(table)


def _from_utf8(m: re.Match) -> str:
    try:
        return m.group().encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


def _sources(token: str) -> tuple[str, ...]:
    """The single-byte encodings worth trying: two of them differ from the first by a few characters only."""
    return SINGLE + ("latin-1",) * bool(_CONTROL.search(token)) + ("iso8859_15",) * bool(_LATIN9.search(token))


def _utf8_readings(token: str) -> dict[tuple[str, str], str]:
    """UTF-8 is told by its form, so it may be only part of a word; what isn't UTF-8 stays."""
    out = {}
    for wrong in _sources(token):
        mapped = codecs.charmap_encode(token, "replace", table_of(wrong)[1])[0].decode("latin-1")
        pieces, at = [], 0
        for m in _UTF8.finditer(mapped):
            new = _from_utf8(m)
            if new != m.group():
                pieces += [token[at : m.start()], new]
                at = m.end()
        if at:
            out[wrong, "utf-8"] = "".join(pieces) + token[at:]
    return out


def readings(token: str) -> dict[tuple[str, str], str]:
    """What each chain (wrong, right) makes of a word."""
    out = _utf8_readings(token)
    for (wrong, _), once in list(out.items()):
        if not once.isascii():  # wrongly decoded twice
            for (wrong2, right2), twice in _utf8_readings(once).items():
                out[f"{wrong}/utf-8+{wrong2}", right2] = twice
    high = [c for c in token if c > "\x7f"]
    for wrong in _sources(token):
        try:
            raw = codecs.charmap_encode(token, "strict", table_of(wrong)[1])[0]
        except UnicodeEncodeError:
            continue
        for right in SINGLE:
            if right != wrong:
                out[wrong, right] = codecs.charmap_decode(raw, "strict", table_of(right)[0])[0]
        for right in MULTI:
            new = raw.decode(right, "replace")
            if new.count(LOST) * 8 <= len(new):
                out[wrong, right] = new
    if any(c > "ÿ" and c != LOST for c in high):
        for wrong in MULTI:
            try:
                raw = token.replace(LOST, "?").encode(wrong)
            except UnicodeEncodeError:
                continue
            for right in ("utf-8", *MULTI, *SINGLE):
                if right != wrong and (right == "utf-8" or LOST not in token):
                    new = raw.decode(right, "replace")
                    lost = new.count(LOST)
                    if new != token and (lost == 0 or lost * (3 if right == "utf-8" else 12) <= len(new)):
                        out[wrong, right] = new
    return out


#: Typographic signs that are as usual as their plain forms, and marks that can't be seen.
_PLAIN = re.compile("[’‘“”„‟«»–—…\xa0_]")
_UNSEEN = re.compile("[\ufeff\u200b\u200c\u200d\u2060\xad]")
USUAL_SIGNS = "♪★☆"
_MIXED = re.compile("[A-Za-z][぀-鿿ｦ-ﾟ]|[぀-鿿ｦ-ﾟ][A-Za-z]")
_MIXED_RU = re.compile("[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z]")


def cost(chain: tuple[str, str]) -> float:
    """What a chain must gain first: UTF-8 read as something else is usual, wide characters read as others are not."""
    wrong, right = chain
    if right == "utf-8":
        return 0.0
    if wrong in SINGLE:
        return 3.0 if right in SINGLE else 4.0
    return 6.0 if right in MULTI else 12.0


def bare(token: str) -> str:
    """As the models see it: lower case if it is a usual spelling, with plain signs."""
    token = _UNSEEN.sub("", _PLAIN.sub(" ", token)).strip() if not token.isascii() or "_" in token else token
    if " " in token:
        return " ".join([w.lower() if w.isupper() or w[1:] == w[1:].lower() else w for w in token.split()])
    return token.lower() if token.isupper() or token[1:] == token[1:].lower() else token


#: What a typographic sign costs that a chain puts into a word, and the signs that no chain between single bytes may make.
SIGN_COST = {"’": 1.0, "‘": 2.0, "“": 2.0, "”": 2.0, "„": 2.0, "…": 2.0, "—": 2.0, "–": 2.0, "«": 3.0, "»": 3.0, "¿": 0.0, "¡": 2.0}


def sign_cost(word: str, new: str) -> float:
    return sum(SIGN_COST[c] * max(0, new.count(c) - word.count(c)) for c in set(new) if c in SIGN_COST)


class Models:
    """Interpolated character trigram models of all languages, side by side."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """grams: for each order the n-grams (keys as _keys makes them), the places of their languages, and how often they occur in these."""
        self.tables = []
        counts = []
        for n in range(3):
            every, langs, times = grams[n]
            key, inverse = np.unique(every, return_inverse=True)
            count = np.zeros((len(key) + 1, len(LANGUAGES)))  # the last row is what was never seen
            np.add.at(count, (inverse, langs), times)
            self.tables.append(key)
            counts.append(count)
        total = np.maximum(counts[0].sum(0), 1)
        share = [counts[0] / total]
        for n in (1, 2):
            before = self.tables[n] >> np.uint64(21)
            base = counts[n - 1][np.searchsorted(self.tables[n - 1], before)]
            share.append(np.vstack([counts[n][:-1] / np.maximum(base, 1), np.zeros(len(LANGUAGES))]))
        self.share = [(w * s).astype(np.float32) for w, s in zip(WEIGHTS[2::-1], share, strict=True)]
        self.alphabet = {chr(int(c)) for c in self.tables[0]}
        known = sorted(self.alphabet | {c.upper() for c in self.alphabet if len(c.upper()) == 1})
        self.usual = re.compile("[" + "".join(map(re.escape, known)) + "]+")
        self.index: dict[str, int] = {}
        self.sums, self.least = np.empty((0, len(LANGUAGES)), np.float32), np.empty((0, len(LANGUAGES)), np.float32)
        self.found: dict[str, list] = {}
        self.bases: dict[int, np.ndarray] = {}
        self.strange: dict[str, bool] = {}

    @staticmethod
    def _codes(words: list[str]) -> np.ndarray:
        return np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)

    @staticmethod
    def _keys(cp: np.ndarray) -> list[np.ndarray]:
        """Keys of orders 1, 2, 3 that end at each code point; a word begins after one space, so histories stay inside."""
        one = cp[1:]
        two = (cp[:-1] << np.uint64(21)) | cp[1:]
        far = np.concatenate(([np.uint64(32)], cp[:-2]))
        return [one, two, (far << np.uint64(42)) | two]

    def _base(self, cp: np.ndarray) -> np.ndarray:
        """(code points x languages): the share of a character that the model of a language never saw."""
        values, inverse = np.unique(cp, return_inverse=True)
        return np.array([self.base_of(c) for c in values.tolist()])[inverse]

    def base_of(self, c: int) -> np.ndarray:
        if c not in self.bases:
            ch, out = chr(c), np.full(len(LANGUAGES), 3e-7)
            if c < 0x7F:
                out[:] = 1e-3
            elif 0x80 <= c < 0xA0 or ch == LOST or 0xE000 <= c < 0xF900:
                out[:] = 1e-9
            elif ch in USUAL_SIGNS:
                out[:] = 1.0
            elif 0x410 <= c <= 0x44F:
                out[:] = 1e-7
                out[LANGUAGES.index("ru")] = 2e-3
            elif 0x3041 <= c <= 0x30FA:
                out[:] = 1e-7
                out[LANGUAGES.index("ja")] = 2e-3
            elif 0x4E00 <= c <= 0x9FFF:
                out[:] = 1e-7
                for lang, encoding in (("zh", "gb2312"), ("ja", "shift_jis")):
                    if _common(ch, encoding):
                        out[LANGUAGES.index(lang)] = 2e-4
            elif ch in self.alphabet:
                out[:] = 1e-5
            self.bases[c] = out
        return self.bases[c]

    def is_strange(self, c: str) -> bool:
        if c not in self.strange:
            self.strange[c] = (
                c > "\x7f" and c not in self.alphabet and c.lower() not in self.alphabet and c not in USUAL_SIGNS
                and bare(c) != "" and not _common(c, "gb2312") and not _common(c, "shift_jis")
            )
        return self.strange[c]

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood of each word, its least likely step) by language."""
        shown = [bare(w) for w in words]
        cp = self._codes(shown)
        total = np.zeros((len(cp) - 1, len(LANGUAGES)), np.float32)
        keys = self._keys(cp)
        for table, share, key in zip(self.tables, self.share, keys, strict=True):
            at = np.minimum(np.searchsorted(table, key), len(table) - 1)
            total += share[np.where(table[at] == key, at, len(table))]
        rare = np.flatnonzero(total.min(1) < 2e-3)
        if len(rare):
            total[rare] += WEIGHTS[3] * self._base(cp[1:][rare])
        logs = np.log(np.maximum(total, 1e-12))
        # each word's steps, with the one into the space that ends it; the step into the second space isn't scored
        ends = np.cumsum([len(w) + 2 for w in shown])
        edges = np.stack([np.concatenate(([0], ends[:-1])), ends - 1], 1).ravel()
        edges = edges[:-1] if edges[-1] >= len(logs) else edges
        sums = np.add.reduceat(logs, edges)[::2]
        least = np.minimum.reduceat(logs, edges)[::2]
        return sums, least

    def rows(self, words: list[str]) -> np.ndarray:
        """Where the scores of the words are kept; they are computed once per worker, up to a bound."""
        index = self.index
        new = list(dict.fromkeys(w for w in words if w not in index))
        if new:
            if len(index) + len(new) > KEPT:
                index.clear(), self.found.clear()
                new = list(dict.fromkeys(words))
            start = len(index)
            if start + len(new) > len(self.sums):
                size = max(2 * len(self.sums), start + len(new), 4096)
                for name in ("sums", "least"):
                    setattr(self, name, np.resize(getattr(self, name), (size, len(LANGUAGES))))
            for k in range(0, len(new), 2048):
                part = new[k : k + 2048]
                self.sums[start + k : start + k + len(part)], self.least[start + k : start + k + len(part)] = self.score(part)
            index.update(zip(new, range(start, start + len(new)), strict=True))
        return np.array([index[w] for w in words], np.int64)

    def candidates(self, word: str) -> list[tuple[tuple[str, str], str]]:
        """The chains that make something plausible of a word."""
        if word not in self.found:
            out = []
            wide, russian = len(_MIXED.findall(word)), len(_MIXED_RU.findall(word))
            for chain, new in readings(word).items():
                if new == word:
                    continue
                # of a longer word, most characters must be ones that clean records have
                rest = self.usual.sub("", new)
                if len(new) > 8 and len(rest) * 2 > len(new):
                    continue
                strange = sum(map(self.is_strange, rest))
                free = chain[1] == "utf-8" or chain[1] in MULTI or chain[0] in MULTI
                if not free and any(c > "\x7f" and not c.isalpha() and c not in SIGN_COST and c not in USUAL_SIGNS for c in set(new)):
                    continue
                if strange * 8 <= len(new) and (free or not strange):
                    if len(_MIXED.findall(new)) <= wide and len(_MIXED_RU.findall(new)) <= russian:
                        out.append((chain, new))
            self.found[word] = out
        return self.found[word]


@lru_cache(maxsize=100_000)
def _common(ch: str, encoding: str) -> bool:
    try:
        return ch > "\u2fff" and len(ch.encode(encoding)) == 2
    except UnicodeEncodeError:
        return False


def firm(word: str, chain: tuple[str, str]) -> bool:
    """Signs that stand alone prove nothing: a letter must take part, or a form that only wide characters have."""
    if chain[1] == "utf-8":
        return True
    odd = [c for c in word if c > "\x7f"]
    return any(c.isascii() and c.isalpha() for c in word) or (len(odd) > 2 and any(c.isalpha() for c in odd))


def restore(text: str, models: Models, margin: float) -> tuple[str, list[str], float]:
    """(restored text, chains applied, gain of the first); no chains if nothing gains more than the margin."""
    chains: list[str] = []
    first = 0.0
    for _ in range(ROUNDS):
        if text.isascii():
            break
        words = list({w for w in _SPLIT.split(text) if w})
        rows = models.rows(words)
        total = models.sums[rows].sum(0, dtype=np.float64)
        own = int(total.argmax())
        # a word that is usual in another language is a foreign word
        least = models.least[rows]
        doubt = np.flatnonzero((least[:, own] < np.log(SEEN)) & (least.max(1) < np.log(USUAL)))
        bad = [words[k] for k in doubt if not words[k].isascii() and any(c.isalpha() for c in words[k])]
        if not bad:
            break
        options = [(w, chain, new) for w in bad for chain, new in models.candidates(w)]
        if not options:
            break
        # both lists at once, so that the rows stay valid together
        at = models.rows([w for w, _, _ in options] + [n for _, _, n in options])
        before, after = models.sums[at[: len(options)]], models.sums[at[len(options) :]]
        gain_of = after - before - np.array([[sign_cost(w, n) if chain[1] != "utf-8" else 0.0] for w, chain, n in options], np.float32)
        gains: dict[tuple[str, str], np.ndarray] = {}
        proof: dict[tuple[str, str], bool] = {}
        for (w, chain, _), g in zip(options, gain_of, strict=True):
            if g.max() > 0:
                gains[chain] = gains.get(chain, 0.0) + np.maximum(g, 0)
                proof[chain] = proof.get(chain, False) or firm(w, chain)
        best, gain, lang = None, 0.0, own
        for chain, g in gains.items():
            value = total + g
            net = float(value.max() - total[own]) - cost(chain)
            if proof[chain] and net > gain:
                best, gain, lang = chain, net, int(value.argmax())
        first = first or gain
        if best is None or gain <= margin:
            break
        swap = {w: n for (w, chain, n), g in zip(options, gain_of, strict=True) if chain == best and g[lang] > 0}
        # the chain is proven: words that only another language would excuse follow it too
        rest = [words[k] for k in np.flatnonzero(least[:, lang] < np.log(SEEN)) if not words[k].isascii() and words[k] not in swap]
        more = [(w, new) for w in rest for chain, new in models.candidates(w) if chain == best]
        if more:
            at = models.rows([w for w, _ in more] + [n for _, n in more])
            gain_more = models.sums[at[len(more) :], lang] - models.sums[at[: len(more)], lang]
            swap |= {w: n for (w, n), g in zip(more, gain_more, strict=True) if g > sign_cost(w, n)}
        text = "".join(swap.get(p, p) for p in _CUT.split(text))
        chains.append("/".join(best))
    return text, chains, first


def clean_records(samples: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(lang, text, held): all distinct samples, and documents without control and lost characters, whose label names a language."""
    rows = samples.select("lang", "text")
    if documents is not None:
        rows = rows.unionByName(documents.select("lang", "text").where(~F.col("text").rlike(f"[\x80-\x9f{LOST}]")))
    rows = rows.select(label_code(F.col("lang")).alias("lang"), "text").where("lang is not null and length(text) > 0")
    return rows.withColumn("held", F.pmod(F.xxhash64("text"), F.lit(HELD)) == 0)


def count_grams(records: DataFrame) -> DataFrame:
    """(order, gram, lang, n, held_n): how often each n-gram of the models occurs in the records of a language, and in those held out."""

    def counted(words: dict[str, int], k: int, held: bool) -> Iterator[pd.DataFrame]:
        shown = [bare(w) for w in words]
        times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), [len(w) + 2 for w in shown])
        cp = np.append(Models._codes(shown), np.uint64(32))  # the last word, too, is followed by a second space
        for n, key in enumerate(Models._keys(cp)):
            gram, inverse = np.unique(key, return_inverse=True)
            yield pd.DataFrame({"order": n, "gram": gram.astype(np.int64), "lang": k, "held": held, "n": np.bincount(inverse, times).astype(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[tuple[int, bool], Counter] = {}
        for b in batches:
            for lang, text, held in zip(b["lang"], b["text"], b["held"], strict=True):
                of = LANGUAGES.index(lang), bool(held)
                words.setdefault(of, Counter()).update(filter(None, _SPLIT.split(text)))
                if len(words[of]) > COUNTED:
                    yield from counted(words.pop(of), *of)
        for of, some in words.items():
            if some:
                yield from counted(some, *of)

    made = records.distinct().mapInPandas(run, "order int, gram long, lang int, held boolean, n long")
    return made.groupBy("order", "gram", "lang").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("held"), F.col("n")).otherwise(0)).alias("held_n"))


def train(samples: DataFrame, documents: DataFrame | None = None) -> tuple[Models, float]:
    """(models, margin) from all clean records: samples and labelled documents without control or lost characters.

    Characters are counted where the records are read; only n-grams with their counts reach the driver. The margin is
    above the gains that a chain has on the records held out (all but 5 of 10,000 lines), to a thousandth, under models of
    the others, and at least LEAST_MARGIN. Repeated records count once; which are held out doesn't depend on their order.
    """
    records = clean_records(samples, documents)
    found = count_grams(records).toArrow()
    order, gram, lang, n, held_n = (found[c].to_numpy() for c in ("order", "gram", "lang", "n", "held_n"))
    if not len(order):
        raise ValueError("no clean records")

    def models(times: np.ndarray) -> Models:
        kept = [(order == k) & (times > 0) for k in range(3)]
        return Models([(gram[at].astype(np.uint64), lang[at], times[at]) for at in kept])

    part = models(n - held_n) if (n > held_n).any() else models(n)

    def gains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lines = [line for t in b["text"] for line in SENTENCE.split(t) if line and not line.isascii()]
            yield pd.DataFrame({"gain": [round(float(restore(line, part, 1e9)[2]), 3) for line in lines]}, dtype=float)

    usual = records.where("held").distinct().mapInPandas(gains, "gain double").agg(F.percentile("gain", F.lit(0.9995))).first()[0]
    return models(n), max(LEAST_MARGIN, 1.1 * (usual or 0.0))


RESULT = "garbled boolean, recovered boolean, reason string, chains array<string>, restored string"


def decode(raw: bytes, models: Models) -> tuple[str, str | None]:
    """(text, chain) of bytes: UTF-8 where it is that, else the single-byte or wide encoding under which it is likeliest."""
    try:
        return raw.decode("utf-8"), None
    except UnicodeDecodeError:
        pass
    ways = {"utf-8": raw.decode("utf-8", "replace")}
    ways |= {e: codecs.charmap_decode(raw, "strict", table_of(e)[0])[0] for e in (*SINGLE, "latin-1", "iso8859_15")}
    for e in MULTI:
        try:
            ways[e] = raw.decode(e)
        except UnicodeDecodeError:
            continue
    value = {}
    for e, text in ways.items():
        words = sorted({w for w in _SPLIT.split(text) if w and not w.isascii()})
        sums = models.score(words)[0].sum(0, dtype=np.float64) if words else np.zeros(len(LANGUAGES))
        value[e] = float(sums.max())
    best = max(value, key=lambda e: (value[e], e == "cp1252"))
    return ways[best], None if best == "utf-8" else f"utf-8/{best}"


def examine(given: str | bytes | None, models: Models, margin: float) -> tuple[bool, bool, str | None, list[str], str | None]:
    """(garbled, recovered, reason, chains, restored) of one text; character references count as the characters they name.

    reason: `bytes` if the content isn't UTF-8, `chain` if a chain is accepted, `lost` if lost or control characters alone show it.
    """
    if given is None:
        return False, False, None, [], None
    text, read = (given, None) if isinstance(given, str) else decode(bytes(given), models)
    clear = text
    if "&" in text:
        clear = _REFERENCE.sub(lambda m: html.unescape(m.group()) if html.unescape(m.group()) > "\x7f" else m.group(), text)
    if clear.isascii():
        return bool(read), bool(read), "bytes" if read else None, [read] if read else [], text
    restored, chains, _ = restore(clear.removeprefix("﻿"), models, margin)
    lost = LOST in restored or bool(_CONTROL.search(restored))
    odd = LOST in clear or bool(_CONTROL.search(clear))
    reason = "bytes" if read else "chain" if chains else "lost" if odd else None
    return reason is not None, reason is not None and not lost and LOST not in clear, reason, [read] * bool(read) + chains, restored if reason else text


def find_garbled(df: DataFrame, keys: list[str], text: str, models: Models, margin: float) -> DataFrame:
    """keys + (garbled, recovered, reason, chains, restored) for each row of df, without a shuffle.

    text names a STRING column or a BINARY one, which should be in UTF-8; bytes that aren't are read as what makes them
    likeliest. A null text is not garbled and restores to null; an empty one to itself; repeated rows stay repeated; other
    columns are ignored; null keys stay null; no rows give no rows. A text of which some characters can't be recovered
    comes out restored as far as possible, with recovered false.
    """
    source = df.select(*keys, F.col(text).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame(
                [examine(t if isinstance(t, (str, bytes, bytearray)) else None, models, margin) for t in batch["__text"]],
                columns=["garbled", "recovered", "reason", "chains", "restored"], index=batch.index,
            )
            yield pd.concat([batch[keys], out], axis=1)

    return source.mapInPandas(run, f"{kinds}, {RESULT}")
