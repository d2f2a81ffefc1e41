"""Problem 8: abusive, hateful and sexual content, by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: case, accents, look-alike letters of other scripts, digits and signs that stand for letters,
masked, stretched letters and letters set apart; ideographs and hiragana are words of their own. One automaton finds all
entries, exceptions and the word classes of constructions (a group and contempt, a threat and a person), whose expressions
are tried only on sentences that hold their classes. In a sentence the weights of what was found add up by category; what
only suggests counts less in a long sentence; entries that only insult count fully where a person is spoken to; exceptions
void all of their sentence but the set phrases.

The lexicon grows from the reviews of the data at hand: weights of terms and constructions follow from how often reviewers
confirmed documents that hold them, and runs of words that stand in confirmed documents beyond chance, where nothing else
tells why, become entries.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import abuse_words

CATEGORIES = ("abuse", "hate", "sexual")
STRONG, INSULT, HINT, THRESHOLD = 1.0, 0.6, 0.35, 1.0
#: Words of a sentence beyond which what only suggests counts less, by the root of the length.
USUAL_WORDS = 30
#: Learning from reviews: at most so many reviewed documents, by a hash of their id; runs of three to GRAM words (shorter
#: ones are names and usual words); a run must stand in LEAST_CONFIRMED documents that nothing else explains, and by chance no more often than CHANCE over all runs tried.
MAX_REVIEWED, GRAM_LEAST, GRAM, LEAST_CONFIRMED, CHANCE = 20_000, 3, 4, 4, 0.01

#: Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOKALIKES = dict(zip("аеорсухкмнвтіјѕԁԛԝһӏɡαορνυιτκε", "aeopcyxkmhbtijsdqwhlgaopvuitke", strict=True))
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e"}

_ACCENTS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff]")
#: Stands in every text of which _MASKED can change a word: a digit beside a letter, "!" between letters or digits, another sign.
_SIGN_INSIDE = re.compile(r"[\d_*#%@$&€!](?:(?<=[_*#%@$&€])|(?<=[^\W\d_]\d)|(?<=\d)(?=[^\W\d_])|(?<=[^\W_]!)!*[^\W_])")
_HIDDEN = re.compile("[\xad​-‏⁠﻿]")
_MIXED = re.compile("[^\\W\\d_]*(?:[a-z][Ͱ-ϿЀ-ԯɡ]|[Ͱ-ϿЀ-ԯɡ][a-z])[^\\W\\d_]*")
_BESIDE = re.compile("[Ͱ-ϿЀ-ԯɡ](?:[a-z]|(?<=[a-z].))")
#: A word with digits or signs in place of letters.
_MASKED = re.compile(r"(?<![^\W_])[^\W_](?=[\w*#%@$&!€]*[^\W\d_])[^\W\d_]*(?:[\d_*#%@$&!€]+[^\W\d_]*)+")
_APART = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-_*]{1,2}[^\W\d_](?![^\W_])){2,}")
#: A letter three times or more in a row, and the word around it.
_RUN = re.compile(r"([^\W\d_])\1\1+")
_STRETCHED = re.compile(r"(?<![^\W\d_])[^\W\d_]*([^\W\d_])\1\1[^\W\d_]*")
_REPEAT = re.compile(r"(.)\1+")
_STOP = re.compile(r"[.!?…。！？]+(?=[\s\"'”’»)\]]|$)|\n+")
_OTHER = re.compile(r"[^\w\n]+")
_WIDE = re.compile("[\u3041-\u309f\u3400-\u4dbf\u4e00-\u9fff]")  # runs of katakana are words
#: Classes of words, and the construction that each name stands for; names can't be folded text.
_CLASS = {k: "|".join(sorted(v.split(), key=len, reverse=True)) for k, v in abuse_words.CLASSES.items()}
CONSTRUCTIONS = {f"@{n}": (c, k, re.compile(re.sub("<([a-z]+)>", lambda m: f"(?:{_CLASS[m.group(1)]})", x))) for n, c, k, x in abuse_words.CONSTRUCTIONS}
_CLASSES_OF: dict[str, tuple[str, ...]] = {}
for _k, _v in abuse_words.CLASSES.items():
    for _w in _v.split():
        _CLASSES_OF[_w] = (*_CLASSES_OF.get(_w, ()), _k)

#: A person is spoken to, or named an insult.
_TO_PERSON = re.compile(
    r"\b(?:you|your|yours|yourself|u|du|dich|dir|dein|deine|deiner|ihr|euch|tu|toi|te|ton|vous|t|eres|tú|usted|pedazo|espece|sei|voce|vete|like [a-z]+ could"
    "|ты|тебя|тебе|тобои|вы|вас|вам|твои|твоя|你|您|お 前|貴 様|て め え|あ な た)\\b"
)
#: Words of address that are often stretched.
SPOKEN_TO = ("you", "your", "are", "du", "tu", "vous", "eres")
_TO_SELF = re.compile(r"\b(?:i am|i m|myself|himself|herself|ich bin|je suis|je fais|soy|me dije|mirror|я сам|я сама|какои же я|我 是|我 真|俺 は|私 は)\b")


def strip_accents(text: str) -> str:
    return unicodedata.normalize("NFC", _ACCENTS.sub("", unicodedata.normalize("NFD", text)))


class Matcher:
    """The automaton and the tables behind it. rows: (term, category, weight) of the lexicon; learned: the same of folded runs of words."""

    def __init__(self, rows: list[tuple[str, str, float]], learned: list[tuple[str, str, float]] = ()) -> None:
        self.entries: dict[str, list[tuple[str, str, float]]] = {}  # folded entry -> (category, role, weight)
        self.words: set[str] = set()
        lists = (("abuse", "strong", abuse_words.ABUSE), ("hate", "strong", abuse_words.HATE), ("sexual", "strong", abuse_words.SEXUAL), ("", "except", abuse_words.EXCEPTIONS), ("abuse", "insult", abuse_words.INSULT_PHRASES))
        all_rows = [(p, c, role, STRONG if role == "strong" else INSULT) for c, role, text in lists for p in abuse_words.phrases(text)]
        all_rows += [(w, "abuse", "insult", INSULT) for w in abuse_words.INSULT_WORDS.split()]
        all_rows += [(w, c, "hint", HINT) for c, text in abuse_words.HINTS.items() for w in text.split()]
        insults = {r[0] for r in all_rows if r[2] == "insult"}
        self.entries.update({n: [(c, "made", STRONG)] for n, (c, _, _) in CONSTRUCTIONS.items()})
        for term, category, weight in rows:
            if term in CONSTRUCTIONS:
                self.entries[term] = [(category, "made", weight)]
                continue
            folded = fold_simple(term)
            role = "insult" if category == "abuse" and folded in insults else "hint"
            all_rows.append((term, category, role, weight))
        for term, category, role, weight in all_rows:
            folded = fold_simple(term)
            if folded:
                self.words.update(folded.split())
                known = self.entries.setdefault(folded, [])
                # the table's word weighs more or less than the list's; a decisive phrase stays decisive
                known[:] = [k for k in known if not (k[0] == category and k[1] != "strong" and role in ("hint", "insult"))]
                if not any(k[0] == category and k[1] == "strong" for k in known):
                    known.append((category, role, weight))
        for run, category, weight in learned:
            known = self.entries.setdefault(run, [])
            if not any(k[0] == category for k in known):
                known.append((category, "learned", weight))
        self.by_shape: dict[tuple[str, int], list[str]] = {}
        for w in sorted(self.words, key=lambda w: (not any(k[1] == "insult" for k in self.entries.get(w, [])), w)):
            if len(w) > 2:
                self.by_shape.setdefault((w[0], len(w)), []).append(w)
        self.by_run: dict[str, list[str]] = {}  # words with each run of a letter made one letter -> the words
        for w in sorted({*self.words, *_CLASSES_OF, *SPOKEN_TO}):
            self.by_run.setdefault(_REPEAT.sub(r"\1", w), []).append(w)
        self.automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}  # built once per worker

    def _ready(self):
        if self.automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for entry in {*self.entries, *_CLASSES_OF} - set(CONSTRUCTIONS):
                a.add_word(f" {entry} ", (entry if entry in self.entries else None, _CLASSES_OF.get(entry, ())))
            a.make_automaton()
            self.automaton = a
        return self.automaton

    def fold(self, text: str) -> str:
        """Sentences as lines of folded words."""
        text = text.lower()
        if not text.isascii():
            text = strip_accents(_HIDDEN.sub("", text)).replace("ß", "ss")
            if not text.isascii() and _BESIDE.search(text):
                text = _MIXED.sub(lambda m: "".join(LOOKALIKES.get(c, c) for c in m.group()), text)
        if _APART.search(text):
            text = _APART.sub(lambda m: self.known(re.sub(r"[ .\-_*]", "", m.group())) or m.group(), text)
        if _SIGN_INSIDE.search(text):
            text = _MASKED.sub(self.unmask, text)
        if _RUN.search(text):
            text = _STRETCHED.sub(lambda m: self.known(m.group()) or m.group(), text)
        text = _OTHER.sub(" ", _STOP.sub("\n", text))
        return " " + apart(text).replace("\n", " \n ") + " "

    def known(self, word: str) -> str | None:
        """The word if it is listed, else the listed word that it is with letters stretched: one of its runs has three or more."""
        if word in self.words:
            return word
        if not _RUN.search(word):
            return None
        runs = [len(m.group()) for m in re.finditer(r"(.)\1*", word)]
        for listed in self.by_run.get(_REPEAT.sub(r"\1", word), ()):
            if all(len(m.group()) <= n for m, n in zip(re.finditer(r"(.)\1*", listed), runs, strict=True)):
                return listed
        return None

    def unmask(self, m: re.Match) -> str:
        """The entry's word that a masked word stands for: by what its signs look like, else by its other letters."""
        word = m.group().rstrip("!")
        read = "".join(LEET.get(c, c) for c in word)
        if known := self.known(read):
            return known + m.group()[len(word) :]
        for shape in dict.fromkeys((word, _RUN.sub(r"\1", word))):
            for known in self.by_shape.get((shape[0], len(shape)), ()):
                if all(a == b or not a.isalpha() for a, b in zip(shape, known, strict=True)):
                    return known + m.group()[len(word) :]
        return m.group()

    def hits(self, text: str) -> list[tuple[int, int, int, str]]:
        """(sentence, its words, person, entry) of what is found; person: 1 if the sentence speaks to one, -1 if to the speaker."""
        return self.hits_in(self.fold(text))

    def hits_in(self, folded: str) -> list[tuple[int, int, int, str]]:
        found = list(self._ready().iter(folded))
        if not found:
            return []
        out = []
        breaks = [m.start() for m in re.finditer("\n", folded)] + [len(folded)]
        line, start, here, classes = 0, 0, [], set()

        def close() -> None:
            if not here and not classes:
                return
            sentence = folded[start : breaks[line]]
            made = [n for n, (_, needs, pattern) in CONSTRUCTIONS.items() if classes.issuperset(needs) and pattern.search(sentence)] if classes else []
            if here or made:
                person = -1 if _TO_SELF.search(sentence) else int(bool(_TO_PERSON.search(sentence)))
                size = len(sentence.split())
                out.extend((line, size, person, entry) for entry in here + made)

        for end, (entry, of) in found:
            while breaks[line] < end - 1:
                close()
                start, line, here, classes = breaks[line] + 1, line + 1, [], set()
            if entry is not None:
                here.append(entry)
            classes.update(of)
        close()
        return out

    def judge(self, hits: list[tuple[int, int, int, str]]) -> dict[str, float]:
        """The greatest weight of a sentence, by category."""
        best: dict[str, float] = {}
        sentences: dict[int, tuple[int, int, set[str]]] = {}
        for line, size, person, entry in hits:
            sentences.setdefault(line, (size, person, set()))[2].add(entry)
        for size, person, found in sentences.values():
            excused = any(role == "except" for e in found for _, role, _ in self.entries[e])
            thin = min(1.0, math.sqrt(USUAL_WORDS / max(size, 1)))
            sums: dict[str, float] = {}
            runs: dict[str, float] = {}
            covered = {w for e in found for _, role, _ in self.entries[e] if role == "strong" for w in e.split()}
            for e in found:
                for category, role, weight in self.entries[e]:
                    if role == "except" or (role != "strong" and excused):
                        continue
                    if role == "learned":  # runs of one sentence overlap
                        runs[category] = max(runs.get(category, 0.0), weight)
                        continue
                    if role != "strong" and all(w in covered for w in e.split()):
                        continue  # part of a decisive phrase that counts already
                    if role == "insult":
                        weight = max(weight, 0.35) + 0.7 if person > 0 else (0.0 if person < 0 else weight * 0.5 * thin)
                    elif role == "hint":
                        weight *= thin
                    sums[category] = sums.get(category, 0.0) + weight
            for category in {*sums, *runs}:
                best[category] = max(best.get(category, 0.0), sums.get(category, 0.0) + runs.get(category, 0.0))
        return best


def apart(text: str) -> str:
    """Ideographs and hiragana as words of their own, as there are no spaces between words."""
    return text if text.isascii() or not _WIDE.search(text) else re.sub(" +", " ", _WIDE.sub(r" \g<0> ", text))


@lru_cache(maxsize=50_000)
def fold_simple(term: str) -> str:
    return " ".join(apart(_OTHER.sub(" ", strip_accents(term.lower()).replace("ß", "ss"))).split())


def read_lexicon(lexicon: DataFrame) -> list[tuple[str, str, float]]:
    """(term, category, first weight) of all terms: severity 1 to 3 gives 0.35 to 0.55. The list must fit the driver and each task."""
    rows = lexicon.where("term is not null and category is not null").select("term", "category", "severity").distinct().orderBy("term", "category", "severity").collect()
    return [(t, c, 0.25 + 0.1 * min(max(s or 1, 1), 3)) for t, c, s in rows if c in CATEGORIES]


def beyond_chance(k: int, n: int, share: float) -> float:
    """The chance that k or more of n are confirmed, if each is by `share`."""
    if share <= 0 or k <= 0:
        return 1.0 if k <= 0 else 0.0
    log = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(share) + (n - j) * math.log1p(-min(share, 1 - 1e-12)) for j in range(k, n + 1)]
    return min(1.0, sum(map(math.exp, log)))


def grams(folded: str) -> set[str]:
    """Runs of GRAM_LEAST to GRAM words within a sentence."""
    out: set[str] = set()
    for line in folded.split("\n"):
        words = line.split()
        out.update(" ".join(words[k : k + n]) for n in range(GRAM_LEAST, GRAM + 1) for k in range(len(words) - n + 1))
    return out


COUNTS = "kind string, key string, n long, " + ", ".join(f"{c} double" for c in CATEGORIES)


def learn(documents: DataFrame, labels: DataFrame, rows: list[tuple[str, str, float]], most: int = MAX_REVIEWED) -> Matcher:
    """The matcher with what reviews teach: weights of terms and constructions, and runs of words as further entries.

    Up to `most` reviewed documents are read, by a hash of their id; conflicting reviews of a document count by their share.
    Only sums per entry, and runs that LEAST_CONFIRMED documents hold, reach the driver.
    """
    verdicts = labels.where("doc_id is not null and verdict is not null").select("doc_id", "reviewer", "verdict").distinct()
    share = verdicts.groupBy("doc_id").agg(*[F.avg((F.col("verdict") == c).cast("double")).alias(c) for c in CATEGORIES])
    share = F.broadcast(share.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))  # the bounded sample
    reviewed = documents.where("doc_id is not null and text is not null").select("doc_id", "text").join(share, "doc_id")
    first = Matcher(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number: Counter = Counter()
        sums: dict[tuple[str, str], list[float]] = {}

        def add(kind: str, key: str, share: tuple) -> None:
            number[kind, key] += 1
            have = sums.setdefault((kind, key), [0.0] * len(CATEGORIES))
            for k, x in enumerate(share):
                have[k] += x

        for b in batches:
            for text, *share in zip(b["text"], *(b[c] for c in CATEGORIES), strict=True):
                folded = first.fold(text)
                hits = first.hits_in(folded)
                for entry in {h[-1] for h in hits}:
                    add("entry", entry, share)
                found = {c for c, v in first.judge(hits).items() if v >= THRESHOLD}
                open_ = tuple(float(x > 0.5 and not found) for x in share)
                if any(open_):
                    add("all", "", open_)
                    for g in grams(folded):
                        add("run", g, open_)
                elif not found and not any(share):
                    add("none", "", open_)
        keys = list(number)
        made = pd.DataFrame({"kind": [k[0] for k in keys], "key": [k[1] for k in keys], "n": [number[k] for k in keys]})
        for k, c in enumerate(CATEGORIES):
            made[c] = [sums[x][k] for x in keys]
        if keys:
            yield made

    counted = reviewed.mapInPandas(run, COUNTS).groupBy("kind", "key").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in CATEGORIES])
    enough = (F.col("kind") != "run") | (F.greatest(*CATEGORIES) >= LEAST_CONFIRMED)
    seen: dict[tuple[str, str], dict] = {(r["kind"], r["key"]): r.asDict() for r in counted.where(enough).collect()}
    weighed = []
    for term, category, weight in rows:
        r = seen.get(("entry", fold_simple(term)))
        if r is not None:
            precision = (r[category] + 2 * weight) / (r["n"] + 2)
            weight = 0.15 + 0.5 * precision
        weighed.append((term, category, weight))
    for name, (category, _, _) in CONSTRUCTIONS.items():
        if r := seen.get(("entry", name)):  # below the threshold if fewer than four of seven are confirmed
            weighed.append((name, category, 0.6 + 0.7 * (r[category] + 2) / (r["n"] + 2)))
    return Matcher(weighed, learned_runs(reviewed, first, seen))


def learned_runs(reviewed: DataFrame, first: Matcher, seen: dict[tuple[str, str], dict]) -> list[tuple[str, str, float]]:
    """(run, category, weight): runs of unexplained confirmed documents that others hold too seldom for chance."""
    tried = {key: r for (kind, key), r in seen.items() if kind == "run"}
    if not tried:
        return []
    wanted = frozenset(tried)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number: Counter = Counter()
        for b in batches:
            for text, *share in zip(b["text"], *(b[c] for c in CATEGORIES), strict=True):
                if not any(share):
                    number.update(grams(first.fold(text)) & wanted)
        if number:
            yield pd.DataFrame({"key": list(number), "n": list(number.values())})

    calm = {r["key"]: r["n"] for r in reviewed.mapInPandas(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    none = seen.get(("none", ""), {"n": 0})["n"]
    out = []
    for c in CATEGORIES:
        good = {}
        confirmed = seen.get(("all", ""), {c: 0})[c]
        base = confirmed / max(confirmed + none, 1)
        for key, r in tried.items():
            k, n = int(r[c]), int(r[c]) + calm.get(key, 0)
            if k >= LEAST_CONFIRMED and k >= 0.6 * n and beyond_chance(k, n, base) * len(tried) < CHANCE:
                good[key] = (k, 0.6 + 0.7 * (k + 2) / (n + 2))
        # of runs that stand in the same documents only the longest says what they are about
        part_of: dict[str, int] = {}
        for key, (k, _) in good.items():
            words = key.split()
            for n in range(GRAM_LEAST, len(words)):
                for at in range(len(words) - n + 1):
                    part = " ".join(words[at : at + n])
                    part_of[part] = max(part_of.get(part, 0), k)
        out += [(key, c, weight) for key, (k, weight) in good.items() if part_of.get(key, 0) < 0.8 * k]
    return out


SCORES = "doc_id long, source string, words int, " + ", ".join(f"{c} double, {c}_rate double" for c in CATEGORIES)


def score_documents(documents: DataFrame, lexicon: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, words, abuse, abuse_rate, hate, hate_rate, sexual, sexual_rate) of every document, without a shuffle.

    A category's score is the weight of its worst sentence, THRESHOLD or more for a case; the rate is the score per 100
    words (an ideograph or hiragana is one). Null, empty and letterless texts score 0. Null ids are left out; repeated rows
    repeat their row; other columns are ignored; an empty lexicon leaves the built-in lists; no labels leave the first weights.
    """
    rows = read_lexicon(lexicon)
    matcher = Matcher(rows) if labels is None else learn(documents, labels, rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {"doc_id": b["doc_id"], "source": b["source"]}
            folded = [matcher.fold(t) if isinstance(t, str) else "" for t in b["text"]]
            words = pd.Series([len(f.split()) for f in folded], index=b.index, dtype="int32")
            best = [matcher.judge(matcher.hits_in(f)) for f in folded]
            out["words"] = words
            for c in CATEGORIES:
                out[c] = pd.Series([x.get(c, 0.0) for x in best], index=b.index, dtype=float)
                out[f"{c}_rate"] = 100 * out[c] / words.clip(lower=1)
            yield pd.DataFrame(out)

    return documents.where("doc_id is not null").select("doc_id", "source", "text").mapInPandas(run, SCORES)


def cases(scores: DataFrame) -> DataFrame:
    """(doc_id, category) of the scores at or beyond the threshold."""
    each = F.array(*[F.when(F.col(c) >= THRESHOLD, F.lit(c)) for c in CATEGORIES])
    return scores.select("doc_id", F.explode(F.filter(each, lambda c: c.isNotNull())).alias("category")).distinct()


def source_rates(scores: DataFrame) -> DataFrame:
    """(source, documents, abuse_share, hate_share, sexual_share): shares of each source's documents; a null source is one."""
    each = [F.avg((F.col(c) >= THRESHOLD).cast("double")).alias(f"{c}_share") for c in CATEGORIES]
    return scores.groupBy("source").agg(F.count("*").alias("documents"), *each)
