"""Problem 1: the language of texts and of their segments, by string kernels.

The kernel of two texts is the number of character n-grams (n = 2 to 4, a blended spectrum) present in both, divided by
the root of the product of their own numbers. Nystroem landmarks are a fixed share of the labelled samples; ridge
regression in their feature space gives one classifier per language. As the kernel against landmarks is X A' (X: which
n-grams a segment has, A: which a landmark has), the scores of a block of segments are the product X (A' W), computed
block by block with W the classifiers' weights over landmarks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The nine languages, and the spellings of each beside its two-letter code.
LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "ru", "zh", "ja")
SPELLINGS = {
    "en": "eng english anglais englisch inglés ingles inglese",
    "de": "deu ger german deutsch allemand alemán",
    "fr": "fra fre french français francais französisch",
    "es": "spa esp spanish español espanol castellano castilian spanisch",
    "pt": "por portuguese português portugues portugiesisch",
    "it": "ita italian italiano italienisch",
    "ru": "rus russian русский russisch",
    "zh": "zho chi cmn chinese mandarin 中文 汉语 漢語 chinesisch",
    "ja": "jpn japanese 日本語 japanisch",
}

#: Cyrillic letters as they are commonly written with Latin ones.
LATIN = dict(
    zip(
        "абвгдежзийклмнопрстуфхцчшщъыьэюяё",
        "a b v g d e zh z i y k l m n o p r s t u f kh ts ch sh shch - y - e yu ya yo".split(),
        strict=True,
    )
)

ORDERS = (2, 3, 4)
SLOTS = 1 << 19
SEP, SPACE = 0xFFFF, 32
_PICK, _CHARS = 1 << 21, 1 << 18
LANDMARKS_PER_LANGUAGE = 60
RIDGE = 0.3
MAX_SAMPLES = 20_000  # labelled rows used in training, at most


def label_code(label: Column) -> Column:
    """The two-letter code that a label names, else null (null, blank, no language); case, region, script are ignored."""
    key = F.lower(F.regexp_extract(F.trim(label), r"^([\p{L}]+)(?:[-_ (.].*)?$", 1))
    names = F.create_map(*[F.lit(x) for code in LANGUAGES for word in (code, *SPELLINGS[code].split()) for x in (word, code)])
    return F.when(key != "", F.element_at(names, key))


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """Code point to lower case letter, or a space for anything but letters and marks; the separator stays."""
    lut = np.full(0x10000, SPACE, np.uint16)
    for c in range(0x10000):
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LM":
            low = unicodedata.normalize("NFKC", ch).lower()
            lut[c] = ord(low) if len(low) == 1 and ord(low) < SEP else c
    lut[SEP] = SEP
    for c in (0x200B, 0x200C, 0x200D, 0xAD, 0xFEFF):
        lut[c] = 0
    return lut


def codes(texts: list[str]) -> np.ndarray:
    """The texts as one array of letters and single spaces, the separator between them."""
    raw = np.frombuffer((" " + " ￿ ".join([*texts, ""])).encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = _table()[np.where(raw > SEP, SPACE, raw) if raw.size and raw.max() > SEP else raw]
    cp = cp[cp != 0]
    blank = cp == SPACE
    keep = np.ones(len(cp), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return cp[keep].astype(np.uint64)


def _keys(cp: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the n-grams as exact 64-bit keys, at the position where each begins."""
    key = cp
    for n in range(2, ORDERS[-1] + 1):
        key = (key[:-1] << np.uint64(16)) | cp[n - 1 :]
        if n in ORDERS:
            yield key


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)


def fold_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).replace("ß", "ss")


def romanise(text: str) -> str:
    return "".join(LATIN.get(c, c) for c in text.lower()).replace("-", "")


class Classifier:
    """Nystroem features and one-versus-rest ridge regression over the spectrum kernel."""

    def __init__(self, samples: list[tuple[str, str]], per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> None:
        """samples: (language, text); each also counts as typed without accents, Russian also in Latin letters."""
        rows: list[tuple[str, str]] = []
        for lang, text in sorted(set(samples)):
            rows.append((lang, text))
            if lang == "ru":
                rows.append((lang, romanise(text)))
            elif fold_accents(text) != text and lang not in ("zh", "ja"):
                rows.append((lang, fold_accents(text)))
        seen: dict[str, int] = {}
        marks = []
        for lang, text in sorted(rows, key=lambda r: (len(r[1]) < 60, hash_text(r[1]))):
            if seen.get(lang, 0) < per_language * (2 if lang == "ru" else 1):
                seen[lang] = seen.get(lang, 0) + 1
                marks.append(text)
        vocabulary = np.unique(np.concatenate([k for k in _keys(codes(marks)) if len(k)]))
        vocabulary = vocabulary[~_has_separator(vocabulary) & (vocabulary != SPACE)]
        _, first = np.unique(_slot(vocabulary), return_index=True)
        vocabulary = vocabulary[np.sort(first)]  # n-grams that share a slot with another are left out of the kernel
        self.keys = vocabulary
        self.slots = np.full(SLOTS, -1, np.int32)
        self.slots[_slot(vocabulary)] = np.arange(len(vocabulary), dtype=np.int32)
        a = self._presence(marks)
        na = np.sqrt(np.maximum(a.sum(1, dtype=np.float32), 1))
        k_mm, k_nm = self._kernel(marks, a, na), self._kernel([t for _, t in rows], a, na)
        value, vector = np.linalg.eigh(k_mm)
        good = value > 1e-6
        root = vector[:, good] / np.sqrt(value[good])
        phi = k_nm @ root
        y = np.array([[1.0 if lang == c else -1.0 for c in LANGUAGES] for lang, _ in rows])
        phi1 = np.hstack([phi, np.ones((len(phi), 1))])
        w = np.linalg.solve(phi1.T @ phi1 + ridge * np.eye(phi1.shape[1]), phi1.T @ y)
        self.bias = w[-1].astype(np.float32)
        dual = ((root @ w[:-1]) / na[:, None]).astype(np.float32)
        self.weights = np.zeros((len(self.keys), len(LANGUAGES)), np.float32)  # A' W
        for k in range(0, len(a), 128):
            self.weights += a[k : k + 128].T.astype(np.float32) @ dual[k : k + 128]

    def _kernel(self, texts: list[str], a: np.ndarray, na: np.ndarray) -> np.ndarray:
        """(texts x landmarks): the landmarks' rows of each text's n-grams, added up."""
        by_gram = np.ascontiguousarray(a.T)
        out = np.empty((len(texts), len(a)), np.float32)
        for k in range(0, len(texts), 64):
            part = texts[k : k + 64]
            cp = codes(part)
            found: list[list[np.ndarray]] = [[] for _ in part]
            for seg, ids in self._present(cp, np.cumsum(cp == SEP, dtype=np.int32), len(part)):
                for i, own in enumerate(np.split(ids, np.searchsorted(seg, np.arange(1, len(part))))):
                    found[i].append(own)
            for i, parts in enumerate(found):
                ids = np.concatenate(parts)
                out[k + i] = by_gram[ids].sum(0, dtype=np.float32) / np.sqrt(max(len(ids), 1)) / na
        return out

    def _presence(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.keys)), np.uint8)
        for k in range(0, len(texts), 64):
            part = texts[k : k + 64]
            cp = codes(part)
            for seg, ids in self._present(cp, np.cumsum(cp == SEP, dtype=np.int32), len(part)):
                out[k + seg, ids] = 1
        return out

    def _present(self, cp: np.ndarray, at: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order, (segment, n-gram) of each distinct known n-gram, segments ascending."""
        v = np.int32(len(self.keys))
        mark = np.empty(n * int(v), np.int32)  # written before it is read
        for key in _keys(cp):
            ids = self.slots[_slot(key)]
            hit = np.flatnonzero(ids >= 0)
            ids = ids[hit]
            same = self.keys[ids] == key[hit]
            if not same.all():
                hit, ids = hit[same], ids[same]
            seg = at[hit]
            pair = seg * v + ids
            order = np.arange(len(pair), dtype=np.int32)
            mark[pair] = order
            first = mark[pair] == order
            yield seg[first], ids[first]

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages, letters of each text)."""
        per = max(1, _PICK // len(self.keys))
        out = np.full((len(texts), len(LANGUAGES)), -1.0, np.float32)
        letters = np.zeros(len(texts), np.int64)
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and end - start < per and (chars < _CHARS or end == start):
                chars += len(texts[end])
                end += 1
            cp = codes(texts[start:end])
            at = np.cumsum(cp == SEP, dtype=np.int32)
            n = end - start
            letters[start:end] = np.bincount(at[cp != SPACE], minlength=n + 1)[:n] - (np.arange(n) > 0)
            total, size = np.zeros((n, len(LANGUAGES)), np.float32), np.zeros(n, np.float32)
            for seg, ids in self._present(cp, at, n):
                if len(seg):
                    first = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
                    total[seg[first]] += np.add.reduceat(self.weights[ids], first)
                    size[seg[first]] += np.diff(np.concatenate((first, [len(seg)])))
            known = size > 0
            out[start:end][known] = total[known] / np.sqrt(size[known])[:, None] + self.bias
            start = end
        return out, letters


def _has_separator(keys: np.ndarray) -> np.ndarray:
    return np.any([((keys >> np.uint64(16 * i)) & np.uint64(0xFFFF)) == SEP for i in range(4)], axis=0)


def hash_text(text: str) -> int:
    h = 0
    for b in text.encode():
        h = (h * 1000003 ^ b) & 0xFFFFFFFF
    return h


TEMPERATURES = (1.0, 2.0, 3.0, 4.0, 6.0, 8.0)
CLEAR = 0.6  # a sentence speaks for a second language only if it beats the document's others by this much
SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|\n+")
_CODE = re.compile(r"(?is)<(pre|code|script|style)\b.*?</\1\s*>")
_TAG = re.compile(r"<[^<>]*>")
#: A line of code or markup: an assignment, a call that ends a statement, braces, a tag.
_CODE_LINE = re.compile(r"\w\s*=\s*[\w\"'\[{(]|[{}]|<[/|]?\w+\|?>|\w\(\S*\)\s*;")
_ENTITY = re.compile(r"&(#\d+|#x[0-9a-fA-F]+|\w+);")


def confidence(scores: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp((scores - scores.max(1, keepdims=True)) * temperature)
    return e.max(1) / e.sum(1)


def plain(markup: bytes | str) -> str:
    """Running text of XHTML, without code and tags."""
    import html

    text = markup if isinstance(markup, str) else markup.decode("utf-8", "replace")
    if "<" in text:
        text = _TAG.sub(" ", _CODE.sub(" ", text))
    return html.unescape(text) if "&" in text else text


def enough(letters: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Whether a segment is long enough to judge alone: 15 letters, 5 in the scripts without spaces."""
    return letters >= np.where(best >= LANGUAGES.index("zh"), 5, 15)


def read_document(model: Classifier, scores: np.ndarray, letters: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The languages of a document, the strongest first, and the language of each sentence, from the sentences' scores.

    Sentences speak in turn: the language with the most letters leads; a further one is accepted if at least two
    sentences, long enough to judge, prefer it clearly to all accepted ones.
    """
    best = scores.argmax(1)
    total = (scores * letters[:, None]).sum(0)
    weight = np.bincount(best, letters * (scores.max(1) - np.sort(scores, 1)[:, -2]), len(LANGUAGES))
    lead = int(weight.argmax()) if weight.any() else int(total.argmax())
    accepted = [lead]
    able = enough(letters, best)
    while True:
        clear = able & (scores.max(1) - scores[:, accepted].max(1) >= CLEAR)
        count = np.bincount(best[clear], minlength=len(LANGUAGES))
        if count.max() < 2:
            break
        accepted.append(int(count.argmax()))
    own = np.array(accepted)[scores[:, accepted].argmax(1)]
    # the lead itself needs two sentences, else the document is in the other language
    if len(accepted) > 1:
        kept = [c for c in accepted if (able & (own == c)).sum() >= 2] or accepted[:1]
        accepted = kept
        own = np.array(accepted)[scores[:, accepted].argmax(1)]
    return accepted, own


CONFIRMED = 0.7  # of a labelled document's sentences


def train(
    samples: DataFrame, documents: DataFrame | None = None, max_samples: int = MAX_SAMPLES, max_documents: int = 3000, max_sentences: int = 240
) -> tuple[Classifier, float]:
    """(model, temperature) from labelled samples and, to see more of each language, from a bounded number of labelled
    documents whose label the first model confirms in at least CONFIRMED of their sentences.

    Bounds: max_samples samples, max_documents documents and of these max_sentences sentences a language, by the order of a
    hash of their text. The temperature is the one of TEMPERATURES under which the samples are likeliest by a model that did not see them.
    """
    from .sampling import labelled

    rows = labelled(samples, max_samples)
    if not rows:
        raise ValueError("no labelled samples")
    rows.sort(key=lambda r: (hash_text(r[1]), r))
    half = Classifier(rows[::2])
    scores, _ = half.scores([t for _, t in rows[1::2]])
    right = np.array([LANGUAGES.index(lang) for lang, _ in rows[1::2]], int)

    def loss(t: float) -> float:
        z = scores * t
        z = z - z.max(1, keepdims=True)
        return float(-(z[np.arange(len(right)), right] - np.log(np.exp(z).sum(1))).mean()) if len(right) else 0.0

    temperature = min(TEMPERATURES, key=loss)
    model = Classifier(rows)
    if documents is None:
        return model, temperature
    known = labelled(documents, max_documents, 100)
    more: dict[str, list[str]] = {}
    for lang, text in known:
        sentences = [s for s in SENTENCE.split(text) if len(s) > 12]
        if not sentences:
            continue
        sc, letters = model.scores(sentences)
        languages, own = read_document(model, sc, letters)
        if languages == [LANGUAGES.index(lang)] and (sc.argmax(1) == languages[0]).mean() >= CONFIRMED:
            more.setdefault(lang, []).extend(sentences)
    extra = [(lang, s) for lang, s in sorted((k, t) for k, v in more.items() for t in sorted(set(v), key=hash_text)[:max_sentences])]
    return Classifier(rows + extra, per_language=2 * LANDMARKS_PER_LANGUAGE), temperature


READ = "lang string, confidence double, languages array<struct<lang:string,sentences:int,letters:int>>, segments array<struct<start:int,end:int,lang:string,confidence:double>>"


def label_documents(documents: DataFrame, model: Classifier, temperature: float) -> DataFrame:
    """(doc_id, label, lang, confidence, languages, segments) of documents (doc_id, text, lang); label is the given lang."""
    given = documents.select("doc_id", F.col("lang").alias("label"), "text")
    return label_texts(given, ["doc_id", "label"], "text", model, temperature)


def label_texts(df: DataFrame, keys: list[str], text: str, model: Classifier, temperature: float, markup: bool = False) -> DataFrame:
    """keys + (lang, confidence, languages, segments) of each text (with markup: of what it shows), without a shuffle.

    Lines of code aren't judged. segments are runs of sentences in one language, as code point offsets. A null, empty or
    letterless text has a null language and empty arrays; null keys stay; repeated rows stay repeated; other columns are
    ignored; an empty table gives no rows.
    """
    source = df.select(*keys, F.col(text).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def one(text: str, cuts: list[tuple[int, int]], sc: np.ndarray, letters: np.ndarray) -> tuple:
        if not letters.sum():
            return None, None, [], []
        languages, own = read_document(model, sc, letters)
        sure = confidence(sc, temperature)
        counts = [
            {"lang": LANGUAGES[c], "sentences": int(((own == c) & (letters > 0)).sum()), "letters": int(letters[own == c].sum())}
            for c in languages
        ]
        segments = []
        for k, (a, b) in enumerate(cuts):
            lang = LANGUAGES[own[k]] if letters[k] else (segments[-1]["lang"] if segments else LANGUAGES[languages[0]])
            if segments and segments[-1]["lang"] == lang:
                segments[-1]["end"] = b
                segments[-1]["_"].append((letters[k], sure[k]))
            else:
                segments.append({"start": a, "end": b, "lang": lang, "_": [(letters[k], sure[k])]})
        for s in segments:
            n = sum(x for x, _ in s["_"])
            s["confidence"] = float(sum(x * y for x, y in s.pop("_")) / n) if n else 0.0
        total = (sc * letters[:, None]).sum(0, keepdims=True) / letters.sum()
        return LANGUAGES[languages[0]], float(confidence(total, temperature)[0]), counts, segments

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [plain(t) if markup and t is not None else t if isinstance(t, str) else "" for t in batch["__text"]]
            cuts = [spans(t) for t in texts]
            sentences = [t[a:b] for t, c in zip(texts, cuts, strict=True) for a, b in c]
            sc, letters = model.scores(["" if _CODE_LINE.search(s) else s for s in sentences])  # code speaks no language
            at, rows = 0, []
            for t, c in zip(texts, cuts, strict=True):
                rows.append(one(t, c, sc[at : at + len(c)], letters[at : at + len(c)]))
                at += len(c)
            out = pd.DataFrame(rows, columns=["lang", "confidence", "languages", "segments"], index=batch.index)
            yield pd.concat([batch[keys], out], axis=1)

    return source.mapInPandas(run, f"{kinds}, {READ}")


def spans(text: str) -> list[tuple[int, int]]:
    """[start, end) of each sentence that isn't blank."""
    out, start = [], 0
    for m in SENTENCE.finditer(text):
        if m.start() > start:
            out.append((start, m.start()))
        start = m.end()
    if start < len(text):
        out.append((start, len(text)))
    return out


_SCORES = ", ".join(f"s_{c} double" for c in LANGUAGES)
PART = f"book_id string, chapter int, letters long, {_SCORES}"


def score_parts(df: DataFrame, model: Classifier, markup: bool, chapter: str | None = None) -> DataFrame:
    """Letters and summed scores of each book (and chapter) in each batch of rows (book_id, [chapter], text).

    Null books and null texts are left out; rows of a book may give several parts, which add up.
    """
    text = F.col("content") if markup else F.col("text")
    source = df.select("book_id", (F.col(chapter) if chapter else F.lit(-1)).cast("int").alias("chapter"), text.alias("text"))
    source = source.where("book_id is not null and text is not null and chapter is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [plain(t) for t in batch["text"]] if markup else batch["text"].tolist()
            sc, letters = model.scores(texts)
            parts = pd.DataFrame(sc * letters[:, None], columns=[f"s_{c}" for c in LANGUAGES])
            parts.insert(0, "letters", letters)
            parts.insert(0, "chapter", batch["chapter"].to_numpy())
            parts.insert(0, "book_id", batch["book_id"].to_numpy())
            yield parts.groupby(["book_id", "chapter"], as_index=False).sum() if not chapter else parts

    return source.mapInPandas(run, PART)


CHAPTER_CLEAR, CHAPTER_LETTERS = 0.8, 60


def label_books(parts: DataFrame, temperature: float) -> DataFrame:
    """(book_id, lang, confidence, languages): the language of each book, and all languages of which it has chapters.

    parts: rows of score_parts. A book's language has the greatest sum of scores by letters; a further language needs a
    whole chapter of at least CHAPTER_LETTERS letters that prefers it by CHAPTER_CLEAR. Repeated chapters count once.
    Books without letters have a null language.
    """
    scores = [F.col(f"s_{c}") for c in LANGUAGES]
    # one row per chapter; its repeated rows have the same scores, so their mean changes nothing
    chapters = parts.where("chapter >= 0").groupBy("book_id", "chapter").agg(
        F.max("letters").alias("letters"), *[F.max(s).alias(f"s_{c}") for s, c in zip(scores, LANGUAGES, strict=True)]
    )
    whole = chapters.unionByName(parts.where("chapter < 0"))
    best = F.greatest(*scores)
    named = F.coalesce(*[F.when(s == best, F.lit(c)) for s, c in zip(scores, LANGUAGES, strict=True)])
    ordered = F.array_sort(F.array(*scores))
    clear = (F.col("chapter") >= 0) & (F.col("letters") >= CHAPTER_LETTERS) & (
        (ordered[8] - ordered[7]) / F.col("letters") >= CHAPTER_CLEAR
    )
    books = (
        whole.withColumn("clear", F.when(clear, named))
        .groupBy("book_id")
        .agg(F.sum("letters").alias("letters"), F.collect_set("clear").alias("found"), *[F.sum(s).alias(f"s_{c}") for s, c in zip(scores, LANGUAGES, strict=True)])
    )
    mean = [s / F.col("letters") for s in scores]
    top = F.greatest(*mean)
    total = sum((F.exp((m - top) * temperature) for m in mean), F.lit(0.0))
    lang = F.when(F.col("letters") > 0, named)
    return books.select(
        "book_id", lang.alias("lang"), F.when(F.col("letters") > 0, 1 / total).alias("confidence"),
        F.when(F.size("found") > 1, F.array_sort("found")).otherwise(F.when(lang.isNotNull(), F.array(lang)).otherwise(F.array())).alias("languages"),
    )
