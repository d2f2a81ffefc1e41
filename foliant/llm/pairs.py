"""Problem 2: defective prompt and response pairs, with the type of defect.

All responses are sorted by their text in each target language and compared with the neighbour that begins with them: one
that is only the beginning of an established one is a shortened version. Spikes (one length far more often than its
neighbours) show responses cut by a limit. Then come the rules for copies, refusals and languages.

Short responses (glossary) are sorted as phrases, with a placeholder for the name that prompt and response share. Counts
over all rows tell which phrase a prompt usually gets and in which language a phrase is at home. Verdicts are found for
the distinct pairs of phrases and joined to their rows once.

Long responses (chapters) are sorted by the hashes of their blocks of letters, which keeps common prefixes together; both
sides are reduced to features before anything is joined, so no text is shuffled. As most answers stand alone, sentence and
length ratios to the prompt add to what neighbours and spikes tell.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import checkpointed

from . import langid

#: What refusals say, by language: inability or regret near the task.
REFUSALS = (
    r"\b(?:sorry|unfortunately|apologi[sz]e)\b.{0,60}\b(?:can'?t|cannot|can not|unable|not able|won'?t)\b",
    r"\bI (?:can'?t|cannot|am unable to|am not able to|won'?t)\b.{0,40}\b(?:assist|help|translate|provide|comply|fulfil)",
    r"\blanguage model\b.{0,60}\b(?:unable|can'?t|cannot|not able)\b",
    r"\b(?:es tut mir leid|leider|entschuldigung)\b.{0,60}\b(?:nicht)\b.{0,30}\b(?:helfen|übersetzen|möglich|erfüllen)\b",
    r"\bkann ich (?:leider )?nicht (?:übersetzen|helfen)\b",
    r"\b(?:désolée?|en tant qu'(?:assistant|ia)|malheureusement)\b.{0,60}\bne (?:peux|suis|puis)\b.{0,30}\b(?:pas|en mesure)\b",
    r"\b(?:lo siento|lamentablemente)\b.{0,40}\bno (?:puedo|me es posible)\b|\bno me es posible (?:ayudar|traducir)\b|\bno puedo (?:ayudar|traducir)\b.{0,30}\b(?:solicitud|texto|contenido)\b",
    r"\b(?:desculpe|sinto muito|infelizmente)\b.{0,40}\bnão (?:posso|consigo|é possível)\b|\bnão posso (?:ajudar|traduzir)\b",
    r"\b(?:mi dispiace|purtroppo)\b.{0,40}\bnon (?:posso|sono in grado|è possibile)\b|\bnon posso (?:aiutare|tradurre)\b",
    r"\b(?:извините|простите|к сожалению)\b.{0,40}\bне (?:могу|в состоянии)\b|\bя не могу (?:помочь|перевести)\b",
    r"(?:抱歉|对不起|语言模型).{0,20}(?:无法|不能)|(?:无法|不能)(?:翻译|协助|帮助).{0,10}(?:内容|请求|文本)",
    r"(?:申し訳|すみません|恐れ入り).{0,40}(?:できません|できかねます|いたしかねます)|言語モデル.{0,40}できません",
)
REFUSAL = re.compile("|".join(REFUSALS), re.I | re.S)
#: Placeholders that stand for an answer.
PLACEHOLDERS = frozenset({"n/a", "na", "n.a.", "tbd", "todo", "null", "none", "nil", "-", "--", "—", "…", "...", "?", "???", "[empty]", "(empty)", "[blank]", "xxx", "..."})

_MARKS = re.compile(r"[\W_]+")
_WIDE = re.compile("[぀-ヿ一-鿿]")
_TAG = re.compile(r"<[^<>]*>")
_HEAD = re.compile(r"(?is)<head\b.*?</head\s*>|<h[1-6]\b.*?</h[1-6]\s*>|<title\b.*?</title\s*>|<!--.*?-->")
_CODE = re.compile(r"(?is)<(pre|code|script|style)\b.*?</\1\s*>")
_SENTENCE = re.compile(r"[.!?…][\"'”’»“)\]]*(?=\s|$|<|[^\x00-\x7f])|[。！？]")
_END = re.compile(r"(?:[.!?…。！？][\s\"'”’»“«」』)\]*_]*|[」』”»])$")
_NAME = re.compile(r"(?<![^\W_])[A-Z][a-z]{3,}(?![a-z])")


def letters_of(text: str) -> str:
    """Case, white space, quotes, marks and hidden characters aside."""
    return _MARKS.sub("", text.casefold())


def bare(text: str) -> str:
    return re.sub(r"\s+", " ", html.unescape(_TAG.sub(" ", text))).strip()


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    plain = bare(text)
    return plain.lower() in PLACEHOLDERS or not any(c.isalnum() for c in plain)


# ---------------------------------------------------------------- short responses


def template(term: str, response: str) -> tuple[str, str, bool]:
    """(prompt phrase, response phrase, name cut): both folded, the name that the prompt ends or begins with as @."""
    fold = lambda t: re.sub(r"\s+", " ", t).strip(" \"'“”„«»‘’").casefold()
    names = _NAME.findall(term)
    name = names[-1].casefold() if names and names[-1] != term.strip() else ""
    key, out = fold(term), fold(response)
    if not name:
        return key, out, False
    whole = re.compile(f"(?<![a-z]){name}(?![a-z])")
    key = whole.sub("@", key)
    if whole.search(out):
        return key, whole.sub("@", out), False
    for n in range(len(name) - 1, 1, -1):
        if out.endswith(name[:n]) and not out[-n - 1 : -n].isalpha():
            return key, out[:-n].rstrip(), True
    return key, out, False


FLAGS = ["empty", "refusal", "copy", "proper"]
SHORT = "entry_id long, target string, source string, key string, phrase string, chars int, empty boolean, refusal boolean, copy boolean, proper boolean, kernel_lang string, kernel_lead double"


def one_job(jobs: DataFrame, *columns) -> DataFrame:
    """One row a job: repeated rows count once, of rows that differ the least."""
    made = jobs.where("job_id is not null").select("job_id", F.struct(*columns).alias("j"))
    return made.groupBy("job_id").agg(F.min("j").alias("j")).select("job_id", "j.*")


def short_features(glossary: DataFrame, jobs: DataFrame, model: langid.Classifier) -> DataFrame:
    """One row of features per glossary row; rows whose job is unknown or whose id or term is null are left out."""
    jobs = one_job(jobs, langid.label_code(F.col("target_lang")).alias("target"), langid.label_code(F.col("source_lang")).alias("source"))
    rows = glossary.where("entry_id is not null and term is not null").select("entry_id", "job_id", "term", "translation").join(jobs, "job_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            response = [r if isinstance(r, str) else None for r in b["translation"]]
            made = [template(t, r or "") for t, r in zip(b["term"], response, strict=True)]
            sc, letters = model.scores([p.replace("@", " ") for _, p, _ in made])
            target = np.array([langid.LANGUAGES.index(t) if t in langid.LANGUAGES else -1 for t in b["target"]])
            lead = sc.max(1) - np.where(target >= 0, sc[np.arange(len(sc)), target], sc.max(1))
            yield pd.DataFrame({
                "entry_id": b["entry_id"], "target": b["target"], "source": b["source"],
                "key": [m[0] for m in made], "phrase": [m[1] for m in made], "chars": [len(r or "") for r in response],
                "empty": [is_empty(r) for r in response],
                "refusal": [bool(r and REFUSAL.search(r)) for r in response],
                "copy": [bool(r) and letters_of(r) != "" and letters_of(r) == letters_of(t) for t, r in zip(b["term"], response, strict=True)],
                "proper": [all(w[:1].isupper() and w.isascii() for w in t.split()) for t in b["term"]],
                "kernel_lang": [langid.LANGUAGES[k] for k in sc.argmax(1)],
                "kernel_lead": np.round(np.where(letters >= 3, lead, 0.0).astype(float), 3),
            })

    return rows.select("entry_id", "term", "translation", "target", "source").mapInPandas(run, SHORT)


def shortened(texts: DataFrame) -> DataFrame:
    """(target, text, longer, longer_n): texts (STRING or BINARY) of which the next in the sorted order is a continuation.

    texts: (target, text, n), distinct. Ranges of the sorted order go to tasks, which may part a text from its
    continuation; so each task also tells its first and last row, and these are compared too. Empty texts have no
    continuation, nor does a null target.
    """
    kind = texts.schema["text"].dataType.simpleString()
    ordered = texts.where("target is not null and length(text) > 0").select("target", "text", "n").repartitionByRange("target", "text").sortWithinPartitions("target", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, first, last = TaskContext.get().partitionId(), None, None
        columns = ["part", "edge", "target", "text", "n", "longer", "longer_n"]
        for b in batches:
            out = []
            for row in zip(b["target"], b["text"], b["n"], strict=True):
                first = first or row
                if last and last[0] == row[0] and row[1].startswith(last[1]):
                    out.append((part, 0, *last, row[1], row[2]))
                last = row
            yield pd.DataFrame(out, columns=columns)
        if first:
            yield pd.DataFrame([(part, 1, *first, None, 0), (part, 2, *last, None, 0)], columns=columns)

    made = f"part int, edge int, target string, text {kind}, n long, longer {kind}, longer_n long"
    found = checkpointed(ordered.mapInPandas(run, made))  # the ranges are drawn anew if they are computed again
    ends = found.where("edge > 0").orderBy("part", "edge").collect()  # two rows a task
    more = [(a["target"], a["text"], b["text"], b["n"]) for a, b in zip(ends[1::2], ends[2::2], strict=False) if a["target"] == b["target"] and b["text"].startswith(a["text"])]
    out = f"target string, text {kind}, longer {kind}, longer_n long"
    return found.where("edge = 0").select("target", "text", "longer", "longer_n").unionByName(found.sparkSession.createDataFrame(more, out))


HOME_LEAST, HOME_SHARE = 3, 0.15
SALT = 16


def short_defects(features: DataFrame) -> DataFrame:
    """(entry_id, defect) of defective short responses, from short_features.

    In order: empty, refusal, copy (but for names: capitalised words that most responses, over all languages, repeat),
    other_language (the phrase is at home in another language), truncated. Ties between usual phrases go to the one that
    sorts last, so that a shortened version never wins over its continuation.
    """
    features = checkpointed(features)
    same = ["target", "source", "key", "phrase", "chars", *FLAGS, "kernel_lang", "kernel_lead"]
    # distinct pairs of phrases with their number: summed up before the shuffle, so that none is a hot key below
    pairs = checkpointed(features.groupBy(*same).agg(F.count("*").alias("n")))
    good = ~F.col("empty") & ~F.col("refusal") & ~F.col("copy") & F.col("target").isNotNull()
    of_key, of_usual = Window.partitionBy("key"), Window.partitionBy("key", "target")
    each = pairs.withColumn("good", good)
    # what a prompt usually gets; names that most responses repeat
    each = each.withColumn("answered", F.sum(F.when(good, F.col("n"))).over(Window.partitionBy("key", "target", "phrase")))
    each = each.withColumn("usual", F.max(F.when(good, F.struct("answered", "phrase"))).over(of_usual)["phrase"])
    told = ~F.col("empty") & ~F.col("refusal")
    each = each.withColumn("copied", F.sum(F.when(told & F.col("copy"), F.col("n")).otherwise(0)).over(of_key) / F.sum(F.when(told, F.col("n"))).over(of_key))
    # where a phrase is at home: the language that most responses and prompts with it are in
    phrases = pairs.where(good).groupBy("target", "phrase").agg(F.sum("n").alias("n"))
    asked = pairs.where("source is not null").groupBy(F.col("source").alias("lang"), F.col("key").alias("phrase")).agg(F.sum("n").alias("n"))
    places = phrases.select(F.col("target").alias("lang"), "phrase", "n", F.col("n").alias("own")).unionByName(asked.withColumn("own", F.lit(0).cast("bigint")))
    places = places.groupBy("phrase", "lang").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
    homes = places.groupBy("phrase").agg(F.max(F.struct("n", "lang")).alias("home"), F.map_from_entries(F.collect_list(F.struct("lang", "own"))).alias("by"))
    joined = each.join(homes, "phrase", "left").withColumn("own_n", F.element_at("by", F.col("target")))
    joined = joined.join(shortened(phrases.withColumnRenamed("phrase", "text")).withColumnRenamed("text", "phrase"), ["target", "phrase"], "left")
    limits = spikes(pairs.where(good).select(F.col("chars").alias("tokens"), "n")).select(F.col("tokens").alias("chars"), F.lit(True).alias("spike"))
    joined = joined.join(limits, "chars", "left")
    at_home = (F.col("home.lang") == F.col("target")) | (F.col("own_n") >= HOME_SHARE * F.col("home.n"))
    foreign = F.when(F.col("home.n") >= HOME_LEAST, ~at_home).otherwise((F.col("kernel_lang") != F.col("target")) & (F.col("kernel_lead") >= 0.6))
    no_name = F.col("key").contains("@") & ~F.col("phrase").contains("@")
    longer = F.coalesce(F.col("longer"), F.lit(""))
    goes_on = (F.length(longer) > 0) & ~longer.contains("@")
    cut = (
        (no_name & F.coalesce(F.col("usual"), longer).contains("@"))
        | (no_name & longer.contains("@"))
        | ((F.col("usual") != F.col("phrase")) & F.expr("startswith(usual, phrase)"))
        | (~F.col("key").contains("@") & goes_on & (F.col("longer_n") >= 3 * F.col("own_n")))
        | (goes_on & F.coalesce(F.col("spike"), F.lit(False)) & (F.col("longer_n") > F.col("own_n")))
    )
    defect = (
        F.when(F.col("empty"), "empty")
        .when(F.col("refusal"), "refusal")
        .when(F.col("copy") & ~(F.col("proper") & (F.col("copied") > 0.5)), "copy")
        .when(F.col("copy"), None)
        .when(cut & no_name, "truncated")
        .when(foreign, "other_language")
        .when(cut, "truncated")
    )
    # a defective pair of phrases may be a hot one: its rows are spread over SALT tasks
    pair = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in same])
    wrong = joined.select(pair.alias("pair"), defect.alias("defect")).where("defect is not null").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = features.select("entry_id", pair.alias("pair"), F.pmod(F.xxhash64("entry_id"), F.lit(SALT)).cast("int").alias("salt"))
    return rows.join(wrong, ["pair", "salt"]).select("entry_id", "defect")


# ---------------------------------------------------------------- long responses

LONG = "empty boolean, refusal boolean, code boolean, hash string, chain binary, sentences int, letters long, ended boolean, tokens int, scores array<float>, wide boolean"
CHAIN = 128  # letters of a block, of which a text is a chain


def is_refusal(story: str) -> bool:
    """Whether a text, however long, says hardly anything but that the task is declined."""
    rest = 0
    for sentence in re.split(r"(?<=[.!?…])\s+|(?<=[。！？])", story):
        if not REFUSAL.search(sentence[:2000]):  # one that is longer says something else, too
            rest += sum(map(str.isalnum, sentence))
            if rest >= 40:
                return False
    return bool(REFUSAL.search(story))


def chain_of(letters: str) -> bytes:
    """Four bytes for each whole block of CHAIN letters: the chain of a text's beginning begins the text's chain."""
    return b"".join(hashlib.blake2b(letters[k : k + CHAIN].encode(), digest_size=4).digest() for k in range(0, len(letters) - CHAIN + 1, CHAIN))


def long_features(df: DataFrame, keys: list[str], model: langid.Classifier | None) -> DataFrame:
    """keys + features of content, without a shuffle; model (for responses) adds the languages' scores. Null content counts as empty."""
    source = df.select(*keys, F.col("content").alias("__content"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keys)])

    def one(content: bytes | None) -> tuple:
        text = "" if content is None else bytes(content).decode("utf-8", "replace")
        body = _HEAD.sub(" ", text)
        code = bool(_CODE.search(body))
        story = html.unescape(_TAG.sub(" ", _CODE.sub(" ", body))) if code else html.unescape(_TAG.sub(" ", body))
        story = re.sub(r"\s+", " ", story).strip()
        n = len(_MARKS.sub("", story))
        refusal = is_refusal(story)
        empty = n == 0 and not (code and any(c.isalnum() for c in bare(body))) or story.lower() in PLACEHOLDERS
        told = letters_of(bare(body) if code else story)
        digest = hashlib.md5(told.encode()).hexdigest()
        wide = not story.isascii() and len(_WIDE.findall(story)) * 2 > n
        return (empty, refusal, n == 0, digest, chain_of(told) if model is not None else b"", len(_SENTENCE.findall(story)), n, bool(_END.search(story)), -(-len(text) // 4)), story, wide

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [one(c) for c in b["__content"]]
            out = pd.DataFrame([m[0] for m in made], columns=["empty", "refusal", "code", "hash", "chain", "sentences", "letters", "ended", "tokens"], index=b.index)
            out["scores"] = None
            if model is not None and len(made):
                sc, letters = model.scores([m[1] for m in made])
                out["scores"] = [row.astype(np.float32).tolist() if few >= 20 else None for row, few in zip(sc, letters, strict=True)]
            out["wide"] = [m[2] for m in made]
            yield pd.concat([b[keys], out], axis=1)

    return source.mapInPandas(run, f"{kinds}, {LONG}")


SPIKE_LEAST, SPIKE_TIMES = 30, 8


def spikes(answers: DataFrame) -> DataFrame:
    """(tokens): lengths at which at least SPIKE_LEAST responses stop, SPIKE_TIMES as many as at a length nearby on average.

    answers: tokens, and n if a row stands for n responses. One row per length occurs, so the counts are small whatever the
    number of responses; the window moves over lengths and never gathers the responses themselves.
    """
    counts = answers.groupBy("tokens").agg((F.sum("n") if "n" in answers.columns else F.count("*")).alias("n"))
    near = counts.select(F.explode(F.sequence(F.col("tokens") - 5, F.col("tokens") + 5)).alias("at"), "tokens", "n").where("at != tokens")
    around = near.groupBy(F.col("at").alias("tokens")).agg((F.sum("n") / 10).alias("mean"))
    return counts.join(around, "tokens", "left").where(
        (F.col("n") >= SPIKE_LEAST) & (F.col("n") >= SPIKE_TIMES * F.coalesce(F.col("mean"), F.lit(0.0)))
    ).select("tokens")


BROADCAST_ROWS = 200_000
SENTENCES_LEAST, RATIO_LEAST, LETTERS_LEAST = 0.75, 0.6, 0.6


def once(features: DataFrame, keys: list[str]) -> DataFrame:
    """One row of features a key: repeated rows have the same, of rows that differ the least counts."""
    others = [c for c in features.columns if c not in keys]
    return features.groupBy(*keys).agg(F.min(F.struct(*others)).alias("f")).select(*keys, "f.*")


def long_defects(chapters: DataFrame, jobs: DataFrame, checkpoints: DataFrame, model: langid.Classifier) -> DataFrame:
    """(job_id, idx, defect) of defective completed chapter responses.

    Repeated rows count once (by the features of one of them); responses whose job or chapter is unknown are left out;
    a job without target language is judged without the language rule. In order: empty, refusal, copy (code-only
    chapters aside), other_language, truncated.
    """
    jobs = one_job(jobs.where("book_id is not null"), "book_id", langid.label_code(F.col("target_lang")).alias("target"))
    done = checkpoints.where("status = 'completed' and job_id is not null and idx is not null").select("job_id", "idx", "content")
    answers = once(long_features(done, ["job_id", "idx"], model), ["job_id", "idx"]).join(jobs, "job_id")
    at = F.array_position(F.array(*map(F.lit, langid.LANGUAGES)), F.col("target"))
    best = F.array_max("scores")
    lead = F.when(F.col("scores").isNotNull() & (at > 0), best - F.element_at("scores", F.greatest(at, F.lit(1)).cast("int"))).otherwise(0.0)
    lang = F.element_at(F.array(*map(F.lit, langid.LANGUAGES)), F.coalesce(F.array_position("scores", best), F.lit(1)).cast("int"))
    answers = answers.withColumn("lead", lead).withColumn("lang", lang).drop("scores")
    chapters = chapters.where("book_id is not null and idx is not null")
    asked = done.select("job_id", "idx").join(jobs.select("job_id", "book_id"), "job_id").select("book_id", "idx").distinct()
    if asked.count() <= BROADCAST_ROWS:  # beyond, features of chapters that nobody asked for are computed too
        chapters = chapters.join(F.broadcast(asked), ["book_id", "idx"], "left_semi")
    prompts = once(long_features(chapters, ["book_id", "idx"], None), ["book_id", "idx"])
    prompts = prompts.select("book_id", "idx", *[F.col(c).alias(f"p_{c}") for c in ("code", "hash", "sentences", "letters", "ended", "wide")])
    pairs = checkpointed(answers.join(prompts, ["book_id", "idx"]))  # small rows, used below several times
    whole = (F.col("ended")) & (F.col("p_sentences") >= 4) & (F.col("p_letters") > 0) & (F.col("sentences") >= 0.9 * F.col("p_sentences"))
    usual = pairs.where(whole).groupBy("target", "p_wide").agg(F.percentile_approx(F.col("letters") / F.col("p_letters"), 0.5, 1000).alias("usual"))
    limits = spikes(pairs.where("not empty and not refusal")).withColumn("spike", F.lit(True))
    texts = pairs.where("not empty and not refusal and length(chain) > 0").groupBy("target", F.col("chain").alias("text")).agg(F.count("*").alias("n"))
    parts = shortened(texts).select("target", F.col("text").alias("chain"), (F.length("longer") - F.length("text")).alias("further"))
    pairs = pairs.join(F.broadcast(usual), ["target", "p_wide"], "left").join(limits, "tokens", "left").join(parts, ["target", "chain"], "left")
    share = F.col("letters") / F.greatest(F.col("p_letters"), F.lit(1)) / F.coalesce(F.col("usual"), F.lit(1.0))
    few = (F.col("p_sentences") >= 3) & (F.col("sentences") < SENTENCES_LEAST * F.col("p_sentences")) & (share < 0.9)
    short = (F.col("p_letters") >= 200) & (share < LETTERS_LEAST) & (F.col("usual").isNotNull())
    # a response breaks off if it doesn't end as its sentences do, or as the prompt does
    broken = ~F.col("ended") & ((F.col("sentences") >= 1) | (F.col("p_ended") & (F.col("p_sentences") >= 1))) & (share < 0.98)
    at_limit = F.coalesce(F.col("spike"), F.lit(False)) & ~F.col("ended")
    # another answer goes on by a tenth of this one or more, and this one isn't as long as answers usually are
    part = F.coalesce(F.col("further"), F.lit(0)) * 10 >= F.length("chain")
    part = (F.coalesce(F.col("further"), F.lit(0)) > 0) & part & (share < 0.9)
    defect = (
        F.when(F.col("empty") & ~F.col("p_code"), "empty")
        .when(F.col("empty") & (F.col("letters") == 0) & (F.col("hash") != F.col("p_hash")), "empty")
        .when(F.col("refusal"), "refusal")
        .when(F.col("p_code"), None)
        .when(F.col("hash") == F.col("p_hash"), "copy")
        .when((F.col("lang") != F.col("target")) & (F.col("lead") >= 0.4), "other_language")
        .when(part | few | short | broken | at_limit, "truncated")
    )
    return pairs.select("job_id", "idx", defect.alias("defect")).where("defect is not null")
