"""All queries of the core, by name, with their SQL for DuckDB. Every query runs over its whole tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import blocks as B
from foliant.functions import html_tree as H
from foliant.functions import settings as S
from foliant.functions import text as T
from foliant.operators import bookmaking, ocr, progress, refine, resume, toc
from foliant.operators import translate as TR
from foliant.session import checkpointed, discard, reach, shared_folder, table
from foliant.sources import book, srt, stores
from foliant.streaming import progress as streams

from .oracles import SQL

BUDGET = 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in QUERIES}


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null")


def books(spark: SparkSession, folder: str) -> DataFrame:
    return resume.latest(table(spark, folder, "books"), ["book_id"], "loaded_at")


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    return resume.latest(table(spark, folder, "job_options"), ["job_id"], "created_at")


def chapters(spark: SparkSession, folder: str) -> DataFrame:
    return resume.latest(table(spark, folder, "chapters"), ["book_id", "idx"], "loaded_at")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    return resume.latest(table(spark, folder, "checkpoints"), ["job_id", "idx"], "saved_at")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return resume.latest(table(spark, folder, "verified_texts").where("text is not null"), ["book_id", "page_number", "block_ix"], "loaded_at")


def cues(spark: SparkSession, folder: str) -> DataFrame:
    return resume.latest(table(spark, folder, "srt_entries").where("text is not null"), ["book_id", "idx"], "loaded_at")


# ---------------------------------------------------------------- text


@query
def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query
def chunk_pack(spark: SparkSession, folder: str) -> DataFrame:
    return TR.chunks(docs(spark, folder), ["doc_id"], "text", BUDGET)


@query
def chunk_counts(spark: SparkSession, folder: str) -> DataFrame:
    packed = T.pack(T.sentences(F.col("text")), BUDGET)
    return docs(spark, folder).select("doc_id", F.size(packed).cast("bigint").alias("chunks"))


@query
def token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of raw chapters, markup included, per book."""
    n = T.tokens(F.make_valid_utf8(F.col("content").cast("string")))
    # counted where the content is read: repeated rows have the same count, and no content is shuffled
    each = table(spark, folder, "chapters").select("book_id", "idx", n.alias("n")).dropDuplicates(["book_id", "idx"])
    return each.groupBy("book_id").agg(F.sum("n").alias("tokens"), F.count("*").alias("chapters"))


@query
def cache_keys(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).select("doc_id", T.cache_key(F.lit("fake"), F.col("text")).alias("cache_key"))


@query
def job_ids(spark: SparkSession, folder: str) -> DataFrame:
    j = jobs(spark, folder).join(books(spark, folder).select("book_id", "source_path"), "book_id")
    made = T.job_key(F.col("source_path"), F.col("target_lang"), F.col("output_mode"), F.col("provider"), F.lit("default"))
    return j.select("job_id", made.alias("made_id"))


@query
def txt_lines(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))


@query
def paragraphs_from_text(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "paragraph"))


@query
def html_escape(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).select("doc_id", T.escape(F.col("text")).alias("escaped"))


@query
def match_texts(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).select("doc_id", T.match_text(F.col("text")).alias("folded"), T.without_space(F.col("text")).alias("header"))


@query
def first_lines(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).select("doc_id", T.first_line(F.col("text")).alias("first"), T.other_lines(F.col("text")).alias("rest"))


@query
def anomaly_score(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).select("doc_id", F.round(T.anomaly(F.col("text")), 6).alias("anomaly"))


@query
def book_formats(spark: SparkSession, folder: str) -> DataFrame:
    return books(spark, folder).select("book_id", T.book_format(F.col("source_path")).alias("format"), T.stem(F.col("source_path")).alias("stem"))


@query
def output_names(spark: SparkSession, folder: str) -> DataFrame:
    j = jobs(spark, folder).join(books(spark, folder).select("book_id", "source_path"), "book_id")
    name = T.output_name(F.lit("{stem}.{target_lang}.{output_mode}"), F.col("source_path"), F.coalesce("source_lang", F.lit("")), F.col("target_lang"), F.col("output_mode"))
    return j.select("job_id", name.alias("name"), T.output_name(F.lit(" "), F.col("source_path"), F.lit(""), F.col("target_lang"), F.col("output_mode")).alias("plain_name"))


@query
def locales(spark: SparkSession, folder: str) -> DataFrame:
    return jobs(spark, folder).select("job_id", T.locale(F.concat(F.replace("target_lang", F.lit("-"), F.lit("_")), F.lit(".UTF-8"))).alias("locale"))


@query
def durations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", T.duration(F.col("event_id") % 20000).alias("duration"))


@query
def glossary_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The system prompt of each job that has a glossary."""
    entries = F.array_sort(F.collect_list(F.struct("entry_id", "term", "translation")))
    per_job = table(spark, folder, "glossary").where("translation is not null").groupBy("job_id").agg(T.glossary_lines(entries).alias("lines"))
    text = T.fill_prompt(F.lit("Translate from {source_lang} to {target_lang}."), F.coalesce("source_lang", F.lit("auto")), F.col("target_lang"), F.col("lines"))
    return jobs(spark, folder).join(per_job, "job_id").select("job_id", text.alias("prompt"))


@query
def source_budgets(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens that each job's calls leave for the text."""
    limit = lambda c, d: F.when(F.col(c) > 0, F.col(c)).otherwise(d)
    out = T.source_budget(limit("max_input_tokens", 4000), limit("max_output_tokens", 2000), F.lit(120))
    return jobs(spark, folder).select("job_id", out.cast("bigint").alias("budget"))


# ---------------------------------------------------------------- settings

SERVICES = ("fake", "local", "remote_a", "Openai-compatible")
TARGETS = ("de", "en", "es", "fr", "it", "ja", "ru", "zh-CN")


def _settings(spark: SparkSession, folder: str) -> DataFrame:
    """Job options with further settings made of them, some wrong."""
    n = F.length("job_id") + F.ascii("job_id")
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    return jobs(spark, folder).select(
        "job_id", "source_lang", "target_lang", "provider", "max_input_tokens", "max_output_tokens", "temperature", pick("m", "", "m2").alias("model"),
        pick("https://a.example/v1", "ftp://a.example", "no url", None, "http://b").alias("base_url"), pick("k", "", None).alias("api_key"),
        F.split(pick("pre,code", "p q", "a,,b", ".x"), ",").alias("exclude_selectors"), F.split(pick("alt,title", "data_x"), ",").alias("translate_attributes"),
        F.split(pick("p,h1", "P", "td"), ",").alias("translate_tags"), pick("Serif", "a;b", None).alias("output_font"), ((n % 2) == 0).alias("dry_run"),
    )


@query
def setting_problems(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with each job's settings."""
    t = _settings(spark, folder)
    services = tuple(s.lower() for s in SERVICES)
    return t.select("job_id", F.explode(S.checks(t.columns, services, TARGETS)).alias("p")).select("job_id", "p.field", "p.problem")


@query
def connection_problems(spark: SparkSession, folder: str) -> DataFrame:
    t = _settings(spark, folder)
    return t.select("job_id", S.connection_problem(F.col("provider"), F.col("api_key"), F.col("base_url"), ("fake", "local", "remote_a")).alias("problem"))


@query
def read_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Settings written as JSON with fields that nobody knows, and read with their defaults; every seventh is no object."""
    j = jobs(spark, folder)
    json = F.when(F.length("provider") % 7 == 0, F.lit("[1]")).otherwise(F.to_json(F.struct("provider", "max_input_tokens", F.col("job_id").alias("unknown"))))
    made = S.read(json, "provider string, max_input_tokens bigint, concurrency bigint, refine boolean", {"provider": "fake", "max_input_tokens": 4000, "concurrency": 3, "refine": False})
    return j.select("job_id", made.alias("s")).select("job_id", "s.*")


@query
def provider_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """What each job's calls use, of its own settings, those of all jobs, usual ones and the environment."""
    t = _settings(spark, folder)
    rows = t.select(
        "job_id", F.col("provider").alias("name"), "dry_run", F.when(F.col("dry_run"), F.col("base_url")).alias("own_base_url"), F.col("api_key").alias("own_api_key"),
        F.when(F.col("model") == "m", F.lit("unknown")).otherwise(F.col("model")).alias("own_model"), F.when(F.col("model") == "m2", 0).otherwise(700).alias("own_max_tokens"),
        F.col("output_font").isNotNull().alias("own_known"), F.lit("https://usual.example").alias("usual_base_url"), F.lit("usual").alias("usual_model"), F.lit(2000).alias("usual_max_tokens"),
        F.when(F.col("base_url").startswith("http"), F.col("base_url")).alias("all_base_url"), F.when(F.col("model") == "", F.lit("")).alias("all_api_key"), F.lit("all").alias("all_model"), F.lit(900).alias("all_max_tokens"),
    )
    environment = F.create_map(F.lit("REMOTE_A_API_KEY"), F.lit("ra"), F.lit("LOCAL_API_KEY"), F.lit(""))
    out = S.resolve(rows, environment)
    return out.select("job_id", "base_url", "api_key", "model", F.col("max_tokens").cast("bigint").alias("max_tokens"), "error")


@query
def merged_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Limits given with a call (every other job), in the job's options, or by default."""
    t = _settings(spark, folder)
    return t.select("job_id", S.merged(F.when(F.col("dry_run"), 500), F.col("max_input_tokens"), F.lit(4000)).cast("bigint").alias("max_input_tokens"))


@query
def service_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of keys in the environment, and whether models read images."""
    j = jobs(spark, folder)
    model = F.element_at(F.array(*map(F.lit, ("gpt-4o-mini", "claude-3-x", "llava:7b", "deepseek-chat", "GPT-3.5-vision"))), (F.ascii("job_id") % 5 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("openai", "anthropic", "ollama", "deepseek", "other"))), (F.ascii(F.substring("job_id", 2, 1)) % 5 + 1).cast("int"))
    return j.select("job_id", S.key_name(F.replace("provider", F.lit("_"), F.lit("-"))).alias("key_name"), S.reads_images(kind, model).alias("reads_images"))


@query
def interface_locales(spark: SparkSession, folder: str) -> DataFrame:
    """The interface's language for the systems that labels of books name."""
    return books(spark, folder).select("book_id", S.interface_locale(F.col("language")).alias("locale"))


@query
def model_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Glossary terms of each job written as a service's list of models, with ids that are no strings, and read again."""
    g = table(spark, folder, "glossary").where("job_id is not null and term is not null").select("job_id", "entry_id", "term").distinct()
    item = F.when(F.col("entry_id") % 5 == 0, F.concat(F.lit('{"id":'), F.col("entry_id").cast("string"), F.lit("}"))).otherwise(F.to_json(F.struct(F.col("term").alias("id"))))
    lists = g.groupBy("job_id").agg(F.concat(F.lit('{"data":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry_id", item.alias("i")))), lambda x: x["i"]), ","), F.lit("]}")).alias("json"))
    return lists.select("job_id", F.array_join(S.model_ids(F.col("json"), "data", "id"), "|").alias("ids"), F.size(S.model_ids(F.col("json"), "models", "id")).cast("bigint").alias("others"))


@query
def unique_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of a book's jobs' services: name, name 2, name 3."""
    j = jobs(spark, folder)
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("job_id"))
    return toc.unique_ids(j.select("book_id", n.alias("idx"), F.col("provider").alias("base")), " ").withColumnRenamed("id", "name")


@query
def selector_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Lists of selectors with code left out or not, and with a value added once."""
    t = _settings(spark, folder)
    return t.select("job_id", F.array_join(S.left_out(F.col("exclude_selectors"), F.col("dry_run")), "|").alias("left_out"), S.add_once(F.array_join("exclude_selectors", ","), F.lit("code")).alias("added"))


def _glossary_lines(spark: SparkSession, folder: str) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct("entry_id", "term", "translation")))
    return table(spark, folder, "glossary").where("translation is not null").groupBy("job_id").agg(T.glossary_lines(entries).alias("lines"))


@query
def system_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The instruction of each job, by its own, its style and its glossary; and of its refining pass."""
    t = jobs(spark, folder).join(_glossary_lines(spark, folder), "job_id", "left")
    own, source = F.when(F.col("output_mode") == "interleaved", F.lit("Own {target_lang}.")), F.coalesce("source_lang", F.lit("auto"))
    style = F.when(F.col("provider") == "fake", F.lit("literary")).when(F.col("provider") == "local", F.lit("another"))
    return t.select("job_id", S.system_prompt(own, style, source, F.col("target_lang"), F.col("lines"), PROMPTS).alias("prompt"), S.refine_prompt(source, F.col("target_lang"), F.col("lines"), REFINE).alias("refine"))


#: Prompts of the queries.
PROMPTS = {"default": "From {source_lang} to {target_lang}.", "literary": "Prose from {source_lang} to {target_lang}."}
REFINE = "Improve {target_lang}."


@query
def chapter_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts of chapters: some have one of their own."""
    own = F.create_map(F.lit("ch001.xhtml"), F.lit("first"), F.lit("OEBPS/ch002.xhtml"), F.lit("second"))
    return chapters(spark, folder).select("book_id", "idx", S.chapter_prompt(own, F.coalesce("href", F.lit("")), F.lit("general")).alias("prompt"))


# ---------------------------------------------------------------- selection and contents


@query
def skip_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters that are left untranslated by the name of their file."""
    skipped = ~toc.is_running_text(F.col("href"), (*toc.SKIPPED, "ch0[12]"))
    return chapters(spark, folder).select("book_id", "idx", skipped.alias("skipped"))


@query
def translatable_chapters(spark: SparkSession, folder: str) -> DataFrame:
    return toc.translatable(chapters(spark, folder), (*toc.SKIPPED, "ch0[12]"))


@query
def toc_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Chapter titles as entries: even chapters point into a section of the chapter before."""
    c = chapters(spark, folder).where("title is not null")
    href = F.when(F.col("idx") % 2 == 0, F.format_string("part%03d.xhtml", F.floor(F.col("idx") / 3))).otherwise(F.format_string("part%03d.xhtml#s%d", F.floor(F.col("idx") / 3), F.col("idx")))
    return toc.labels(c.select("book_id", F.col("idx").alias("pos"), href.alias("href"), F.col("title").alias("label")))


@query
def clean_hrefs(spark: SparkSession, folder: str) -> DataFrame:
    href = T.clean_href(F.col("href"))
    return chapters(spark, folder).select("book_id", "idx", href.alias("href"), T.manifest_id(href).alias("id"))


@query
def manifest_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids made of titles, numbered where they repeat within a book."""
    c = chapters(spark, folder).where("title is not null").select("book_id", "idx", T.manifest_id(F.col("title")).alias("base"))
    return toc.unique_ids(c)


# ---------------------------------------------------------------- calls and cache


@query
def cache_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Cue texts looked up among those of every third cue."""
    texts = TR.keyed(cues(spark, folder).select("book_id", "idx", F.col("text").alias("chunk")), "fake")
    cache = texts.where("idx % 3 = 0").select("cache_key", F.concat(F.lit("[ZH] "), "chunk").alias("translation"))
    return TR.lookup(texts, cache).select("book_id", "idx", "hit", "translation")


@query
def cache_misses(spark: SparkSession, folder: str) -> DataFrame:
    texts = TR.keyed(table(spark, folder, "srt_entries").where("text is not null").select("idx", F.col("text").alias("chunk")), "fake")
    cache = texts.where("idx % 3 = 0").select("cache_key", F.col("chunk").alias("translation"))
    return TR.misses(texts, cache)


@query
def cache_hit_rate(spark: SparkSession, folder: str) -> DataFrame:
    return cache_lookup(spark, folder).groupBy("book_id").agg(F.count("*").alias("cues"), F.sum(F.col("hit").cast("long")).alias("hits"))


#: Calls of a stand-in need no pauses between tries.
AT_ONCE = {"partitions": 8, "pauses": ()}


def _known(spark: SparkSession, folder: str) -> DataFrame:
    """A cache that holds every third document as a whole."""
    third = docs(spark, folder).where("doc_id % 3 = 0").select(F.col("text").alias("chunk"))
    return TR.keyed(third, "fake").groupBy("cache_key").agg(F.min(F.concat(F.lit("[ZH] "), T.trim(F.col("chunk")))).alias("translation"))


def _answered(spark: SparkSession, folder: str, refined: bool = False) -> DataFrame:
    done, _ = TR.translate(docs(spark, folder), ["doc_id"], "text", _known(spark, folder), TR.Fake, "fake", BUDGET, BUDGET if refined else None, **AT_ONCE)
    return done


@query
def translated(spark: SparkSession, folder: str) -> DataFrame:
    """Documents through cache, chunks, calls of the misses, and back; every third is known as a whole."""
    return _answered(spark, folder).select("doc_id", "translation")


@query
def translated_refined(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a second pass over the answers."""
    return _answered(spark, folder, refined=True).select("doc_id", "translation")


@query
def translate_bilingual(spark: SparkSession, folder: str) -> DataFrame:
    both = _answered(spark, folder).where("translation != ''").select("doc_id", T.trim(F.col("original")).alias("original"), "translation")
    return TR.side_by_side(both, ["doc_id"], "original", "translation", "bilingual")


@query
def new_cache_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What a run over the documents adds to the cache."""
    _, new = TR.translate(docs(spark, folder), ["doc_id"], "text", _known(spark, folder), TR.Fake, "fake", BUDGET, **AT_ONCE)
    return new


@query
def translated_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Chapter titles of each job with checkpoints, but those of chapters that failed."""
    keys = ["job_id", "idx"]
    j = jobs(spark, folder).join(stored(spark, folder).select("job_id").distinct(), "job_id", "left_semi").select("job_id", "book_id")
    every = chapters(spark, folder).select("book_id", "idx", "href", "title").join(j, "book_id")
    wanted = TR.titles(every, stored(spark, folder).where("status = 'failed'"), keys)
    none = spark.createDataFrame([], "cache_key string, translation string")
    done, _ = TR.translate(wanted, [*keys, "prompt_key"], "title", none, TR.Fake, "fake", 4000, **AT_ONCE)
    return done.select(*keys, "prompt_key", "translation")


def _sides(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        sentences = sentence_split(spark, folder).withColumn("answer", F.concat(F.lit("[ZH] "), "sentence"))
        return TR.side_by_side(sentences, ["doc_id", "pos"], "sentence", "answer", mode)

    return run


for _mode in ("bilingual", "interleaved", "translation_only"):
    QUERIES[f"sentences_{_mode}"] = _sides(_mode)


@query
def refine_pass(spark: SparkSession, folder: str) -> DataFrame:
    """A second pass over the answers, under its own keys."""
    first = sentence_split(spark, folder).select(F.concat(F.lit("[ZH] "), "sentence").alias("chunk")).distinct()
    again = TR.keyed(first, "fake-refine")
    return again.select("cache_key", F.concat(F.lit("[ZH] "), "chunk").alias("translation"))


# ---------------------------------------------------------------- checkpoints


def _wanted(spark: SparkSession, folder: str) -> DataFrame:
    """Every chapter of every job that has a checkpoint."""
    have = stored(spark, folder).select("job_id").distinct()
    j = jobs(spark, folder).join(have, "job_id", "left_semi").select("job_id", "book_id")
    return chapters(spark, folder).select("book_id", "idx", "href", "content").join(j, "book_id")


@query
def checkpoint_summary(spark: SparkSession, folder: str) -> DataFrame:
    return resume.summary(stored(spark, folder))


@query
def checkpoint_pending(spark: SparkSession, folder: str) -> DataFrame:
    return resume.pending(_wanted(spark, folder).select("job_id", "idx"), stored(spark, folder))


@query
def checkpoint_backfill(spark: SparkSession, folder: str) -> DataFrame:
    return resume.backfill(_wanted(spark, folder).select("job_id", "idx"), stored(spark, folder))


@query
def checkpoint_restore(spark: SparkSession, folder: str) -> DataFrame:
    restored = resume.restore(_wanted(spark, folder).select("job_id", "idx", "content"), stored(spark, folder))
    return restored.select("job_id", "idx", "restored", F.octet_length("content").cast("bigint").alias("bytes"))


@query
def checkpoint_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Checkpoints whose source is still the book's."""
    sources = jobs(spark, folder).join(books(spark, folder).select("book_id", F.col("source_hash").alias("current_hash")), "book_id").select("job_id", "current_hash")
    return resume.valid(stored(spark, folder).select("job_id", "idx", "source_hash"), sources).select("job_id", "idx")


@query
def checkpoint_match(spark: SparkSession, folder: str) -> DataFrame:
    """Every checkpoint with whether its source is still the book's."""
    sources = jobs(spark, folder).join(books(spark, folder).select("book_id", F.col("source_hash").alias("current_hash")), "book_id").select("job_id", "current_hash")
    return resume.flagged(stored(spark, folder).select("job_id", "idx", "source_hash"), sources).select("job_id", "idx", "matches_current_source")


@query
def checkpoint_files(spark: SparkSession, folder: str) -> DataFrame:
    """Checkpoints saved as files twice, the second time without what failed, and read again: the second save counts."""
    path = f"{shared_folder(spark)}/saves/{uuid.uuid4().hex}"
    s = stored(spark, folder).where("job_id is not null")
    stores.write_checkpoints(s, path, datetime(2025, 1, 1))
    stores.write_checkpoints(s.where("status != 'failed'"), path, datetime(2025, 1, 2))
    read = checkpointed(stores.read_checkpoints(spark, path).select("job_id", "idx", "status", F.md5("content").alias("digest")))
    discard(spark, path)
    return read


@query
def chapter_failures(spark: SparkSession, folder: str) -> DataFrame:
    return resume.failures(stored(spark, folder).select("job_id", "idx", "href", "status"))


# ---------------------------------------------------------------- documents


@query
def html_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return H.nodes(chapters(spark, folder), ["book_id", "idx"])


@query
def html_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of chapters that are to be translated."""
    return H.texts(chapters(spark, folder), ["book_id", "idx"])


@query
def html_headings(spark: SparkSession, folder: str) -> DataFrame:
    """How many headings of the first level each chapter has."""
    return html_nodes(spark, folder).where("tag = 'h1'").groupBy("book_id", "idx").agg(F.count("*").alias("headings"))


@query
def html_node_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Elements of some kinds that each chapter has."""
    n = html_nodes(spark, folder)
    count = lambda t: F.sum(F.when(F.col("tag") == t, 1).otherwise(0)).cast("bigint").alias(t)
    return n.groupBy("book_id", "idx").agg(*[count(t) for t in ("h1", "h2", "p", "li", "td", "em", "pre")])


@query
def html_chunk_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the selected texts of each chapter."""
    n = F.size(T.pack(T.sentences(F.col("text")), BUDGET))
    return html_texts(spark, folder).groupBy("book_id", "idx").agg(F.sum(n).alias("chunks"), F.count("*").alias("texts"))


def _epub_files(spark: SparkSession, folder: str) -> DataFrame:
    """Books with chapters as EPUB files, each with a style sheet."""
    extra = books(spark, folder).select("book_id", F.lit("css/style.css").alias("href"), F.lit("text/css").alias("mime"), F.encode(F.coalesce("title", F.lit("")), "UTF-8").alias("data"))
    made = book.epubs(chapters(spark, folder), books(spark, folder), extra)
    return made.select(F.concat("book_id", F.lit(".epub")).alias("path"), F.col("data").alias("content"))


@query
def epub_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters written as EPUB files and read again."""
    c = book.read_chapters(_epub_files(spark, folder))
    return c.select("book_id", F.col("idx").cast("bigint").alias("idx"), "href", "title", F.md5("content").alias("digest"), "book_title", "language", "error")


@query
def epub_resources(spark: SparkSession, folder: str) -> DataFrame:
    """What else the files hold: all of the manifest but the spine."""
    r = book.read_resources(_epub_files(spark, folder))
    return r.select("book_id", "href", "mime", F.decode("data", "UTF-8").alias("text"))


@query
def subtitle_books(spark: SparkSession, folder: str) -> DataFrame:
    """Cues written as subtitle files and read as books: how many cues each holds."""
    f = srt.files(cues(spark, folder).where("start_time is not null and end_time is not null"))
    made = book.read_chapters(f.select(F.concat("book_id", F.lit(".srt")).alias("path"), F.encode("text", "UTF-8").alias("content")))
    n = F.size(F.split(F.decode("content", "UTF-8"), '<div class="srt-entry"')) - 1
    return made.groupBy("book_id", "href").agg(F.sum(n).cast("bigint").alias("cues"))  # a long book has several files


@query
def text_books(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as text files, read as books: each line a paragraph."""
    d = docs(spark, folder).where(~F.col("text").rlike("[\\r\\x{feff}]"))
    made = book.read_chapters(d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content")))
    n = F.size(F.split(F.decode("content", "UTF-8"), "<p>")) - 1
    return made.select("book_id", "title", n.cast("bigint").alias("paragraphs"))


# ---------------------------------------------------------------- scanned pages


@query
def page_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).where(B.is_page_number(F.col("text"))).select("book_id", "page_number", "block_ix", "text")


@query
def prompt_leakage(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and blocks with leaked instructions."""
    b = pages(spark, folder).select(F.concat_ws("#", "book_id", F.col("page_number").cast("string"), F.col("block_ix").cast("string")).alias("id"), "text")
    d = docs(spark, folder).select(F.col("doc_id").cast("string").alias("id"), "text")
    return b.unionByName(d).select("id", B.is_leaked(F.col("text")).alias("leaked"))


@query
def repeated_headers(spark: SparkSession, folder: str) -> DataFrame:
    return ocr.repeated_headers(table(spark, folder, "verified_texts").where("text is not null"))  # repeated rows count once anyway


@query
def cleaned_blocks(spark: SparkSession, folder: str) -> DataFrame:
    p = pages(spark, folder)
    all_rows = table(spark, folder, "verified_texts").where("text is not null")
    return ocr.clean(p, ocr.repeated_headers(all_rows, "greatest(2, floor(pages / 5))")).select("book_id", "page_number", "block_ix", "text")


@query
def diagram_groups(spark: SparkSession, folder: str) -> DataFrame:
    return ocr.group_labels(pages(spark, folder))


@query
def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return ocr.full_text(pages(spark, folder))


@query
def block_types(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select("book_id", "page_number", "block_ix", B.plain_type(F.col("text")).alias("plain_type"), B.is_top_heading(F.col("text")).alias("top"))


@query
def chapter_split(spark: SparkSession, folder: str) -> DataFrame:
    return ocr.chapter_of(pages(spark, folder)).select("book_id", "page_number", "block_ix", F.col("chapter").cast("bigint").alias("chapter"))


@query
def caption_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of type other with what follows, where that looks like a caption; subheadings stand in for captions."""
    p = pages(spark, folder).withColumn("block_type", F.when(F.col("block_type") == "subheading", "caption").otherwise(F.col("block_type")))
    return ocr.captions(p, "other")


@query
def table_runs(spark: SparkSession, folder: str) -> DataFrame:
    return ocr.table_runs(pages(spark, folder)).select("book_id", "page_number", "table_ix", F.size("cells").cast("bigint").alias("cells"))


@query
def table_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = ocr.table_rows(F.col("cells"))
    t = ocr.table_runs(pages(spark, folder)).select("book_id", "page_number", "table_ix", F.posexplode(rows).alias("row", "cells"))
    return t.select("book_id", "page_number", "table_ix", "row", F.array_join(F.transform("cells", lambda c: c["text"]), " | ").alias("cells"))


@query
def grid_columns(spark: SparkSession, folder: str) -> DataFrame:
    return ocr.grid_columns(ocr.table_runs(pages(spark, folder)))


@query
def box_unions(spark: SparkSession, folder: str) -> DataFrame:
    b = ocr.box_union(pages(spark, folder))
    return b.select("book_id", "page_number", *[F.col(f"bbox.{c}").cast("bigint").alias(c) for c in "xywh"])


@query
def verify_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return ocr.verify_candidates(pages(spark, folder)).select("book_id", "page_number", "block_ix", F.round("anomaly", 6).alias("anomaly"))


@query
def verify_best(spark: SparkSession, folder: str) -> DataFrame:
    """The best of each page's blocks, taken as attempts in order."""
    a = F.struct("block_ix", "text", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), F.round(T.anomaly(F.col("text")), 6).alias("anomaly"))
    attempts = F.transform(F.array_sort(F.collect_list(a)), lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"), x["anomaly"].alias("anomaly")))
    grouped = pages(spark, folder).groupBy("book_id", "page_number").agg(attempts.alias("attempts"))
    best = ocr.best_attempt(F.col("attempts"), F.lit(0.5))
    return grouped.select("book_id", "page_number", best.alias("b")).select("book_id", "page_number", "b.text", F.round("b.confidence", 6).alias("confidence"))


@query
def markdown_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables of blocks, given in Markdown's one-line form with a rule, as markup."""
    cell = lambda c: F.replace(F.replace(c["text"], F.lit("|"), F.lit("/")), F.lit("\n"), F.lit(" "))
    row = F.concat(F.lit("| "), F.array_join(F.transform("cells", cell), " | "), F.lit(" |"))
    t = ocr.table_runs(pages(spark, folder)).select("book_id", "page_number", "table_ix", F.concat(row, F.lit(" |---| "), F.regexp_replace(row, r"^\| ", "|")).alias("text"))
    return t.select("book_id", "page_number", "table_ix", bookmaking.markdown_html(F.col("text")).alias("html"))


@query
def block_html(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select("book_id", "page_number", "block_ix", bookmaking.block_html(F.col("text"), F.col("block_type")).alias("html"))


@query
def table_html(spark: SparkSession, folder: str) -> DataFrame:
    return ocr.table_runs(pages(spark, folder)).select("book_id", "page_number", "table_ix", bookmaking.table_html(F.col("cells")).alias("html"))


@query
def image_html(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks large enough to be cut out, as figures of their files."""
    named = bookmaking.figures(pages(spark, folder))
    return named.select("book_id", "page_number", "block_ix", bookmaking.image_html(F.col("href"), F.lit(None).cast("string")).alias("html"))


@query
def figure_names(spark: SparkSession, folder: str) -> DataFrame:
    return bookmaking.figures(pages(spark, folder)).select("book_id", "page_number", "block_ix", "href")


@query
def figure_resources(spark: SparkSession, folder: str) -> DataFrame:
    """Resources of a book, cut figures among them: names and types."""
    cut = bookmaking.figures(pages(spark, folder)).select("book_id", "href", F.lit("image/png").alias("mime"))
    return cut.unionByName(books(spark, folder).select("book_id", F.lit("style.css").alias("href"), F.lit("text/css").alias("mime")))


@query
def page_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters made of recognised pages: their names, titles and how much markup they hold."""
    made = bookmaking.chapters(pages(spark, folder))
    count = lambda t: F.size(F.split("content", f"<{t}[> ]")) - 1
    return made.select("book_id", "idx", "href", "title", *[count(t).cast("bigint").alias(t) for t in ("h1", "h2", "table", "td")])


@query
def json_types(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select("book_id", "page_number", "block_ix", B.json_type(F.col("text"), F.col("bbox").isNotNull()).alias("kind"))


@query
def crop_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes grown by half on pages of 1000 by 1400."""
    p = pages(spark, folder).where("bbox is not null").withColumn("page_width", F.lit(1000)).withColumn("page_height", F.lit(1400))
    return refine.crops(p, 1.5).select("book_id", "page_number", "block_ix", *[F.col(f"crop.{c}").cast("bigint").alias(c) for c in "xywh"])


@query
def box_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes written as JSON, every other one as a list, read again."""
    p = pages(spark, folder).where("bbox is not null")
    listed = F.concat(F.lit("["), F.concat_ws(",", *[F.col(f"bbox.{c}").cast("string") for c in "xywh"]), F.lit("]"))
    json = F.when(F.col("block_ix") % 2 == 0, F.to_json("bbox")).otherwise(listed)
    return p.select("book_id", "page_number", "block_ix", B.box(json).alias("b")).select("book_id", "page_number", "block_ix", "b.x", "b.y", "b.w", "b.h")


# ---------------------------------------------------------------- progress, log, cues


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as progress of their users' tasks."""
    return _as_progress(table(spark, folder, "events"))


def _as_progress(events: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Started", "ChapterStarted", "ChunkFinished", "ChapterFinished", "ChunkFinished", "ChapterFinished", "ChunkStarted", "ChapterFinished")]), (F.col("event_id") % 8 + 1).cast("int"))
    return events.select(
        F.col("user_id").cast("string").alias("task_id"), F.col("event_id").alias("seq"), kind.alias("event"),
        F.when(kind == "Started", F.col("event_id") % 13 + 3).alias("total"), (F.col("event_id") % 4).alias("chunk_index"), F.lit(5).cast("bigint").alias("chunk_total"),
    )


@query
def progress_fold(spark: SparkSession, folder: str) -> DataFrame:
    return progress.fold(_events(spark, folder))


@query
def last_states(spark: SparkSession, folder: str) -> DataFrame:
    """The last percent and message of each task, of events with both."""
    e = table(spark, folder, "events")
    return progress.last_state(e.select(F.col("user_id").cast("string").alias("task_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 101).cast("int").alias("percent"), F.col("event_type").alias("message")))


@query
def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as the JSON of progress, some in a wrong shape, read again; those that can't be read have none."""
    e = table(spark, folder, "events")
    i = F.col("event_id")
    href = F.concat(F.lit("ch"), (i % 9).cast("string"), F.lit(".xhtml"))
    forms = [
        F.lit('"Completed"'), F.to_json(F.struct(F.struct((i % 13).alias("total")).alias("Started"))),
        F.to_json(F.struct(F.struct((i % 13).alias("index"), href.alias("href")).alias("ChapterStarted"))),
        F.to_json(F.struct(F.struct((i % 13).alias("index"), href.alias("href"), (i % 4).alias("chunk_index"), F.lit(5).alias("chunk_total")).alias("ChunkFinished"))),
        F.to_json(F.struct(F.struct((i % 13).alias("index"), href.alias("href"), F.col("event_type").alias("error")).alias("Failed"))),
        F.to_json(F.struct(F.struct(href.alias("total")).alias("Started"))), F.lit('{"Other": {}}'), F.lit("{broken"),
    ]
    raw = F.element_at(F.array(*forms), (i % 8 + 1).cast("int"))
    return e.select("event_id", progress.payload(raw).alias("p")).select("event_id", "p.*")


@query
def log_entries(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder).withColumn("href", F.lit("c.xhtml")).withColumn("error", F.lit(None).cast("string"))
    return progress.log_entries(e).select("task_id", "seq", "level", "message")


@query
def chunk_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """The number of each paragraph's first sentence in its document."""
    p = paragraphs_from_text(spark, folder).select("doc_id", "pos", F.size(T.sentences(F.col("paragraph"))).alias("chunks"))
    return progress.chunk_numbers(p, ["doc_id"], "pos")


@query
def elapsed(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds from a job's making to its first save."""
    first = table(spark, folder, "checkpoints").groupBy("job_id").agg(F.min("saved_at").alias("saved"))
    j = jobs(spark, folder).join(first, "job_id")
    return j.select("job_id", T.elapsed(F.unix_timestamp("created_at"), F.unix_timestamp("saved")).cast("bigint").alias("seconds"))


@query
def stage_remap(spark: SparkSession, folder: str) -> DataFrame:
    p = progress_fold(spark, folder)
    return p.select("task_id", progress.remap(F.col("progress"), 0, 0.5).alias("first_stage"), progress.remap(F.col("progress"), 50, 0.5).alias("second_stage"))


@query
def log_search(spark: SparkSession, folder: str) -> DataFrame:
    """Events of one level whose line holds a phrase, whatever its case."""
    e = table(spark, folder, "events")
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "event_type", "props")
    return e.where((F.col("event_type") == F.lit("click")) & F.contains(F.lower(line), F.lit("1"))).select("event_id", line.alias("line"))


@query
def srt_html(spark: SparkSession, folder: str) -> DataFrame:
    c = cues(spark, folder).where("start_time is not null and end_time is not null")
    return c.select("book_id", "idx", srt.cue_html(F.col("start_time"), F.col("end_time"), F.col("text")).alias("html"))


@query
def srt_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Cues written as files and parsed again; what isn't a whole cue is lost on the way."""
    c = cues(spark, folder).where("start_time is not null and end_time is not null")
    return srt.files(c).select("book_id", F.explode(srt.cues(F.col("text"))).alias("c")).select("book_id", "c.*")


# ---------------------------------------------------------------- second passes


@query
def refined_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose neighbouring paragraphs a second pass joined by twos, matched to the blocks they were."""
    p = pages(spark, folder).where("text != ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ix", "text"))), lambda s: s["text"]), " ")
    refined = p.groupBy("book_id", "page_number", F.floor(F.col("block_ix") / 2).cast("int").alias("block_ix")).agg(joined.alias("text"))
    return refine.carry_over(refined, p)


def _squeezer() -> Callable[[list[tuple[str, str]], int], list[tuple[str, str]]]:
    return lambda blocks, _: [(re.sub("[ \t\r\n]+", " ", t).strip(" "), k) for t, k in blocks]


@query
def refined_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages refined until nothing changes, by a stand-in that squeezes white space."""
    return refine.to_fixpoint(pages(spark, folder), _squeezer)


@query
def plain_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Documents taken as answers in plain text: the types of their lines."""
    lines = docs(spark, folder).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    return lines.select("doc_id", "pos", B.plain_type(F.col("line")).alias("kind"))


@query
def bilingual_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters as bilingual documents: selected texts with a stand-in's answers put in."""
    return H.bilingual_documents(chapters(spark, folder), ["book_id", "idx"], lambda t: f"[ZH] {t}", "bilingual", "auto", "zh-CN")


# ---------------------------------------------------------------- streams


def _drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """What a stream gives when it has read all there is: its batches, written to the shared folder."""
    folder = f"{shared_folder(stream.sparkSession)}/streams/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is run again takes its own place
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    read = checkpointed(stream.sparkSession.read.parquet(f"{folder}/out").drop("batch"))
    discard(stream.sparkSession, folder)
    return read


@query
def stream_progress(spark: SparkSession, folder: str) -> DataFrame:
    """The fold of the events as a stream; its last states are those of the batch."""
    reach(spark)
    raw = spark.readStream.schema(table(spark, folder, "events").schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/event*.parquet")
    last = _drained(streams.fold(_as_progress(raw)), "progress", "update")
    states = last.groupBy("task_id").agg(F.max_by(F.struct("total", "completed", "progress"), "seq").alias("s"))
    return states.select("task_id", "s.*")


@query
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Event kinds of each user that a stream sees for the first time."""
    raw = spark.readStream.schema(table(spark, folder, "events").schema).parquet(f"{folder}/event*.parquet")
    keyed = raw.select(F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("cache_key"))
    return _drained(streams.first_seen(keyed, delay="3650 days"), "dedup", "append").select("cache_key")
