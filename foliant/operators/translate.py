"""Chunks, the memo of calls, and their answers back in order.

A call is made once for each distinct chunk that the cache doesn't hold: misses are an anti join and a distinct. The
calls' results are written (or checkpointed) before anything reads them, so that no retry calls twice; with a stored cache
they are written in waves, so that a run that dies has to repeat one wave at most.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.session import checkpointed
from foliant.sources.stores import CacheTable


class Translator(Protocol):
    name: str

    def translate(self, text: str) -> str: ...


class Fake:
    """Puts [ZH] before a text; the tests' stand-in for a service."""

    name = "fake"

    def translate(self, text: str) -> str:
        return f"[ZH] {text}"


def chunks(df: DataFrame, keys: list[str], text: str, budget: int) -> DataFrame:
    """keys + (chunk_ix, chunk): sentences packed up to `budget` tokens. Null, empty and blank texts give no rows."""
    packed = T.pack(T.sentences(F.col(text)), budget)
    return df.where(F.col(text).isNotNull()).select(*keys, F.posexplode(packed).alias("chunk_ix", "chunk"))


def keyed(chunked: DataFrame, provider: str) -> DataFrame:
    return chunked.withColumn("cache_key", T.cache_key(F.lit(provider), F.col("chunk")))


def lookup(chunked: DataFrame, cache: DataFrame) -> DataFrame:
    """chunked (with cache_key) + (translation, hit): a left join; repeated cache rows count once, the least text of a key."""
    one = cache.where("cache_key is not null").groupBy("cache_key").agg(F.min("translation").alias("translation"))
    return chunked.join(one, "cache_key", "left").withColumn("hit", F.col("translation").isNotNull())


def misses(chunked: DataFrame, cache: DataFrame) -> DataFrame:
    """(cache_key, chunk): each distinct chunk that the cache lacks, once."""
    known = cache.where("translation is not null").select("cache_key")
    # duplicates are dropped before the join, map-side first: a chunk that a third of the rows hold moves once a task;
    # the key follows from the chunk, so both are grouped by, which hashes where an aggregate of strings would sort
    return chunked.select("cache_key", "chunk").distinct().join(known, "cache_key", "left_anti")


PAUSES = (1.0, 2.0, 4.0)  # seconds before each further try
TIME_LIMIT = 300.0


def call(missing: DataFrame, make: Callable[[], Translator], partitions: int = 32, threads: int = 1, pauses: tuple[float, ...] = PAUSES, limit: float = TIME_LIMIT) -> DataFrame:
    """(cache_key, translation, error): calls of a translator, made once per partition; `threads` at once in each task.

    Every failure, an empty answer and one that takes longer than `limit` seconds is tried again after each of `pauses`.
    The cluster's tasks times `threads` is what a service gets at once; a lost task repeats the calls of its partition.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        translator = make()
        with ThreadPoolExecutor(threads) as pool, ThreadPoolExecutor(threads * (len(pauses) + 1)) as calls:

            def one(text: str) -> tuple[str | None, str | None]:
                error = None
                for pause in (0.0, *pauses):
                    time.sleep(pause)
                    try:
                        value = calls.submit(translator.translate, text).result(timeout=limit)
                        if value:
                            return value, None
                        error = "empty answer"
                    except TimeoutError:
                        error = "no answer in time"
                    except Exception as e:
                        error = str(e)
                return None, error

            for b in batches:
                made = list(pool.map(one, b["chunk"]))
                yield pd.DataFrame({"cache_key": b["cache_key"], "translation": [v for v, _ in made], "error": [e for _, e in made]})

    return missing.repartition(partitions, "cache_key").mapInPandas(run, "cache_key string, translation string, error string")


def fill(cache: CacheTable, missing: DataFrame, make: Callable[[], Translator], waves: int = 4, **how) -> None:
    """Calls what the cache lacks and appends the answers, a wave at a time; keys that an earlier run answered aren't called."""
    missing = checkpointed(missing)
    for k in range(waves):
        part = missing.where(F.pmod(F.xxhash64("cache_key"), F.lit(waves)) == k)
        cache.put(call(part.join(cache.read().select("cache_key"), "cache_key", "left_anti"), make, **how))


def answer(rows: DataFrame, keys: list[str], text: str, cache: DataFrame, make: Callable[[], Translator], name: str, budget: int, whole: bool = True, **how) -> tuple[DataFrame, DataFrame]:
    """(keys + (original, translation, failed), new cache rows): one pass over texts.

    A text that the cache holds as a whole (`whole`) is answered by that; the others by their chunks, of which only those
    that the cache lacks are called. Chunks are made once; a text travels with its first chunk. Texts without a chunk have
    an empty answer, null texts none; repeated keys must have been dropped.
    """
    texts = rows.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("original"))
    known = texts.withColumn("chunk", F.lit(None).cast("string")).withColumn("translation", F.lit(None).cast("string")).where("false")
    if whole:
        texts = lookup(keyed(texts.withColumn("chunk", F.col("original")), name), cache)
        known = texts.where("hit")
        texts = texts.where("not hit")
    packed = T.pack(T.sentences(F.col("original")), budget)
    made = texts.select(*keys, "original", F.posexplode_outer(packed).alias("chunk_ix", "chunk"))
    made = made.withColumn("original", F.when(F.coalesce("chunk_ix", F.lit(0)) == 0, F.col("original")))
    made = checkpointed(keyed(made, name))  # read by the misses and by the lookup
    new = checkpointed(call(misses(made.where("chunk is not null"), cache), make, **how))  # before anything reads them
    full = upsert(cache, new)
    ordered = F.array_sort(F.collect_list(F.when(F.col("chunk_ix").isNotNull(), F.struct("chunk_ix", "translation"))))
    joined = T.trim(F.replace(F.array_join(F.transform(ordered, lambda c: c["translation"]), " "), F.lit("\n"), F.lit(" ")))
    failed = F.max(F.col("chunk_ix").isNotNull() & F.col("translation").isNull())
    done = lookup(made, full).groupBy(*keys).agg(F.max("original").alias("original"), failed.alias("failed"), joined.alias("translation"))
    done = done.select(*keys, "original", F.when(~F.col("failed"), F.col("translation")).alias("translation"), "failed")
    return done.unionByName(known.select(*keys, "original", "translation", F.lit(False).alias("failed"))), new.where("translation is not null").select("cache_key", "translation")


def translate(rows: DataFrame, keys: list[str], text: str, cache: DataFrame, make: Callable[[], Translator], name: str, budget: int, refine_budget: int | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(keys + (original, translation, failed), new cache rows): a pass, and with `refine_budget` a second one over its
    answers, whose keys are apart (name-refine) and which always goes by chunks."""
    first, new = answer(rows, keys, text, cache, make, name, budget, **how)
    if refine_budget is None:
        return first, new
    first = checkpointed(first)
    again, more = answer(first.where("not failed"), keys, "translation", cache, make, f"{name}-refine", refine_budget, whole=False, **how)
    second = first.select(*keys, F.col("original").alias("source"), F.col("failed").alias("broken")).join(again.drop("original"), keys, "left")
    return second.select(*keys, F.col("source").alias("original"), "translation", F.coalesce("failed", "broken").alias("failed")), new.unionByName(more)


def titles(chapters: DataFrame, failed: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (title, prompt_key): titles to be translated, but for chapters (keys) that failed; prompts go by toc:href."""
    have = chapters.where("title is not null").select(*keys, "title", F.concat(F.lit("toc:"), "href").alias("prompt_key"))
    return have.join(failed.select(*keys).distinct(), keys, "left_anti")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new rows in place of those of the same key; rows without a translation are left out."""
    new = new.where("translation is not null").groupBy("cache_key").agg(F.min("translation").alias("translation"))
    return cache.select("cache_key", "translation").join(new, "cache_key", "left_anti").unionByName(new)


def reassemble(answered: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (translation, failed): answers in order, joined by spaces, line ends as spaces; null if one is missing.

    answered: keys, chunk_ix, translation.
    """
    ordered = F.array_sort(F.collect_list(F.struct("chunk_ix", "translation")))
    texts = F.transform(ordered, lambda c: c["translation"])
    joined = T.trim(F.replace(F.array_join(texts, " "), F.lit("\n"), F.lit(" ")))
    return answered.groupBy(*keys).agg(
        F.max(F.col("translation").isNull()).alias("failed"), joined.alias("translation")
    ).withColumn("translation", F.when(~F.col("failed"), F.col("translation")))


def side_by_side(df: DataFrame, keys: list[str], original: str, answer: str, mode: str) -> DataFrame:
    """keys + (part, side, text): the rows of a bilingual, interleaved or translation_only document; missing answers leave the original."""
    o = F.struct(F.lit("original").alias("side"), F.col(original).alias("text"))
    t = F.struct(F.lit("translation").alias("side"), F.col(answer).alias("text"))
    both = {"bilingual": F.array(t, o), "interleaved": F.array(o, t), "translation_only": F.array(t)}[mode]
    return df.select(*keys, F.posexplode(F.when(F.col(answer).isNull(), F.array(o)).otherwise(both)).alias("part", "p")).select(*keys, "part", "p.*")
