"""The pN_ queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import table

from . import garble, langid, leaks, pairs, scan, split, tokens, toxic


def p1_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its languages and segments."""
    model, temperature = _language_model(spark, folder)
    return langid.label_documents(table(spark, folder, "documents"), model, temperature)


def p1_books(spark: SparkSession, folder: str) -> DataFrame:
    """Every book that has text, with its languages."""
    model, temperature = _language_model(spark, folder)
    return langid.label_books(_book_parts(spark, folder, model), temperature)


def p1_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every chapter, cue and scanned block with its languages and segments: (kind, book_id, page_number, idx, lang, confidence, languages, segments)."""
    model, temperature = _language_model(spark, folder)
    none = F.lit(None).cast("int")
    parts = [
        (table(spark, folder, "chapters").select(F.lit("chapter").alias("kind"), "book_id", none.alias("page_number"), "idx", F.col("content").alias("t")), True),
        (table(spark, folder, "srt_entries").select(F.lit("cue").alias("kind"), "book_id", none.alias("page_number"), "idx", F.col("text").alias("t")), False),
        (table(spark, folder, "verified_texts").select(F.lit("block").alias("kind"), "book_id", "page_number", F.col("block_ix").alias("idx"), F.col("text").alias("t")), False),
    ]
    keys = ["kind", "book_id", "page_number", "idx"]
    made = [langid.label_texts(df, keys, "t", model, temperature, markup) for df, markup in parts]
    return made[0].unionByName(made[1]).unionByName(made[2])


def _language_model(spark: SparkSession, folder: str) -> tuple[langid.Classifier, float]:
    return langid.train(table(spark, folder, "lang_samples"), table(spark, folder, "documents"))


def _book_parts(spark: SparkSession, folder: str, model: langid.Classifier) -> DataFrame:
    return (
        langid.score_parts(table(spark, folder, "chapters"), model, True, "idx")
        .unionByName(langid.score_parts(table(spark, folder, "srt_entries"), model, False))
        .unionByName(langid.score_parts(table(spark, folder, "verified_texts"), model, False))
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose label is missing or wrong, and the languages of mixed ones."""
    model, temperature = _language_model(spark, folder)
    books = langid.label_books(_book_parts(spark, folder, model), temperature)
    labels = table(spark, folder, "books").select("book_id", F.lit("book").alias("kind"), F.col("book_id").alias("record_id"), F.col("language").alias("label"))
    options = table(spark, folder, "job_options").select("book_id", F.lit("options").alias("kind"), F.col("job_id").alias("record_id"), F.col("source_lang").alias("label"))
    judged = labels.unionByName(options).join(books, "book_id").select("kind", "record_id", "label", "languages")
    documents = langid.label_documents(table(spark, folder, "documents"), model, temperature).select(
        F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("record_id"), "label", F.col("languages.lang").alias("languages")
    )
    code = langid.label_code(F.col("label"))
    mixed = F.size("languages") > 1
    named = F.coalesce(F.array_contains("languages", code), F.lit(False))
    case = F.when(mixed & (F.col("kind") != "options"), True).otherwise(~named)
    return (
        judged.unionByName(documents).where("record_id is not null").where(case)
        .select("kind", "record_id", F.explode("languages").alias("lang")).distinct()
    )


def p2_glossary(spark: SparkSession, folder: str) -> DataFrame:
    """Defective glossary entries."""
    model, _ = _language_model(spark, folder)
    return pairs.short_defects(pairs.short_features(table(spark, folder, "glossary"), table(spark, folder, "job_options"), model))


def p2_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Defective answers to chapters."""
    model, _ = _language_model(spark, folder)
    return pairs.long_defects(*(table(spark, folder, t) for t in ("chapters", "job_options", "checkpoints")), model)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    model, _ = _language_model(spark, folder)
    jobs = table(spark, folder, "job_options")
    short = pairs.short_defects(pairs.short_features(table(spark, folder, "glossary"), jobs, model))
    long = pairs.long_defects(table(spark, folder, "chapters"), jobs, table(spark, folder, "checkpoints"), model)
    return (
        short.select(F.lit("glossary").alias("kind"), F.col("entry_id").cast("string").alias("record_id"), "defect")
        .unionByName(long.select(F.lit("chapter").alias("kind"), F.concat_ws("#", "job_id", F.col("idx").cast("string")).alias("record_id"), "defect"))
        .distinct()
    )


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_chapters(table(spark, folder, "chapters"), table(spark, folder, "job_options"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return split.oversized(p3_pieces(spark, folder))


def _garbled(spark: SparkSession, folder: str, name: str) -> DataFrame:
    models, margin = garble.train(table(spark, folder, "lang_samples"), table(spark, folder, "documents"))
    text = "content" if name == "chapters" else "text"
    return garble.find_garbled(table(spark, folder, name), ["book_id", "idx"], text, models, margin)


def p4_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters with wrongly decoded characters, and their text as far as it can be restored."""
    return _garbled(spark, folder, "chapters").where("garbled")


def p4_cues(spark: SparkSession, folder: str) -> DataFrame:
    return _garbled(spark, folder, "srt_entries").where("garbled")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    models, margin = garble.train(table(spark, folder, "lang_samples"), table(spark, folder, "documents"))
    parts = [
        garble.find_garbled(table(spark, folder, name), ["book_id", "idx"], text, models, margin).where("garbled").select(F.lit(kind).alias("kind"), "book_id", "idx")
        for kind, name, text in (("chapter", "chapters", "content"), ("cue", "srt_entries", "text"))
    ]
    return parts[0].unionByName(parts[1]).distinct()


def p5_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Every scanned block, repaired, with what it held."""
    return scan.clean_blocks(table(spark, folder, "verified_texts"), table(spark, folder, "books"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return scan.noise_of(p5_blocks(spark, folder))


def p5_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The clean paragraphs of each book, in reading order of where they begin."""
    return scan.paragraphs(p5_blocks(spark, folder))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, folder, "documents"))


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "bench_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).where(F.col("exact_tokens") * 3 >= F.col("item_tokens")).select("doc_id", "item_id").distinct()


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every document."""
    return toxic.score_documents(*(table(spark, folder, t) for t in ("documents", "lexicon", "labels")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return toxic.cases(p8_scores(spark, folder))


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of each source's documents, by category."""
    return toxic.source_rates(p8_scores(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("p") and k[1:2].isdigit()}


#: The rule of TESTDATA.md in SQL; no SQL is given where DuckDB can't express the operator.
P3_FOUND = """
SELECT DISTINCT j.job_id, c.idx
FROM chapters c JOIN job_options j ON j.book_id = c.book_id
WHERE CAST(ceil(length(decode(c.content)) / 4.0) AS BIGINT) > CASE WHEN j.max_input_tokens > 0 THEN j.max_input_tokens ELSE 4000 END
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_FOUND}
