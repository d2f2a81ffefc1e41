"""Subtitles: text to cues and back, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import escape, trim


def cues(text: Column) -> Column:
    """ARRAY<STRUCT<idx, start, end, text>> of a file: blocks of three lines or more with a number and one arrow.

    Blocks that aren't such are left out; times stay strings; null for null.
    """
    clean = trim(F.replace(F.replace(F.regexp_replace(text, "^﻿", ""), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    blocks = F.filter(F.transform(F.split(clean, "\n\n"), lambda b: F.split(trim(b), "\n")), lambda b: F.size(b) >= 3)
    whole = F.filter(blocks, lambda b: trim(b[0]).rlike("^[0-9]{1,9}$") & (F.size(F.split(b[1], " --> ")) == 2))
    return F.transform(
        whole,
        lambda b: F.struct(
            trim(b[0]).cast("int").alias("idx"), trim(F.split(b[1], " --> ")[0]).alias("start"), trim(F.split(b[1], " --> ")[1]).alias("end"),
            F.array_join(F.slice(b, F.lit(3), F.size(b) - 2), "\n").alias("text"),
        ),
    )


def cue_text(idx: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat_ws("\n", idx.cast("string"), F.concat(start, F.lit(" --> "), end), text)


def cue_html(start: Column, end: Column, text: Column) -> Column:
    return F.concat(F.lit('<div class="srt-entry" data-start="'), escape(start), F.lit('" data-end="'), escape(end), F.lit('"><p>'), escape(text), F.lit("</p></div>"))


def files(entries: DataFrame, group: int = 500) -> DataFrame:
    """(book_id, part, text): cues in order as the text of a file, in parts of `group` numbers, so that no book is one row."""
    part = F.floor(F.col("idx") / group).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct("idx", cue_text(F.col("idx"), F.col("start_time"), F.col("end_time"), F.col("text")).alias("cue"))))
    return entries.groupBy("book_id", part.alias("part")).agg(F.array_join(F.transform(ordered, lambda c: c["cue"]), "\n\n").alias("text"))
