"""Bounded samples of labelled rows, the same for the same rows whatever their order and partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import label_code


def labelled(df: DataFrame, n: int, least_chars: int = 1) -> list[tuple[str, str]]:
    """At most n distinct (language, text) of df (lang, text), those with the lowest hashes of their text.

    Only rows below a cut of the hash range reach the driver: the cut is set by the number of rows so that about
    1.3 n of them do. Rows with a null text or a label that names no language are left out.
    """
    total = df.count()  # from the files' footers
    part = min(1.0, 1.3 * n / max(total, 1))
    cut = min(2**63 - 1, int(-(2**63) + part * 2**64))
    rows = (
        df.select(label_code(F.col("lang")).alias("lang"), "text")
        .where(f"text is not null and length(text) >= {int(least_chars)} and lang is not null")
        .withColumn("h", F.xxhash64("text"))
        .where(F.col("h") <= F.lit(cut))
        .collect()
    )
    return [(lang, text) for _, lang, text in sorted({(r["h"], r["lang"], r["text"]) for r in rows})[:n]]
