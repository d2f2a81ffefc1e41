"""Tables of contents: which label a chapter gets, and ids that differ."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts of names of files that hold no running text.
SKIPPED = ("cover", "titlepage", "copyright", "dedication", "colophon")


def is_running_text(name: Column, patterns: tuple[str, ...] = SKIPPED) -> Column:
    """Whether no pattern is found in a file's name, whatever its case. A pattern that can't be compiled is a ValueError."""
    for p in patterns:
        try:
            re.compile(p)
        except re.error as e:
            raise ValueError(f"bad pattern {p!r}: {e}") from e
    found = F.lit(False)
    for p in patterns:
        found = found | F.lower(name).rlike(f"(?i){p}")
    return ~found


def translatable(chapters: DataFrame, patterns: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(book_id, idx) of the chapters whose file holds running text; a null name counts as one."""
    return chapters.where(F.coalesce(is_running_text(F.col("href"), patterns), F.lit(True))).select("book_id", "idx")


def labels(entries: DataFrame) -> DataFrame:
    """(book_id, path, label): of (book_id, pos, href, label) the last entry without a fragment, else the first with one."""
    path = F.element_at(F.split("href", "#"), 1)
    frag = F.col("href").contains("#")
    rank = F.struct((~frag).cast("int"), F.when(frag, -F.col("pos")).otherwise(F.col("pos")))
    return entries.withColumn("path", path).groupBy("book_id", "path").agg(F.max_by("label", rank).alias("label"))


def unique_ids(ids: DataFrame, separator: str = "_") -> DataFrame:
    """(book_id, idx, id): base, base_2, base_3 in order (with `separator`), the next number free where another base or made id has it: as the EPUB writer's fold.

    Made ids keep their base without its numbers, so only bases that share this root can collide; only roots with more
    than one base in a book are folded, each by itself.
    """
    root = Window.partitionBy("book_id", "root")
    n = F.row_number().over(Window.partitionBy("book_id", "base").orderBy("idx"))
    rows = ids.select("book_id", "idx", "base", F.regexp_replace("base", f"({separator}[0-9]+)+$", "").alias("root"))
    rows = rows.withColumn("alone", F.min("base").over(root) == F.max("base").over(root))
    plain = rows.where("alone").select("book_id", "idx", F.when(n == 1, F.col("base")).otherwise(F.concat_ws(separator, "base", n.cast("string"))).alias("id"))

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        following: dict[str, int] = {}
        made = []
        g = g.sort_values(["idx", "base"], kind="stable")
        for base in g["base"]:
            name, k = base, following.get(base, 2)
            while name in used:
                name, k = f"{base}{separator}{k}", k + 1
            following[base] = k
            used.add(name)
            made.append(name)
        return g[["book_id", "idx"]].assign(id=made)

    together = rows.where("not alone").groupBy("book_id", "root").applyInPandas(fold, plain.schema)
    return plain.unionByName(together)
