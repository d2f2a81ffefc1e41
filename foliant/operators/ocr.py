"""Cleanup and layout of scanned pages, block by block: filters, islands, running sums and folds over small arrays.

Islands and running sums order the blocks of a page (or the headings of a book), never all blocks of a book: a page is
bounded, and a book's chapters are numbered from counts per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import blocks as B
from foliant.functions import text as T

PAGE = ["book_id", "page_number"]


def repeated_headers(blocks: DataFrame, least: str = "floor(pages / 5)") -> DataFrame:
    """(book_id, header, n): white-space-free texts of up to 80 bytes on at least `least` of a book's pages, of three or more.

    least is an expression over pages; greatest(2, floor(pages / 5)) keeps short books whole. Each page counts a text
    once; both counts are partial before they are shuffled.
    """
    pages = blocks.select(*PAGE).distinct().groupBy("book_id").agg(F.count("*").alias("pages"))
    keys = blocks.select(*PAGE, T.trim(F.col("text")).alias("t")).where("t != '' and octet_length(t) <= 80")
    counts = keys.select(*PAGE, B.header_key(F.col("t")).alias("header")).distinct().groupBy("book_id", "header").agg(F.count("*").alias("n"))
    return counts.join(pages, "book_id").where(f"pages >= 3 and n >= {least}").select("book_id", "header", "n")


def clean(blocks: DataFrame, headers: DataFrame) -> DataFrame:
    """Blocks without leaked instructions, page numbers and running headers."""
    kept = blocks.where(~B.is_leaked(F.col("text")) & ~B.is_page_number(F.col("text")))
    lists = headers.groupBy("book_id").agg(F.collect_list("header").alias("headers"))
    kept = kept.join(lists, "book_id", "left")
    known = F.coalesce("headers", F.array().cast("array<string>"))
    return kept.where(~B.starts_with_header(B.header_key(F.col("text")), known)).drop("headers")


def _islands(blocks: DataFrame, flag: Column) -> DataFrame:
    w = Window.partitionBy(*PAGE).orderBy("block_ix")
    return blocks.withColumn("flag", flag).withColumn("island", F.sum(F.when(F.col("flag"), 0).otherwise(1)).over(w))


def group_labels(blocks: DataFrame) -> DataFrame:
    """(book_id, page_number, block_ix, block_type, text, merged): each run of labels on a page as one block of type other."""
    runs = _islands(blocks, B.is_label(F.col("text"), F.col("block_type")))
    texts = F.array_sort(F.collect_list(F.struct("block_ix", F.when(F.col("flag"), T.trim(F.col("text"))).otherwise(F.col("text")).alias("text"))))
    return runs.groupBy(*PAGE, "island", "flag").agg(
        F.min("block_ix").alias("block_ix"),
        F.when(F.first("flag"), F.lit("other")).otherwise(F.min_by("block_type", "block_ix")).alias("block_type"),
        F.array_join(F.transform(texts, lambda t: t["text"]), "\n").alias("text"),
        F.count("*").alias("merged"),
    ).select(*PAGE, "block_ix", "block_type", "text", "merged")


def table_runs(blocks: DataFrame) -> DataFrame:
    """(book_id, page_number, table_ix, cells ARRAY<STRUCT<block_ix, text, bbox>>): runs of cells on a page."""
    runs = _islands(blocks, F.col("block_type") == "table_cell").where("flag")
    return runs.groupBy(*PAGE, "island").agg(
        F.min("block_ix").alias("table_ix"), F.array_sort(F.collect_list(F.struct("block_ix", "text", "bbox"))).alias("cells")
    ).drop("island")


def full_text(blocks: DataFrame) -> DataFrame:
    """(book_id, page_number, full_text): the blocks of a page in order, with blank lines between."""
    parts = F.array_sort(F.collect_list(F.struct("block_ix", "text")))
    return blocks.groupBy(*PAGE).agg(F.array_join(F.transform(parts, lambda b: b["text"]), "\n\n").alias("full_text"))


def chapter_of(blocks: DataFrame) -> DataFrame:
    """blocks + chapter: 1 before and with the first top-level heading, then one more with each further one.

    Headings are counted per page first; only the pages' counts run through a window of the book, and each page's blocks
    through one of the page.
    """
    top = F.when((F.col("block_type") == "heading") & B.is_top_heading(F.col("text")), 1).otherwise(0)
    flagged = blocks.withColumn("top", top)
    pages = flagged.groupBy(*PAGE).agg(F.sum("top").alias("tops"))
    before = F.sum("tops").over(Window.partitionBy("book_id").orderBy("page_number")) - F.col("tops")
    pages = pages.select(*PAGE, before.alias("before"))
    here = F.sum("top").over(Window.partitionBy(*PAGE).orderBy("block_ix"))
    numbered = flagged.withColumn("here", here).join(pages, PAGE)
    return numbered.withColumn("chapter", F.greatest(F.col("before") + F.col("here"), F.lit(1))).drop("top", "here", "before")


def captions(blocks: DataFrame, kind: str = "image") -> DataFrame:
    """Blocks of a kind with the text of a caption that follows directly on the page."""
    w = Window.partitionBy(*PAGE).orderBy("block_ix")
    nxt = blocks.withColumn("next_type", F.lead("block_type").over(w)).withColumn("next_text", F.lead("text").over(w))
    return nxt.where(F.col("block_type") == kind).select(*PAGE, "block_ix", F.when(F.col("next_type") == "caption", F.col("next_text")).alias("caption"))


def table_rows(cells: Column) -> Column:
    """ARRAY<ARRAY<STRUCT>>: cells of a table in rows, from top to bottom and left to right.

    By y, each cell joins the first row whose first cell is within half the least cell height (at least 5); a fold, as
    rows are anchored at their first cells. A table is bounded by its page.
    """
    y = lambda c: F.coalesce(c["bbox"]["y"], F.lit(0))
    x = lambda c: F.coalesce(c["bbox"]["x"], F.lit(0))
    halves = F.filter(F.transform(cells, lambda c: F.floor(c["bbox"]["h"] / 2)), lambda h: h.isNotNull())
    limit = F.greatest(F.coalesce(F.array_min(halves), F.lit(10)), F.lit(5))
    tagged = F.array_sort(F.transform(cells, lambda c, i: F.struct(y(c).alias("y"), i.alias("i"), c.alias("c"))))
    kind = "array<struct<y:int,i:int,c:struct<block_ix:int,text:string,bbox:struct<x:int,y:int,w:int,h:int>>>>"

    def step(rows: Column, t: Column) -> Column:
        at = F.array_position(F.transform(rows, lambda r: F.abs(r[0]["y"] - t["y"]) <= limit), True)
        put = F.transform(rows, lambda r, k: F.when(k == at - 1, F.array_append(r, t)).otherwise(r))
        return F.when(at > 0, put).otherwise(F.array_append(rows, F.array(t)))

    rows = F.aggregate(tagged, F.array().cast(f"array<{kind}>"), step)
    ordered = lambda r: F.transform(F.array_sort(F.transform(r, lambda t: F.struct(x(t["c"]).alias("x"), t["y"].alias("y"), t["i"].alias("i"), t["c"].alias("c")))), lambda s: s["c"])
    return F.transform(rows, ordered)


def grid_of(cells: Column) -> Column:
    """The least number of columns, from 2 to half of six cells or more, in which x repeats; null if there is none.

    Within each column no x may differ from the mean, rounded down, by more than a sixth of it and 50.
    """
    n = F.size(cells)
    xs = F.transform(cells, lambda c: F.coalesce(c["bbox"]["x"], F.lit(0)))

    def steady(columns: Column, k: Column) -> Column:
        own = F.filter(xs, lambda x, i: i % columns == k)
        mean = F.floor(F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a + x) / F.size(own))
        return F.forall(own, lambda x: F.abs(x - mean) <= F.floor(mean / 6) + 50)

    tries = F.filter(F.sequence(F.lit(2), F.greatest((n / 2).cast("int"), F.lit(2))), lambda c: (n % c == 0) & F.forall(F.sequence(F.lit(0), c - 1), lambda k: steady(c, k)))
    return F.when(n >= 6, F.get(tries, F.lit(0)))


def grid_columns(tables: DataFrame) -> DataFrame:
    """(book_id, page_number, table_ix, columns) of tables (table_runs) whose places put all cells in one row."""
    one = tables.where((F.size("cells") >= 6) & (F.size(table_rows(F.col("cells"))) == 1))
    return one.select(*PAGE, "table_ix", grid_of(F.col("cells")).alias("columns")).where("columns is not null")


def box_union(blocks: DataFrame) -> DataFrame:
    """(book_id, page_number, bbox): the box around all boxes of a page; null if it has none."""
    b = blocks.where("bbox is not null").groupBy(*PAGE).agg(
        F.min("bbox.x").alias("x"), F.min("bbox.y").alias("y"), F.max(F.expr("cast(bbox.x as bigint) + bbox.w")).alias("r"), F.max(F.expr("cast(bbox.y as bigint) + bbox.h")).alias("b")
    )
    boxes = b.select(*PAGE, F.struct("x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("b") - F.col("y")).alias("h")).alias("bbox"))
    return blocks.select(*PAGE).distinct().join(boxes, PAGE, "left")


def verify_candidates(blocks: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Blocks to check again: a confidence below the threshold, or an anomaly beyond 0.3."""
    return blocks.withColumn("anomaly", T.anomaly(F.col("text"))).where((F.col("confidence").cast("double") < threshold) | (F.col("anomaly") > 0.3))


def best_attempt(attempts: Column, original: Column, threshold: float = 0.7) -> Column:
    """STRUCT<text, confidence, anomaly, done> of ordered attempts ARRAY<STRUCT<text, confidence, anomaly>>.

    The more confident wins, then the less anomalous; a confident one (threshold) with an anomaly of at most 0.2 ends it.
    """
    kind = "struct<text:string,confidence:double,anomaly:double,done:boolean>"

    def step(best: Column, a: Column) -> Column:
        better = best["text"].isNull() | (a["confidence"] > best["confidence"]) | ((a["confidence"] == best["confidence"]) & (a["anomaly"] < best["anomaly"]))
        chosen = F.when(better, F.struct(a["text"].alias("text"), a["confidence"].alias("confidence"), a["anomaly"].alias("anomaly"), ((a["confidence"] >= threshold) & (a["anomaly"] <= 0.2)).alias("done")).cast(kind)).otherwise(best)
        return F.when(best["done"], best).otherwise(chosen)

    start = F.struct(F.lit(None).cast("string").alias("text"), F.lit(0.0).alias("confidence"), F.lit(1.0).alias("anomaly"), F.lit(False).alias("done"))
    out = F.aggregate(attempts, start.cast(kind), step)
    return F.struct(out["text"].alias("text"), F.greatest(out["confidence"], original).alias("confidence"), out["anomaly"].alias("anomaly"))
