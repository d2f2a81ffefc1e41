"""Books from recognised pages: markup of blocks and tables, chapters, and pictures cut out of pages.

Markup is made by expressions where the block is. Only what a chapter holds is gathered, as it is one document.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import blocks as B
from foliant.functions import text as T

from .ocr import PAGE, grid_of, table_rows

LEAST_FIGURE = 20
#: The look of recognised books.
STYLE = (
    "<style>\nh1, h2 { font-weight: bold; }\nh1 { font-size: 1.5em; margin: 1.2em 0 0.6em; }\nh2 { font-size: 1.25em; margin: 1em 0 0.5em; }\n"
    "table, th, td { border: 1px solid #333; border-collapse: collapse; padding: 6px; }\nth { background-color: #f2f2f2; }\n"
    "figure { margin: 1em 0; padding: 0; }\nfigure img { max-width: 100%; height: auto; }\nfigcaption { text-align: center; font-size: 0.9em; }\n"
    "figure pre { border: 1px solid #ccc; padding: 8px; overflow-x: auto; }\n</style>"
)


def tag(name: str, inner: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))


def joined(parts: Column, before: str = "", after: str = "") -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit(before), p, F.lit(after))), "")


def paragraphs_html(text: Column) -> Column:
    """ARRAY<STRING>: paragraphs between blank lines, each on one line."""
    return F.transform(T.paragraphs(text), lambda p: tag("p", T.escape(p)))


def caption_html(text: Column) -> Column:
    """The first line as the caption, the rest as paragraphs."""
    rest = F.coalesce(paragraphs_html(T.other_lines(text)), F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(tag("figcaption", T.escape(T.first_line(text)))), rest), "\n")


def image_html(source: Column, caption: Column) -> Column:
    """A figure; without a caption it has a general one."""
    below = F.when(caption.isNotNull(), caption_html(caption)).otherwise("<figcaption>图</figcaption>")
    return F.concat(F.lit('<figure><img src="'), T.escape(source), F.lit('" alt="figure"/>'), below, F.lit("</figure>"))


def table_html(cells: Column) -> Column:
    """The table of a run of cells: rows by their places; cells that all stand in one row, by the repeating places of columns."""
    rows = table_rows(cells)
    columns = grid_of(cells)
    last = (F.size(cells) / F.coalesce(columns, F.lit(1))).cast("int") - 1
    grid = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(cells, (k * columns + 1).cast("int"), columns.cast("int")))
    rows = F.when((F.size(rows) == 1) & columns.isNotNull(), grid).otherwise(rows)
    line = lambda r: F.concat(F.lit("  <tr>"), joined(F.transform(r, lambda c: T.escape(c["text"])), "<td>", "</td>"), F.lit("</tr>\n"))
    return F.concat(F.lit("<table>\n"), joined(F.transform(rows, line)), F.lit("</table>"))


def markdown_lines(text: Column) -> Column:
    """ARRAY<STRING>: the first run of lines that begin and end with a bar, also of rows written in one line."""
    lines = F.transform(F.split(F.regexp_replace(text, r"\|(?= \|)", "|\n"), "\n"), T.trim)
    row = lambda x: x.startswith("|") & x.endswith("|")
    first = F.array_position(F.transform(lines, row), True)
    tail = F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines))
    stop = F.array_position(F.transform(tail, lambda x: ~row(x)), True)
    return F.when(first == 0, F.array().cast("array<string>")).when(stop > 0, F.slice(tail, 1, (stop - 1).cast("int"))).otherwise(tail)


def cells_of(row: Column) -> Column:
    """ARRAY<STRING>: the trimmed cells of a row."""
    return F.transform(F.split(F.regexp_replace(row, r"^\|+|\|+$", ""), r"\|"), T.trim)


def markdown_html(text: Column) -> Column:
    """The table that a text holds, with its head; null if it holds none: two rows, the second a rule."""
    lines = markdown_lines(text)
    rule = F.get(lines, F.lit(1))
    good = (F.size(lines) >= 2) & rule.rlike(r"^\|(?:[-: ]+\|)*\|?[^|]*$") & ~F.regexp_extract(rule, r"^\|((?:[^|]+\|)*)", 1).rlike(r"[^-:| ]")
    head = joined(F.transform(cells_of(F.get(lines, F.lit(0))), T.escape), "<th>", "</th>")
    body = F.transform(F.slice(lines, 3, F.greatest(F.size(lines), F.lit(0))), lambda r: F.concat(F.lit("    <tr>"), joined(F.transform(cells_of(r), T.escape), "<td>", "</td>"), F.lit("</tr>\n")))
    return F.when(good, F.concat(F.lit("<table>\n  <thead>\n    <tr>"), head, F.lit("</tr>\n  </thead>\n  <tbody>\n"), joined(body), F.lit("  </tbody>\n</table>")))


def block_html(text: Column, kind: Column) -> Column:
    """The markup of a block by itself."""
    safe = T.escape(text)
    several = F.size(F.split(F.regexp_replace(safe, r"\r?\n\z", ""), "\n")) > 1
    return (
        F.when(kind == "heading", tag("h1", safe)).when(kind == "subheading", tag("h2", safe)).when(kind == "caption", caption_html(text))
        .when(kind == "table_cell", tag("td", safe)).when(kind == "image", image_html(text, F.lit(None).cast("string")))
        .when(kind == "other", F.when(several, F.concat(F.lit("<figure><pre>"), safe, F.lit("</pre></figure>"))).otherwise(tag("p", safe)))
        .otherwise(F.coalesce(markdown_html(text), F.array_join(paragraphs_html(text), "\n")))
    )


def elements(blocks: DataFrame) -> DataFrame:
    """(book_id, page_number, block_ix, html, title): runs of cells as tables, captions with the images before them, the rest alone.

    title is that of a chapter which begins with the block: a heading's first line, if it isn't numbered below the top.
    """
    page = Window.partitionBy(*PAGE).orderBy("block_ix")
    kind = F.col("block_type")
    b = blocks.select(*PAGE, "block_ix", "text", F.coalesce(kind, F.lit("paragraph")).alias("block_type"), "bbox")
    b = b.withColumn("island", F.sum(F.when(kind == "table_cell", 0).otherwise(1)).over(page))
    b = b.withColumn("before", F.lag(kind).over(page)).withColumn("next", F.struct(F.lead(kind).over(page).alias("kind"), F.lead("text").over(page).alias("text")))
    cells = F.array_sort(F.collect_list(F.struct("block_ix", "text", "bbox")))
    tables = b.where(kind == "table_cell").groupBy(*PAGE, "island").agg(F.min("block_ix").alias("block_ix"), cells.alias("cells"))
    tables = tables.select(*PAGE, "block_ix", table_html(F.col("cells")).alias("html"), F.lit(None).cast("string").alias("title"))
    first, rest = T.first_line(F.col("text")), F.coalesce(paragraphs_html(T.other_lines(F.col("text"))), F.array().cast("array<string>"))
    top = (kind == "heading") & B.is_top_heading(first)
    heading = F.array_join(F.concat(F.array(F.when(top, tag("h1", T.escape(first))).otherwise(tag("h2", T.escape(first)))), rest), "\n")
    image = image_html(F.col("text"), F.when(F.col("next.kind") == "caption", F.col("next.text")))
    html = F.when(kind == "heading", heading).when(kind == "image", image).otherwise(block_html(F.col("text"), kind))
    used = (kind == "caption") & (F.coalesce("before", F.lit("")) == "image")
    alone = b.where((kind != "table_cell") & ~used).select(*PAGE, "block_ix", html.alias("html"), F.when(top, first).alias("title"))
    return alone.unionByName(tables)


def chapters(blocks: DataFrame) -> DataFrame:
    """(book_id, idx, href, title, content): the chapters of books of recognised pages; a book begins one at each top heading.

    What stands before the first top heading is part of the first chapter; one without a heading is called Chapter. Null
    keys and texts are left out; a book without blocks has no rows; repeated rows must have been dropped; other columns
    are ignored. Headings are counted per page, then over the pages' counts of a book.
    """
    rows = elements(blocks.where("book_id is not null and page_number is not null and block_ix is not null and text is not null"))
    begins = F.when(F.col("title").isNotNull(), 1).otherwise(0)
    pages = rows.groupBy(*PAGE).agg(F.sum(begins).alias("n"))
    pages = pages.select(*PAGE, (F.sum("n").over(Window.partitionBy("book_id").orderBy("page_number")) - F.col("n")).alias("passed"))
    here = F.sum(begins).over(Window.partitionBy(*PAGE).orderBy("block_ix"))
    numbered = rows.withColumn("here", here).join(pages, PAGE).withColumn("n", F.greatest(F.col("here") + F.col("passed"), F.lit(1)))
    order = F.struct("page_number", "block_ix")
    parts = F.array_sort(F.collect_list(F.struct("page_number", "block_ix", "html")))
    made = numbered.groupBy("book_id", "n").agg(F.min_by("title", F.when(F.col("title").isNotNull(), order)).alias("title"), F.array_join(F.transform(parts, lambda p: p["html"]), "\n").alias("body"))
    title = F.coalesce("title", F.lit("Chapter"))
    return made.select("book_id", (F.col("n") - 1).cast("int").alias("idx"), F.format_string("chapter%03d.xhtml", "n").alias("href"), title.alias("title"), document(F.col("body"), title).alias("content"))


def document(body: Column, title: Column) -> Column:
    """A whole XHTML document with the style of recognised books."""
    return F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>'), T.escape(title), F.lit(f"</title>{STYLE}\n</head><body>\n"), body, F.lit("\n</body></html>")
    )


# ---------------------------------------------------------------- pictures


def figures(blocks: DataFrame) -> DataFrame:
    """(book_id, page_number, block_ix, bbox, href): blocks of other kinds that are large enough to be cut out, with a file's name.

    A name tells the page, counted from 0 in the book's order, and the number of the figure in the book. Pages are counted
    first; only their counts run through a window of the book.
    """
    fit = blocks.select(*PAGE, "block_ix", "bbox", ((F.col("block_type") == "other") & (F.col("bbox.w") >= LEAST_FIGURE) & (F.col("bbox.h") >= LEAST_FIGURE)).alias("fit"))
    pages = fit.groupBy(*PAGE).agg(F.sum(F.coalesce(F.col("fit"), F.lit(False)).cast("long")).alias("n"))
    book = Window.partitionBy("book_id").orderBy("page_number")
    pages = pages.select(*PAGE, (F.row_number().over(book) - 1).alias("page"), (F.sum("n").over(book) - F.col("n")).alias("passed"))
    n = F.row_number().over(Window.partitionBy(*PAGE).orderBy("block_ix"))
    named = fit.where("fit").withColumn("here", n).join(pages, PAGE)
    return named.select(*PAGE, "block_ix", "bbox", F.format_string("figure-%03d-%03d.png", F.col("page"), F.col("passed") + F.col("here")).alias("href"))


def with_figures(blocks: DataFrame, named: DataFrame) -> DataFrame:
    """Blocks in which those cut out have become images of their files."""
    names = named.select(*PAGE, "block_ix", "href")
    out = blocks.join(names, [*PAGE, "block_ix"], "left")
    return out.withColumn("block_type", F.when(F.col("href").isNotNull(), F.lit("image")).otherwise(F.col("block_type"))).withColumn("text", F.coalesce("href", "text")).drop("href")


def read_png(data: bytes) -> tuple[np.ndarray, int]:
    """(pixels of height x width x channels, colour type) of an 8-bit PNG that isn't interlaced or indexed."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += size + 12
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("a kind of PNG that isn't read")
    width, height, n = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height + 1, (width + 1) * n), np.int64)  # a row above and a pixel to the left of nothing
    for y in range(height):
        line, up, row = raw[y, 1:].astype(np.int64), out[y], out[y + 1]
        how = int(raw[y, 0])
        if how == 0:
            row[n:] = line
        elif how == 2:
            row[n:] = (line + up[n:]) & 255
        else:
            for x in range(width * n):
                a, b, c = int(row[x]), int(up[x + n]), int(up[x])
                if how == 1:
                    guess = a
                elif how == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                row[x + n] = (int(line[x]) + guess) & 255
    return out[1:, n:].astype(np.uint8).reshape(height, width, n), head[3]


def write_png(pixels: np.ndarray, colour: int) -> bytes:
    height, width = pixels.shape[:2]
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = np.zeros((height, 1 + width * pixels.shape[2]), np.uint8)
    raw[:, 1:] = pixels.reshape(height, -1)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw.tobytes())) + part(b"IEND", b"")


def cut_out(named: DataFrame, images: DataFrame) -> DataFrame:
    """(book_id, href, mime, data, error): figures cut out of the pages' images (PNG), as resources of the book.

    images: (book_id, page_number, image). A box is kept on its page; a page without a readable image gives an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for book, href, box, image in zip(b["book_id"], b["href"], b["bbox"], b["image"], strict=True):
                data = error = None
                try:
                    pixels, colour = read_png(bytes(image))
                    part = pixels[box["y"] : box["y"] + box["h"], box["x"] : box["x"] + box["w"]]
                    if not part.size:
                        raise ValueError("the box is not on the page")
                    data = write_png(part, colour)
                except Exception as e:
                    error = str(e) or "no image"
                out.append((book, href, "image/png", data, error))
            yield pd.DataFrame(out, columns=["book_id", "href", "mime", "data", "error"])

    rows = named.join(images.select(*PAGE, "image"), PAGE, "left")
    return rows.select("book_id", "href", "bbox", "image").mapInPandas(run, "book_id string, href string, mime string, data binary, error string")
