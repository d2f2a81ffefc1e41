"""Pages of PDF files as images, by an external program that each executor must have (pdftoppm of Poppler)."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame

PAGES = "book_id string, page_number int, image binary, mime string, error string"


def available(tool: str = "pdftoppm") -> bool:
    return shutil.which(tool) is not None


def render_pages(pdfs: DataFrame, dpi: int = 200, page: int | None = None, tool: str = "pdftoppm", limit: float = 600.0) -> DataFrame:
    """PAGES of (book_id, content): each page of a PDF file as a PNG image, or only the page named.

    A file of which no page can be rendered, each in `limit` seconds, gives one row with its error; null contents give
    none. The program reads the file from its input and writes one page at a time to its output, so nothing is left on
    the machine and no more than a page is held.
    """

    def one(data: bytes, number: int) -> tuple[bytes, str]:
        command = [tool, "-png", "-r", str(dpi), "-f", str(number), "-l", str(number), "-", "-"]
        done = subprocess.run(command, input=data, capture_output=True, timeout=limit)
        return (done.stdout if done.returncode == 0 else b""), done.stderr.decode("utf-8", "replace").strip()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["book_id", "page_number", "image", "mime", "error"]
        for b in batches:
            for book, content in zip(b["book_id"], b["content"], strict=True):
                made = 0
                try:
                    for number in count(1) if page is None else (page,):
                        image, told = one(bytes(content), number)
                        if not image:  # beyond the last page
                            break
                        made += 1
                        yield pd.DataFrame([(book, number, image, "image/png", None)], columns=columns)
                    error = None if made else told or "no page"
                except (OSError, subprocess.TimeoutExpired) as e:
                    error = str(e)
                if error:
                    yield pd.DataFrame([(book, None, None, None, error)], columns=columns)

    return pdfs.select("book_id", "content").where("content is not null").mapInPandas(run, PAGES)
