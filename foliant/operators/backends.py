"""Services that read images, as interfaces, and the calls of them over tables of images.

Each partition makes its own backend; calls are retried at once. Results are structs with an error, so that a page that
fails takes no other one with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

BLOCK = "struct<text:string,confidence:double,bbox:struct<x:int,y:int,w:int,h:int>,block_type:string>"
ROWS = f"book_id string, page_number int, blocks array<{BLOCK}>, error string"
SCALES = (1.0, 1.5, 2.0)


class Reader(Protocol):
    """Recognises a page: a list of blocks as dictionaries of BLOCK."""

    def extract(self, image: bytes, mime: str) -> list[dict]: ...


class Verifier(Protocol):
    """Reads a block again, magnified: its text and confidence."""

    def verify(self, image: bytes, mime: str, text: str, scale: float) -> tuple[str, float]: ...


class FakeReader:
    """Takes the bytes of an image for text: each line is a block."""

    def extract(self, image: bytes, mime: str) -> list[dict]:
        return [{"text": t, "confidence": 0.9, "bbox": None, "block_type": "paragraph"} for t in image.decode().split("\n") if t]


def recognise(images: DataFrame, make: Callable[[], Reader], concurrency: int = 3, retries: int = 2) -> DataFrame:
    """ROWS of (book_id, page_number, image, mime): at most `concurrency` calls at once; a null image has an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make()
        for b in batches:
            out = []
            for book, page, image, mime in zip(b["book_id"], b["page_number"], b["image"], b["mime"], strict=True):
                blocks = error = None
                for _ in range(retries + 1):
                    try:
                        if image is None:
                            raise ValueError("no image")
                        blocks, error = reader.extract(bytes(image), mime), None
                        break
                    except Exception as e:
                        error = str(e)
                out.append((book, page, blocks, error))
            yield pd.DataFrame(out, columns=["book_id", "page_number", "blocks", "error"])

    return images.select("book_id", "page_number", "image", "mime").repartition(concurrency, "book_id", "page_number").mapInPandas(run, ROWS)


def verify(candidates: DataFrame, make: Callable[[], Verifier], threshold: float = 0.7, attempts: int = 3) -> DataFrame:
    """(book_id, page_number, block_ix, text, confidence, changed) of candidates with their page's image.

    The more confident attempt wins; one at the threshold ends it; the confidence never falls below the first one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        verifier = make()
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                best, sure = r.text, -1.0
                for scale in SCALES[:attempts]:
                    try:
                        text, confidence = verifier.verify(bytes(r.image), r.mime, r.text, scale)
                    except Exception:
                        continue
                    if confidence > sure:
                        best, sure = text, confidence
                    if sure >= threshold:
                        break
                first = float(r.confidence) if pd.notna(r.confidence) else 0.0
                out.append((r.book_id, r.page_number, r.block_ix, best, max(sure, first), best != r.text))
            yield pd.DataFrame(out, columns=["book_id", "page_number", "block_ix", "text", "confidence", "changed"])

    cols = ["book_id", "page_number", "block_ix", "text", "confidence", "image", "mime"]
    return candidates.select(*cols).mapInPandas(run, "book_id string, page_number int, block_ix int, text string, confidence double, changed boolean")
