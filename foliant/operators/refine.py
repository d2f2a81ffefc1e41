"""Second passes over recognised pages: parsing what a service answers, matching refined blocks to the original ones, and
repeating until nothing changes. A page is one group, bounded by what fits on it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

KINDS = ("heading", "subheading", "paragraph", "caption", "table_cell", "other", "image")
_HEAD = re.compile(r"^(?:#{1,6}\s+\S|[0-9]+(?:\.[0-9]+)*[.\s　]\s*\S|第[0-9])")
_CAPTION = re.compile(r"^(?:图|表|Fig|Table)")


def line_kind(line: str) -> str:
    t = line.strip()
    if _CAPTION.match(t):
        return "caption"
    if _HEAD.match(t) and len(t) <= 80 and not re.search(r"[.!?。！？]$", t):
        return "subheading" if t.startswith("##") or re.match(r"^[0-9]+\.[0-9]", t) else "heading"
    return "paragraph"


def plain_blocks(text: str) -> list[tuple[str, str]]:
    """(type, text) of an answer in plain text: lines of a paragraph are joined, blank lines and other types end it."""
    out: list[tuple[str, str]] = []
    run: list[str] = []

    def end() -> None:
        if run:
            out.append(("paragraph", " ".join(run)))
            run.clear()

    for line in text.split("\n"):
        t = line.strip()
        if not t:
            end()
        elif len(t.encode()) <= 10 and t.startswith("[") and t.endswith("]"):
            continue
        elif (kind := line_kind(t)) != "paragraph":
            end()
            out.append((kind, re.sub(r"^#+\s*", "", t)))
        else:
            run.append(t)
    end()
    return out


def loose_json(text: str):
    """The object of an answer: as it is, as a JSON string of one, or the first balanced braces in it; None if there is none."""
    text = re.sub(r"^```[A-Za-z]*\s*\n?|\n?```\s*$", "", text.strip())
    for _ in range(2):
        try:
            value = json.loads(text)
        except ValueError:
            break
        if isinstance(value, dict):
            return value
        if not isinstance(value, str):
            return None
        text = value
    start = text.find("{")
    while start >= 0:
        depth, quoted, skip = 0, False, False
        for k in range(start, len(text)):
            c = text[k]
            if skip:
                skip = False
            elif c == "\\" and quoted:
                skip = True
            elif c == '"':
                quoted = not quoted
            elif not quoted and c in "{}":
                depth += 1 if c == "{" else -1
                if depth == 0:
                    try:
                        return json.loads(text[start : k + 1])
                    except ValueError:
                        break
        start = text.find("{", start + 1)
    return None


def crop_box(box: tuple[int, int, int, int], scale: float, width: int, height: int) -> tuple[int, int, int, int]:
    """A box grown about its centre and kept on the page."""
    x, y, w, h = box
    gw, gh = round(w * scale), round(h * scale)
    left, top = max(0, min(round(x - (gw - w) / 2), width)), max(0, min(round(y - (gh - h) / 2), height))
    return left, top, max(0, min(gw, width - left)), max(0, min(gh, height - top))


def fold(text: str) -> str:
    return "".join(text.split()).lower()


def match(refined: list[str], original: list[str]) -> list[tuple[int, int] | None]:
    """For each refined text the range [first, last] of original ones that it stands for, each used once.

    In order of preference: the first equal one; the first run of neighbours that equals it when joined; the first run
    of which one holds the other and is at least four fifths as long in bytes.
    """
    keys = [fold(t) for t in original]
    free = [True] * len(keys)
    out: list[tuple[int, int] | None] = []
    for text in refined:
        want = fold(text)
        found = next(((k, k) for k, key in enumerate(keys) if free[k] and key == want and want), None)
        close = None
        if found is None and want:
            for a in range(len(keys)):
                joined = ""
                for b in range(a, len(keys)):
                    if not free[b]:
                        break
                    joined += keys[b]
                    if joined == want:
                        found = (a, b)
                        break
                    short, long = sorted((len(joined.encode()), len(want.encode())))
                    if close is None and short * 5 >= long * 4 and (joined in want or want in joined):
                        close = (a, b)
                    if len(joined) > len(want) * 2 + 20:
                        break
                if found:
                    break
        found = found or close
        if found:
            free[found[0] : found[1] + 1] = [False] * (found[1] - found[0] + 1)
        out.append(found)
    return out


MATCHED = "book_id string, page_number int, block_ix int, text string, first_ix int, last_ix int, confidence double, x int, y int, w int, h int"


def carry_over(refined: DataFrame, original: DataFrame) -> DataFrame:
    """Refined blocks with what they stand for: MATCHED. Their box is that around the matched ones, their confidence the
    greatest of those, at least 0.8; null where nothing matches."""

    def run(key: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        new, old = new.sort_values("block_ix"), old.sort_values("block_ix")
        rows = []
        for r, m in zip(new.itertuples(index=False), match(new["text"].tolist(), old["text"].tolist()), strict=True):
            if m is None:
                rows.append((*key, r.block_ix, r.text, None, None, None, None, None, None, None))
                continue
            part = old.iloc[m[0] : m[1] + 1]
            boxes = [b for b in part["bbox"] if b is not None]
            confidence = max([0.8, *part["confidence"].dropna().astype(float)])
            if boxes:
                x, y = min(b["x"] for b in boxes), min(b["y"] for b in boxes)
                box = (x, y, max(b["x"] + b["w"] for b in boxes) - x, max(b["y"] + b["h"] for b in boxes) - y)
            else:
                box = (None,) * 4
            rows.append((*key, r.block_ix, r.text, int(part["block_ix"].iloc[0]), int(part["block_ix"].iloc[-1]), confidence, *box))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in MATCHED.split(", ")])

    keys = ["book_id", "page_number"]
    cols = [*keys, "block_ix", "text"]
    return refined.select(*cols).groupBy(*keys).cogroup(original.select(*cols, "confidence", "bbox").groupBy(*keys)).applyInPandas(run, MATCHED)


def to_fixpoint(pages: DataFrame, make: Callable[[], Callable[[list[tuple[str, str]], int], list[tuple[str, str]]]], rounds: int = 3) -> DataFrame:
    """(book_id, page_number, block_ix, text, block_type, rounds): each page's blocks refined until a round changes neither
    texts nor types, at most `rounds`.

    make gives, once per partition, a function of the blocks (text, type) and the round. A null type is a paragraph.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refine = make()
        for b in batches:
            rows = []
            for book, page, blocks in zip(b["book_id"], b["page_number"], b["blocks"], strict=True):
                now, used = [(x["text"], x["block_type"]) for x in blocks], 0
                for used in range(1, rounds + 1):
                    new = [tuple(x) for x in refine(now, used)]
                    if new == now:
                        break
                    now = new
                rows += [(book, page, k, *x, used) for k, x in enumerate(now)]
            yield pd.DataFrame(rows, columns=["book_id", "page_number", "block_ix", "text", "block_type", "rounds"])

    from pyspark.sql import functions as F

    ordered = F.array_sort(F.collect_list(F.struct("block_ix", "text", F.coalesce("block_type", F.lit("paragraph")).alias("block_type"))))
    grouped = pages.groupBy("book_id", "page_number").agg(ordered.alias("blocks"))
    return grouped.mapInPandas(run, "book_id string, page_number int, block_ix int, text string, block_type string, rounds int")


PARSED = "part int, block_type string, text string"


def parse_answers(answers: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys + (part, block_type, text): the blocks of answers in plain text, or of the JSON object they hold.

    Null and empty answers give no rows; an object without a list of blocks is plain text.
    """
    from pyspark.sql import functions as F

    source = answers.select(*keys, F.col(text).alias("__text")).where("__text is not null")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def blocks_of(answer: str) -> list[tuple[str, str]]:
        found = loose_json(answer) if "{" in answer else None
        if isinstance(found, dict) and isinstance(found.get("blocks"), list):
            made = [(x.get("block_type"), x.get("text")) for x in found["blocks"] if isinstance(x, dict) and isinstance(x.get("text"), str)]
            return [(k if k in KINDS else line_kind(t), t) for k, t in made]
        return plain_blocks(answer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*key, k, *x) for *key, answer in b[[*keys, "__text"]].itertuples(index=False) for k, x in enumerate(blocks_of(answer))]
            yield pd.DataFrame(rows, columns=[*keys, "part", "block_type", "text"])

    return source.mapInPandas(run, f"{kinds}, {PARSED}")


def crops(blocks: DataFrame, scale: float, width: str = "page_width", height: str = "page_height") -> DataFrame:
    """blocks + crop STRUCT<x, y, w, h>: the box of each, grown about its centre by `scale` and kept on the page; null without one.

    As crop_box, by expressions: halves are rounded to even, as Python does.
    """
    from pyspark.sql import functions as F

    b = lambda c: F.col(f"bbox.{c}").cast("double")
    grown = {c: F.bround(b(c) * scale) for c in "wh"}
    at = {c: F.greatest(F.lit(0), F.least(F.bround(b(c) - (grown[d] - b(d)) / 2), F.col(most))) for c, d, most in (("x", "w", width), ("y", "h", height))}
    size = {d: F.greatest(F.lit(0), F.least(grown[d], F.col(most) - at[c])) for c, d, most in (("x", "w", width), ("y", "h", height))}
    made = F.struct(*[(at | size)[c].cast("int").alias(c) for c in "xywh"])
    return blocks.withColumn("crop", F.when(F.col("bbox").isNotNull(), made))
