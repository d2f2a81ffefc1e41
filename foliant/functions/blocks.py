"""Predicates over blocks of scanned pages. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim, without_space

#: Lower-case phrases of instructions that leaked into recognised text.
LEAKED = (
    "epub output should", "preserve heading hierarchy", "generate a table of contents", "ocr confidence is low", "verification backend",
    "review low-confidence", "extract all text from the image", "return only a valid json", "top-level 'blocks' array", "each block must have",
    "you are a strict ocr engine", "you are an ocr engine", "your job is to extract", "output format:", "rules:", "example of valid output",
    "sample document", "testing pdf ocr", "rendered as page images", "vision - language model", "vision-language model", "layout analysis",
    "reading order", "chapter segmentation", "test document", "## chapter", "chapter 2: structure", "sample heading",
)

#: Fixed value: ideographs, kana, full-width forms and their punctuation.
CJK = r"\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ff00}-\x{ffef}\x{3000}-\x{303f}"


def is_leaked(text: Column, phrases: tuple[str, ...] = LEAKED) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(low, F.lit(p))
    return found | trim(low).rlike("^chapter [0-9]")


def is_page_number(text: Column) -> Column:
    """One to four digits, or a range of numbers in at most 15 bytes."""
    t = trim(text)
    return t.rlike(r"^[0-9]{1,4}$") | ((F.octet_length(t) <= 15) & t.rlike(r"^\s*[0-9]*\.*\s*(?:-\s*[0-9]*\.*\s*)+$"))


def is_artifact(text: Column) -> Column:
    t = trim(text)
    return (F.octet_length(t) <= 10) & t.startswith("[") & t.endswith("]")


def header_key(text: Column) -> Column:
    return without_space(text)


def starts_with_header(key: Column, headers: Column) -> Column:
    """The block begins with a header and has at most ten bytes more."""
    return F.exists(headers, lambda h: key.startswith(h) & (F.octet_length(key) <= F.octet_length(h) + 10))


def looks_like_heading(text: Column) -> Column:
    t = F.ltrim(text)
    return t.startswith("#") | t.rlike(f"^[0-9.]+(?:[ {CJK}])") | t.rlike("^第[0-9]")


def looks_like_caption(text: Column) -> Column:
    return F.ltrim(text).rlike("^(?:图|表|Fig|Table)")


def is_label(text: Column, kind: Column) -> Column:
    """A short piece of a diagram: up to 25 bytes, no sentence, heading or caption, not a longer purely CJK phrase."""
    t = trim(text)
    return (
        kind.isin("paragraph", "other")
        & (t != "")
        & (F.octet_length(t) <= 25)
        & ~t.rlike("[。！？.!?]$")
        & ~looks_like_heading(t)
        & ~looks_like_caption(t)
        & (t.rlike(f"[^{CJK}]") | (F.char_length(t) <= 6))
    )


def is_top_heading(text: Column) -> Column:
    """Whether a heading begins a chapter: not 1.1 and the like, nor 第 without a number."""
    t = trim(text)
    return F.when(t == "", False).when(t.startswith("第"), t.rlike("^第[0-9]")).when(~t.rlike("^[0-9]"), True).otherwise(~t.rlike(r"^[0-9]+\."))


def plain_type(text: Column) -> Column:
    """The type of a line without layout: heading, subheading, caption or paragraph."""
    t = trim(text)
    return (
        F.when(looks_like_caption(t), "caption")
        .when(t.rlike("^##+ ") | t.rlike(r"^[0-9]+\.[0-9]"), "subheading")
        .when(looks_like_heading(t), "heading")
        .otherwise("paragraph")
    )


#: Signs of formulas, and what ends a sentence.
FORMULA = "μσδαβγθλπω∞∑∫%"
ENDS = "。！？.!?\"”"


def json_type(text: Column, has_box: Column) -> Column:
    """The type of a recognised block that names none: as of a line; with a box, formulas and clusters of short lines are other."""
    t = trim(text)
    base = plain_type(text)
    lines = F.filter(F.transform(F.split(t, "\n"), trim), lambda x: x != "")
    short = (F.size(lines) >= 3) & (F.floor(F.octet_length(t) / F.greatest(F.size(lines), F.lit(1))) <= 20)
    loose = ~t.rlike(f"[{ENDS}]$") & (t.rlike(f"[{FORMULA}]") | short)
    return F.when(base != "paragraph", base).when(~has_box | (t == ""), "paragraph").when(t.startswith("图") | t.startswith("表") | t.startswith("Fig"), "caption").when(loose, "other").otherwise("paragraph")


def box(json: Column) -> Column:
    """STRUCT<x, y, w, h> of an object or a list of four or five numbers; null unless all four are there and not negative."""
    kind = "struct<x:bigint,y:bigint,w:bigint,h:bigint>"
    named = F.from_json(json, kind)
    listed = F.from_json(json, "array<bigint>")
    made = F.when(F.size(listed).isin(4, 5), F.struct(*[listed[k].alias(c) for k, c in enumerate("xywh")]))
    out = F.coalesce(F.when(json.rlike(r"^\s*\{"), named), made)
    good = F.lit(True)
    for c in "xywh":
        good = good & (F.coalesce(out[c], F.lit(-1)) >= 0)
    return F.when(good, out)
