"""Text expressions: sentences, chunks, lines, keys and prompts. All are built-in column expressions.

White space is the Unicode property White_Space, written out, so that every engine agrees on it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the code points of the property White_Space, as a character class body.
SPACE = r"\x{9}-\x{d} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Characters that end a sentence if white space follows.
SENTENCE_ENDS = ".!?。！？\\n"
CHARS_PER_TOKEN = 4


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]", "")


def tokens(text: Column) -> Column:
    """A quarter of the code points, rounded up."""
    return F.ceil(F.char_length(text) / F.lit(CHARS_PER_TOKEN)).cast("bigint")


def sentences(text: Column) -> Column:
    """Trimmed sentences that aren't empty; an end mark must be followed by white space. Null for null."""
    cut = F.split(F.regexp_replace(text, f"([{SENTENCE_ENDS}])[{SPACE}]+", "$1\x01"), "\x01")
    return F.filter(F.transform(cut, trim), lambda s: s != "")


def windows(text: Column, chars: int) -> Column:
    """The text in pieces of `chars` code points."""
    last = F.greatest(F.ceil(F.char_length(text) / F.lit(chars)).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * chars + 1, F.lit(chars)))


def pack(parts: Column, budget: int) -> Column:
    """Greedy chunks of sentences of at most `budget` tokens, joined by a space that doesn't count.

    A sentence beyond the budget is cut into windows of budget * 4 code points. The fold appends to an array, so very
    long documents cost the square of their chunks; `operators.translate.chunks` packs them this way too.
    """
    state = F.struct(
        F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).cast("bigint").alias("used")
    )

    def close(acc: Column) -> Column:
        return F.when(F.size(acc["open"]) > 0, F.array_append(acc["done"], F.array_join(acc["open"], " "))).otherwise(acc["done"])

    def made(done: Column, open_: Column, used: Column) -> Column:
        return F.struct(done.alias("done"), open_.alias("open"), used.cast("bigint").alias("used"))

    def step(acc: Column, s: Column) -> Column:
        n = tokens(s)
        none = F.array().cast("array<string>")
        return (
            F.when(n > budget, made(F.concat(close(acc), windows(s, budget * CHARS_PER_TOKEN)), none, F.lit(0)))
            .when((F.size(acc["open"]) > 0) & (acc["used"] + n > budget), made(close(acc), F.array(s), n))
            .otherwise(made(acc["done"], F.array_append(acc["open"], s), acc["used"] + n))
        )

    return F.aggregate(parts, state, step, close)


def lines(text: Column) -> Column:
    """Lines without their ends; a last empty one doesn't count."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n"))


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, with single spaces, that aren't empty."""
    return F.filter(F.transform(F.split(text, "\n\n"), squeeze), lambda p: p != "")


def first_line(text: Column) -> Column:
    return trim(F.element_at(F.split(text, "\n"), 1))


def other_lines(text: Column) -> Column:
    """What follows the first line, trimmed; null if nothing does."""
    at = F.instr(text, "\n")
    rest = trim(F.substring(text, at + 1, F.char_length(text)))
    return F.when((at > 0) & (rest != ""), rest)


def escape(text: Column) -> Column:
    """The five characters of XML."""
    for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(reference))
    return text


def match_text(text: Column) -> Column:
    return F.lower(without_space(text))


def is_close(a: Column, b: Column) -> Column:
    """One holds the other and is at least four fifths as long in bytes; both as match_text."""
    low, high = F.least(F.octet_length(a), F.octet_length(b)), F.greatest(F.octet_length(a), F.octet_length(b))
    return (low * 5 >= high * 4) & (F.contains(a, b) | F.contains(b, a))


def cache_key(provider: Column, text: Column) -> Column:
    return F.sha2(F.concat(provider, F.lit(":"), text), 256)


def short_hash(text: Column) -> Column:
    """The first 16 hexadecimal digits of a SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def job_key(path: Column, lang: Column, mode: Column, provider: Column, model: Column) -> Column:
    return short_hash(F.concat_ws("|", path, short_hash(F.concat_ws("|", lang, mode, provider, model))))


#: What counts as a sign of garbled text, and as punctuation.
ODD = "�〓▯□■●▪▫\\x{0}-\\x{8}\\x{e}-\\x{1f}\\x{7f}-\\x{84}\\x{86}-\\x{9f}"
SIGNS = "!-/:-@\\x{5b}-`\\x{7b}-~。，、；：？！“”‘’（）《》—…"


def anomaly(text: Column) -> Column:
    """0 to 1: 1.5 of the share of odd characters, 0.8 of that in runs of four or more, and that of signs up to a half."""
    n = F.char_length(text)
    odd = n - F.char_length(F.regexp_replace(text, f"[{ODD}]", ""))
    signs = n - F.char_length(F.regexp_replace(text, f"[{SIGNS}]", ""))
    runs = F.aggregate(F.regexp_extract_all(text, F.lit(r"(?s)(.)\1{3,}"), F.lit(0)), F.lit(0), lambda a, x: a + F.char_length(x))
    score = odd / n * 1.5 + runs / n * 0.8 + F.least(signs / n, F.lit(0.5))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(score, F.lit(1.0)))


#: Formats by the suffix of a path.
FORMATS = {"epub": "epub", "mobi": "mobi", "azw": "mobi", "azw3": "mobi", "prc": "mobi", "txt": "text", "text": "text", "srt": "srt", "docx": "docx"}


def book_format(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*\.([^./\\]+)$", 1))
    out = None
    for key, name in FORMATS.items():
        out = F.when(suffix == key, name) if out is None else out.when(suffix == key, name)
    return out


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def output_name(pattern: Column, path: Column, source: Column, target: Column, mode: Column) -> Column:
    """The pattern with its fields filled in; a blank one is stem_target."""
    filled = pattern
    for field, value in (("{stem}", stem(path)), ("{source_lang}", source), ("{target_lang}", target), ("{output_mode}", mode)):
        filled = F.replace(filled, F.lit(field), value)
    return F.when(trim(F.coalesce(pattern, F.lit(""))) == "", F.concat_ws("_", stem(path), target)).otherwise(filled)


def locale(text: Column) -> Column:
    """zh_CN.UTF-8 as zh-CN."""
    return F.replace(F.element_at(F.split(text, "\\."), 1), F.lit("_"), F.lit("-"))


def clean_href(href: Column) -> Column:
    """Without a leading slash and one container folder; index.xhtml if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(href, "^/+", ""), "^(?:OEBPS|EPUB)/", "")
    return F.when(bare == "", "index.xhtml").otherwise(bare)


def manifest_id(href: Column) -> Column:
    out = F.regexp_replace(href, r"[^\p{L}\p{N}\-._]", "_")
    return F.when(out.rlike("^[0-9]") | (out == ""), F.concat(F.lit("i"), out)).otherwise(out)


def duration(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def elapsed(start: Column, end: Column) -> Column:
    """Whole seconds between two times in seconds, at least 0; a start that is missing is the end."""
    return F.greatest(F.floor(end - F.coalesce(start, end)), F.lit(0))


def file_name(path: Column) -> Column:
    """What follows the last slash of either kind; the path itself if nothing does."""
    last = F.element_at(F.split(path, r"[\\\\/]"), -1)
    return F.when(last == "", path).otherwise(last)


def comma_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), trim), lambda x: x != "")


def strip_json_comments(text: Column) -> Column:
    return F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|//[^\n]*|(?s:/\*.*?\*/)', "$1")


def strip_fences(text: Column) -> Column:
    return trim(F.regexp_replace(trim(text), r"^```[A-Za-z]*[ \t]*\n?|\n?```$", ""))


def answer_text(json: Column) -> Column:
    """The text of a chat, completion, message or content-list answer, whichever the JSON holds."""
    return F.coalesce(*[F.get_json_object(json, p) for p in ("$.choices[0].message.content", "$.choices[0].text", "$.content[0].text", "$.message.content", "$.text")])


def fill_prompt(template: Column, source: Column, target: Column, glossary: Column) -> Column:
    """A prompt with its languages (auto is the original one) and the glossary's lines, if there are any."""
    named = F.when(source == "auto", "the original language").otherwise(source)
    return F.concat(F.replace(F.replace(template, F.lit("{source_lang}"), named), F.lit("{target_lang}"), target), glossary)


def glossary_lines(entries: Column) -> Column:
    """entries: ARRAY<STRUCT<.., term, translation>>, in order."""
    joined = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("- "), e["term"], F.lit(" => "), e["translation"])), "\n")
    return F.when(F.size(entries) > 0, F.concat(F.lit("\nUse the following glossary:\n"), joined, F.lit("\n"))).otherwise("")


def source_budget(max_in: Column, max_out: Column, prompt_tokens: Column, margin: int = 50) -> Column:
    """Tokens left for the text: what the prompt and a margin leave of the input, 200 less than the output, at least 1."""
    left = F.greatest(max_in - prompt_tokens - margin, F.lit(0))
    return F.greatest(F.least(left, F.greatest(max_out - 200, F.lit(0))), F.lit(1))
