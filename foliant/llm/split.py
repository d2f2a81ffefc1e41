"""Problem 3: pieces of oversized texts, cut at natural boundaries, with overlap.

One bounded-quantifier pattern per row, built from the row's limit: its alternatives consume up to the limit, the
strongest boundary first (end of text, paragraph, sentence, word, none of them inside a tag or reference), then any characters. SQL array functions then put
the end of each piece before the next one. All of it is built-in expressions; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
DEFAULT_LIMIT = 4000

#: What stands directly before a cut between paragraphs, sentences and words (Java look-behinds, bounded).
PARAGRAPH = r"(?<=\n[ \t]{0,8}\r?\n|</(?:p|li|ul|ol|dl|dt|dd|h[1-6]|div|pre|table|tr|td|th|blockquote|section|figure)>\s{0,8}|<(?:br|hr)\s?/?>)"
SENTENCE = r"(?<=[.!?…][\"'”’»)\]]{0,3}\s{1,4}|[。！？][\"'”’»」』）]{0,3}|\n)"
WORD = r"(?<=\s)(?=\S)"
#: No cut between these falls inside a tag or a character reference (of bounded length), unless nothing else is left.
OUTSIDE = r"(?<!<[^<>]{0,300})(?<!&[#\w]{0,10})"


def tokens(text: Column) -> Column:
    """A quarter of the code points, rounded up; null for null."""
    return F.ceil(F.char_length(text) / F.lit(CHARS_PER_TOKEN)).cast("int")


def limit_of(max_tokens: Column) -> Column:
    """A null or non-positive limit is DEFAULT_LIMIT."""
    return F.when(max_tokens > 0, max_tokens).otherwise(F.lit(DEFAULT_LIMIT)).cast("int")


def overlap_of(overlap: Column, limit: Column) -> Column:
    """Null or negative is 0; at most limit - 1, so that every piece holds something new."""
    return F.greatest(F.lit(0), F.least(F.coalesce(overlap, F.lit(0)), limit - 1)).cast("int")


def pieces_of(text: Column, limit: Column, overlap: Column) -> Column:
    """ARRAY<STRUCT<piece, overlap_chars>> of a text: cut without loss, each piece at most limit * 4 code points.

    The first piece may fill the whole limit; later ones hold overlap * 4 code points of the piece before them (all of
    it, if it is shorter), then new text. Joining the pieces without their first overlap_chars code points gives the
    text back. A null text gives null, an empty one an empty array.
    """
    room = ((limit - overlap) * CHARS_PER_TOKEN).cast("string")
    take = F.concat(F.lit(".{1,"), room, F.lit("}"))
    pattern = F.concat(
        F.lit("(?s)"), take, F.lit(r"\z|"), *[x for way in (PARAGRAPH, SENTENCE, WORD, "") for x in (take, F.lit(way + OUTSIDE + "|"))], take
    )
    bodies = F.regexp_extract_all(text, pattern, F.lit(0))
    keep = overlap * CHARS_PER_TOKEN
    start = F.struct(
        F.array().cast("array<struct<piece:string,overlap_chars:int>>").alias("done"), F.lit("").alias("tail")
    )

    def step(acc: Column, body: Column) -> Column:
        whole = F.concat(acc["tail"], body)
        piece = F.struct(whole.alias("piece"), F.char_length(acc["tail"]).cast("int").alias("overlap_chars"))
        tail = F.when(keep > 0, F.substring(whole, F.greatest(F.char_length(whole) - keep + 1, F.lit(1)), keep)).otherwise("")
        return F.struct(F.array_append(acc["done"], piece).alias("done"), tail.alias("tail"))

    return F.aggregate(bodies, start, step, lambda acc: acc["done"])


def split_chapters(chapters: DataFrame, jobs: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """(job_id, book_id, idx, piece_no, n_pieces, piece, piece_tokens, overlap_chars): all pieces of oversized chapters.

    chapters: (book_id, idx, content BINARY); jobs: (job_id, book_id, max_input_tokens, overlap_tokens). Repeated rows
    count once; rows with a null key or null content give nothing; empty tables give no rows. Chapters within the limit
    give no pieces. Jobs are broadcast up to `broadcast_rows` of them (counted), else joined by a shuffle.
    """
    limit = limit_of(F.col("max_input_tokens"))
    jobs = (
        jobs.select("job_id", "book_id", limit.alias("limit"), overlap_of(F.col("overlap_tokens"), limit).alias("overlap"))
        .where("job_id is not null and book_id is not null")
        .dropDuplicates(["job_id"])
    )
    texts = chapters.where("book_id is not null and idx is not null and content is not null").select(
        "book_id", "idx", F.make_valid_utf8(F.col("content").cast("string")).alias("text")
    ).withColumn("n", tokens(F.col("text")))
    if jobs.count() <= broadcast_rows:
        jobs = F.broadcast(jobs)
    # repeated rows are dropped after the limit's test, so that only oversized texts are shuffled
    return (
        texts.join(jobs, "book_id")
        .where(F.col("n") > F.col("limit"))
        .dropDuplicates(["job_id", "idx"])
        .select("job_id", "book_id", "idx", pieces_of(F.col("text"), F.col("limit"), F.col("overlap")).alias("all"))
        .select("job_id", "book_id", "idx", F.size("all").alias("n_pieces"), F.posexplode("all").alias("piece_no", "p"))
        .select(
            "job_id", "book_id", "idx", "piece_no", "n_pieces", F.col("p.piece").alias("piece"),
            tokens(F.col("p.piece")).alias("piece_tokens"), F.col("p.overlap_chars").alias("overlap_chars"),
        )
    )


def oversized(pieces: DataFrame) -> DataFrame:
    """(job_id, idx) of what was cut: chapters with a second piece."""
    return pieces.where("piece_no = 1").select("job_id", "idx").distinct()
