"""Pieces of oversized texts: exact round trips, limits, boundaries, and the SQL rule."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm import split

JOBS = "job_id string, book_id string, max_input_tokens int, overlap_tokens int"
CHAPTERS = "book_id string, idx int, content binary, job_id string, text string"


def pieces(spark, rows):
    df = spark.createDataFrame(rows, "k int, text string, lim int, ov int")
    got = df.select("k", "text", "lim", "ov", split.pieces_of(F.col("text"), F.col("lim"), split.overlap_of(F.col("ov"), F.col("lim"))).alias("p")).orderBy("k").collect()
    return [(r["text"], r["lim"], r["p"]) for r in got]


def check(text, limit, made, overlap):
    assert "".join(p["piece"][p["overlap_chars"] :] for p in made) == text
    assert all(len(p["piece"]) <= limit * 4 for p in made)
    for a, b in zip(made, made[1:]):
        want = min(len(a["piece"]), overlap * 4)
        assert b["overlap_chars"] == want and b["piece"][:want] == a["piece"][len(a["piece"]) - want :]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.text("ab .\n。<p>/\U0001f600é", max_size=300), st.integers(2, 20), st.integers(0, 25)), min_size=10, max_size=20))
def test_round_trip(spark, rows):
    for (text, limit, made), (_, _, ov) in zip(pieces(spark, [(k, *r) for k, r in enumerate(rows)]), rows, strict=True):
        check(text, limit, made, min(ov, limit - 1))


def test_boundaries(spark):
    text = "<p>One two three.</p><p>Four five six. Seven eight</p>"
    (_, _, a), = pieces(spark, [(0, text, 9, 0)])
    assert [p["piece"] for p in a] == ["<p>One two three.</p>", "<p>Four five six. Seven eight</p>"]
    (_, _, b), = pieces(spark, [(0, "One two. Three four five six", 5, 0)])
    assert [p["piece"] for p in b] == ["One two. ", "Three four five six"]
    (_, _, c), = pieces(spark, [(0, "aaaa bbbb cccc", 2, 0)])
    assert [p["piece"] for p in c] == ["aaaa ", "bbbb ", "cccc"]
    (_, _, d), = pieces(spark, [(0, "x" * 20, 2, 1)])
    check("x" * 20, 2, d, 1)
    assert pieces(spark, [(0, None, 2, 0), (1, "", 2, 0)])[0][2] is None


def test_long_text(spark):
    text = "word " * 20_000
    (_, _, made), = pieces(spark, [(0, text, 50, 10)])
    check(text, 50, made, 10)


def test_chapters_and_jobs(spark):
    big, small = bytearray(("A sentence here. " * 100).encode()), bytearray(b"short")
    chapters = spark.createDataFrame(
        [("b", 0, big, "x", "x"), ("b", 0, big, "x", "x"), ("b", 1, small, "x", "x"), ("b", 2, None, "x", "x"), (None, 3, big, "x", "x"), ("c", 0, big, "x", "x"), ("b", 4, bytearray(b"\xff" * 5000), "x", "x")], CHAPTERS
    )
    jobs = spark.createDataFrame([("j", "b", 100, 10), ("j", "b", 100, 10), ("k", "b", 0, None), ("m", "b", None, -5), ("n", "zzz", 10, 1), (None, "b", 1, 1)], JOBS)
    made = split.split_chapters(chapters, jobs)
    assert sorted(map(tuple, split.oversized(made).collect())) == [("j", 0), ("j", 4)] + [(j, i) for j in () for i in ()]
    assert made.where("piece_tokens > 100").count() == 0
    other = split.split_chapters(chapters, jobs, broadcast_rows=0)  # the way without a broadcast
    assert sorted(map(tuple, other.collect())) == sorted(map(tuple, made.collect()))
    assert split.split_chapters(chapters.limit(0), jobs).count() == 0 and split.split_chapters(chapters, jobs.limit(0)).count() == 0


def test_no_cut_inside_a_tag_or_reference(spark):
    text = '<p class="alpha beta. gamma delta epsilon zeta">One two three four five six.</p> Fish &amp; chips &#12345; and more words here.' + '<img src="x" alt="A. B. C. D"/>' * 3 + "&amp;" * 40
    for limit in (7, 13, 16, 20):
        row = spark.createDataFrame([(text,)], "t string").select(split.pieces_of(F.col("t"), F.lit(limit), F.lit(0)).alias("p")).first()["p"]
        pieces = [x["piece"] for x in row]
        assert "".join(pieces) == text and all(len(x) <= 4 * limit for x in pieces)
        at, ends = 0, []
        for x in pieces[:-1]:
            at += len(x)
            ends.append(at)
        inside = [e for e in ends if text[:e].rfind("<") > text[:e].rfind(">")]
        assert not [e for e in ends if "&" in text[max(0, e - 8) : e] and ";" not in text[text[:e].rfind("&") : e]]
        assert not inside or limit * 4 < 49  # the first tag alone is longer than such a limit
    plain = "a < b and so on " * 40
    row = spark.createDataFrame([(plain,)], "t string").select(split.pieces_of(F.col("t"), F.lit(5), F.lit(1)).alias("p")).first()["p"]
    assert "".join(x["piece"][x["overlap_chars"] :] for x in row) == plain
