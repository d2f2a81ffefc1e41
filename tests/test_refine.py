"""Second passes: answers, matches and fixpoints."""

from foliant.functions import html_tree as H
from foliant.operators import refine as R


def test_plain_blocks():
    text = "# Title\nline one\nline two\n\n1.1 Sub\n[12]\nFig 1 shows\nrest."
    assert R.plain_blocks(text) == [("heading", "Title"), ("paragraph", "line one line two"), ("subheading", "1.1 Sub"), ("caption", "Fig 1 shows"), ("paragraph", "rest.")]
    assert R.plain_blocks("") == []


def test_loose_json():
    assert R.loose_json('{"a": 1}') == {"a": 1} and R.loose_json('"{\\"a\\": 1}"') == {"a": 1}
    assert R.loose_json('Sure: {"a": "}"} and more') == {"a": "}"} and R.loose_json("```json\n{}\n```") == {}
    assert R.loose_json("{broken {\"b\": 2}") == {"b": 2} and R.loose_json("none") is None and R.loose_json("[1]") is None


def test_match():
    assert R.match(["1.1  Details", "b c", "x"], ["1.1 Details", "b", "c", "y"]) == [(0, 0), (1, 2), None]
    assert R.match(["same", "same"], ["same", "same"]) == [(0, 0), (1, 1)]
    assert R.match(["abcdefghij"], ["abcdefghijk"]) == [(0, 0)] and R.match([""], [""]) == [None]


def test_crop():
    assert R.crop_box((10, 10, 20, 20), 2.0, 100, 100) == (0, 0, 40, 40)
    assert R.crop_box((90, 90, 20, 20), 1.0, 100, 100) == (90, 90, 10, 10)


def test_pages(spark):
    kind = "book_id string, page_number int, block_ix int, text string, confidence float, bbox struct<x:int,y:int,w:int,h:int>"
    old = spark.createDataFrame([("b", 1, 0, "Hello", 0.5, (1, 1, 5, 5)), ("b", 1, 1, "world", 0.9, (10, 1, 5, 9)), ("b", 2, 0, "x", None, None)], kind)
    new = spark.createDataFrame([("b", 1, 0, "hello world"), ("b", 2, 0, "other"), ("b", 3, 0, "lost")], "book_id string, page_number int, block_ix int, text string")
    got = {r["page_number"]: r for r in R.carry_over(new, old).collect()}
    assert (got[1]["first_ix"], got[1]["last_ix"], got[1]["x"], got[1]["w"], got[1]["h"]) == (0, 1, 1, 14, 9) and abs(got[1]["confidence"] - 0.9) < 1e-6
    assert got[2]["first_ix"] is None and got[3]["first_ix"] is None
    typed = old.selectExpr("*", "if(block_ix = 0, 'heading', null) block_type")
    rows = R.to_fixpoint(typed, lambda: lambda blocks, k: [(t + "!" if k < 3 else t, kind if k < 4 else "caption") for t, kind in blocks], 5).orderBy("page_number", "block_ix").collect()
    assert [(r["text"], r["rounds"]) for r in rows] == [("Hello!!", 3), ("world!!", 3), ("x!!", 3)]
    rows = R.to_fixpoint(typed, lambda: lambda blocks, k: [(t, "caption" if k > 0 else kind) for t, kind in blocks], 5).collect()
    assert {(r["block_type"], r["rounds"]) for r in rows} == {("caption", 2)}  # a change of types only is one, too


def test_documents(spark):
    df = spark.createDataFrame([(1, bytearray(b"<p>One two</p>")), (2, None)], "k int, content binary")
    got = {r["k"]: r["content"] for r in H.bilingual_documents(df, ["k"], str.upper, "interleaved", "en", "de").collect()}
    assert got == {1: '<p lang="en">One two</p><p lang="de">ONE TWO</p>', 2: None}
    assert H.with_font("<html><head></head></html>", "Serif") == "<html><head><style>body { font-family: Serif; }</style></head></html>"
    assert H.with_font("<html><p/></html>", "S").startswith("<html><style>")
