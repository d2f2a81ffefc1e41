"""Books of recognised pages, figures cut out, pages rendered, and settings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import settings as S
from foliant.operators import bookmaking as M
from foliant.operators import ocr, refine, toc
from foliant.sources import book, render

BLOCKS = "book_id string, page_number int, block_ix int, text string, block_type string, bbox struct<x:int,y:int,w:int,h:int>, title string"


def test_chapters(spark):
    rows = [
        ("a", 1, 0, "A preamble.", "paragraph", None), ("a", 1, 1, "1 Start\nIt begins.", "heading", None), ("a", 1, 2, "1.1 Below", "heading", None), ("a", 1, 3, "fig.png", "image", None),
        ("a", 1, 4, "Fig 1\n\nMore & more.", "caption", None), ("a", 1, 5, "one", "table_cell", None), ("a", 2, 0, "two", "table_cell", None), ("a", 2, 1, "2 Next", "heading", None),
        ("a", 2, 2, "x\ny", "other", None), ("a", 2, 3, "| a | b | |---|---| | 1 | <2> |", "paragraph", None), ("b", 1, 0, "No heading", None, None), (None, 1, 0, "x", "heading", None), ("b", 1, 1, None, "heading", None),
    ]
    made = {(r["book_id"], r["idx"]): r for r in M.chapters(spark.createDataFrame([(*r, "clash") for r in rows], BLOCKS)).collect()}
    assert [(k, r["href"], r["title"]) for k, r in sorted(made.items())] == [(("a", 0), "chapter001.xhtml", "1 Start"), (("a", 1), "chapter002.xhtml", "2 Next"), (("b", 0), "chapter001.xhtml", "Chapter")]
    body = made["a", 0]["content"].split("<body>\n")[1]
    assert body.startswith("<p>A preamble.</p>\n<h1>1 Start</h1>\n<p>It begins.</p>\n<h2>1.1 Below</h2>\n")
    assert '<figure><img src="fig.png" alt="figure"/><figcaption>Fig 1</figcaption>\n<p>More &amp; more.</p></figure>\n<table>\n  <tr><td>one</td></tr>\n</table>\n<table>' in body and body.count("Fig 1") == 1
    second = made["a", 1]["content"]
    assert "<figure><pre>x\ny</pre></figure>" in second and "<tr><th>a</th><th>b</th></tr>" in second and "<tr><td>1</td><td>&lt;2&gt;</td></tr>" in second
    assert M.chapters(spark.createDataFrame([], BLOCKS)).count() == 0


def test_tables_by_place_and_by_column(spark):
    box = lambda x, y: (x, y, 40, 20)
    placed = [("a", 1, k, t, "table_cell", box(x, y)) for k, (t, x, y) in enumerate([("b", 100, 12), ("a", 0, 10), ("d", 100, 50), ("c", 0, 55)])]
    flat = [("a", 2, k, str(k), "table_cell", box(10 + 300 * (k % 3), 5)) for k in range(6)]
    t = ocr.table_runs(spark.createDataFrame([(*r, "x") for r in placed + flat], BLOCKS)).select("page_number", M.table_html(F.col("cells")).alias("h"), ocr.grid_of(F.col("cells")).alias("g"))
    got = {r["page_number"]: r for r in t.collect()}
    assert got[1]["h"] == "<table>\n  <tr><td>a</td><td>b</td></tr>\n  <tr><td>c</td><td>d</td></tr>\n</table>" and got[1]["g"] is None
    assert got[2]["h"].count("<tr>") == 2 and got[2]["g"] == 3


@pytest.mark.parametrize(("text", "rows"), [("| a | | b |", None), ("text", None), ("| a |\n| b |", None), ("| a |\n|:-:|\n| 1 |\n| 2 |\nend | x |", 3), ("", None)])
def test_markdown(spark, text, rows):
    html = spark.createDataFrame([(text,)], "t string").select(M.markdown_html(F.col("t")).alias("h")).first()["h"]
    assert (html is None) if rows is None else html.count("<tr>") == rows


def test_figures_are_cut_out(spark):
    draw = np.random.default_rng(1)
    for colour, n in ((0, 1), (2, 3), (6, 4)):
        pixels = draw.integers(0, 256, (60, 50, n)).astype(np.uint8)
        again, kind = M.read_png(M.write_png(pixels, colour))
        assert (again == pixels).all() and kind == colour
    import struct
    import zlib

    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    lines = bytes([1, 5, 1, 1, 2, 1, 1, 1, 3, 4, 4, 4, 4, 1, 1, 1])  # rows filtered by left, above, mean and best of three
    read, _ = M.read_png(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 3, 4, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b""))
    assert read[..., 0].tolist() == [[5, 6, 7], [6, 7, 8], [7, 11, 13], [8, 12, 14]]
    rows = [("a", 4, 0, "big", "other", (5, 10, 20, 30)), ("a", 4, 1, "small", "other", (5, 10, 19, 30)), ("a", 9, 0, "next", "other", (900, 0, 30, 30)), ("a", 9, 1, "none", "other", None)]
    blocks = spark.createDataFrame([(*r, "x") for r in rows], BLOCKS)
    named = M.figures(blocks)
    assert sorted((r["page_number"], r["href"]) for r in named.collect()) == [(4, "figure-000-001.png"), (9, "figure-001-002.png")]
    assert [(r["text"], r["block_type"]) for r in M.with_figures(blocks, named).orderBy("page_number", "block_ix").collect()][0] == ("figure-000-001.png", "image")
    pixels = draw.integers(0, 256, (60, 50, 3)).astype(np.uint8)
    images = spark.createDataFrame([("a", 4, bytearray(M.write_png(pixels, 2))), ("a", 9, bytearray(b"no png"))], "book_id string, page_number int, image binary")
    got = {r["href"]: r for r in M.cut_out(named, images).collect()}
    assert (M.read_png(bytes(got["figure-000-001.png"]["data"]))[0] == pixels[10:40, 5:25]).all() and "PNG" in got["figure-001-002.png"]["error"]


def test_pages_are_rendered(spark, tmp_path):
    tool = tmp_path / "tool"
    tool.write_text("#!/bin/sh\ncat > /dev/null\nif [ $5 -gt 2 ]; then exit 99; fi\nprintf \"page $5 at $3\"\n")
    tool.chmod(0o755)
    pdfs = spark.createDataFrame([("a", bytearray(b"%PDF")), ("b", None)], "book_id string, content binary")
    got = [(r["page_number"], bytes(r["image"]).decode()) for r in render.render_pages(pdfs, 72, tool=str(tool)).collect()]
    assert got == [(1, "page 1 at 72"), (2, "page 2 at 72")]
    assert [bytes(r["image"]) for r in render.render_pages(pdfs, page=2, tool=str(tool)).collect()] == [b"page 2 at 200"]
    assert render.render_pages(pdfs, tool="no-such-tool").first()["error"] and not render.available("no-such-tool")


def test_files_of_any_file_system(spark, tmp_path):
    books = spark.createDataFrame([("a", "A & B", "de", "i"), ("c", "C", None, None)], "book_id string, title string, language string, identifier string")
    chapters = spark.createDataFrame([("a", 1, "b.xhtml", None, bytearray(b"<p>2</p>")), ("a", 0, "a.xhtml", "One", bytearray(b"<p>1</p>")), ("a", 0, "a.xhtml", "One", bytearray(b"<p>1</p>"))], "book_id string, idx int, href string, title string, content binary")
    resources = spark.createDataFrame([("a", "img/x.png", "image/png", bytearray(b"x")), ("z", "y", "m", bytearray(b"y"))], book.RESOURCES)
    made = book.epubs(chapters, books, resources).collect()
    assert [r["book_id"] for r in made] == ["a"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "my book.epub").write_bytes(bytes(made[0]["data"]))
    (tmp_path / "in" / "broken.epub").write_bytes(b"no zip")
    (tmp_path / "in" / "other.xyz").write_bytes(b"?")
    files = book.files(spark, str(tmp_path))
    got = {(r["book_id"], r["idx"]): r for r in book.read_chapters(files).collect()}
    assert set(got) == {("my book", 0), ("my book", 1), ("broken", None)} and got["my book", 0]["title"] == "One" and got["broken", None]["error"]
    assert [tuple(r)[:3] for r in book.read_resources(files).collect()] == [("my book", "OEBPS/img/x.png", "image/png")]


def test_setting_rules(spark):
    cases = [("http://a.b", None), ("HTTPS://a.b/c?d", None), ("ftp://a", "scheme"), ("a.b", "no url"), ("", "no url"), ("http://", "no url"), ("http:// x", "no url")]
    got = spark.createDataFrame(cases, "u string, want string").select("want", S.url_problem(F.col("u")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got), got
    row = spark.sql("select '' source, 'o' output, 'OpenAI' provider, ' ' model, 0 concurrency, 2.5 temperature, array('a', '') exclude_selectors, '' api_key, false dry_run, false source_exists")
    assert [(p["field"], p["problem"]) for p in row.select(S.checks(row.columns).alias("p")).first()["p"]] == [
        ("source", "empty"), ("source_exists", "missing"), ("model", "empty"), ("api_key", "required"), ("concurrency", "not positive"), ("temperature", "out of range"), ("exclude_selectors", "empty entry"),
    ]
    for text, want in (("en_GB", "en"), ("zh_CN", "zh-CN"), ("zh", "zh-CN"), ("fr", "en"), (None, "en"), ("KO-kr", "ko")):
        assert spark.createDataFrame([(text,)], "t string").select(S.interface_locale(F.col("t")).alias("l")).first()["l"] == want
    with pytest.raises(ValueError):
        toc.is_running_text(F.col("href"), ("(",))


def test_answers_become_blocks(spark):
    rows = [(1, "# Head\n\nOne\ntwo\n[img]\nFig 1"), (2, 'x {"blocks": [{"text": "t", "block_type": "caption"}, {"text": "第1章"}, {"no": 1}]} y'), (3, '{"other": 1}'), (4, None), (5, "")]
    got = [tuple(r) for r in refine.parse_answers(spark.createDataFrame(rows, "page_id int, answer string"), ["page_id"], "answer").orderBy("page_id", "part").collect()]
    assert got[:3] == [(1, 0, "heading", "Head"), (1, 1, "paragraph", "One two"), (1, 2, "caption", "Fig 1")] and [g[2] for g in got if g[0] == 2] == ["caption", "heading"]
    assert [g for g in got if g[0] == 3] == [(3, 0, "paragraph", '{"other": 1}')] and not [g for g in got if g[0] > 3]
    b = spark.createDataFrame([((10, 10, 20, 40), 100, 60), (None, 1, 1)], "bbox struct<x:int,y:int,w:int,h:int>, page_width int, page_height int")
    crops = [r["crop"] for r in refine.crops(b, 1.5).collect()]
    assert tuple(crops[0]) == refine.crop_box((10, 10, 20, 40), 1.5, 100, 60) and crops[1] is None


def test_work_can_be_cancelled(spark):
    import threading
    import time

    from foliant.session import cancellable

    with cancellable(spark, "test") as cancel:
        threading.Timer(2.0, cancel).start()
        start = time.time()
        with pytest.raises(Exception):  # noqa: B017
            spark.range(4).repartition(4).mapInPandas(lambda bs: (time.sleep(12) or b for b in bs), "id long").count()
        assert time.time() - start < 10
    assert spark.range(3).count() == 3
