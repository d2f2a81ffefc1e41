"""Book files: reading what is written, and files that can't be read."""

import io
import struct
import zipfile

from pyspark.sql import functions as F

from foliant.sources import book as K
from foliant.sources import srt


def docx(paragraphs):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}<w:tbl/></w:body></w:document>")
    return out.getvalue()


def mobi(text):
    head = struct.pack(">HHLHHH", 1, 0, len(text), 1, 4096, 0) + b"\0\0"
    records = [head, text]
    at, index = 78 + 8 * len(records), b""
    for r in records:
        index += struct.pack(">LL", at, 0)
        at += len(r)
    return b"name".ljust(60, b"\0") + b"TEXtREAd" + b"\0" * 8 + struct.pack(">H", len(records)) + index + b"".join(records)


def test_epub_round_trip():
    data = K.epub_bytes("T & U", "de", None, [("/OEBPS/a.xhtml", "One", b"<p>1</p>"), ("b.xhtml", None, b"<p>2</p>")], [("data.bin", "application/x-own", b"\0")])
    assert data == K.epub_bytes("T & U", "de", None, [("/OEBPS/a.xhtml", "One", b"<p>1</p>"), ("b.xhtml", None, b"<p>2</p>")], [("data.bin", "application/x-own", b"\0")])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    b = K.read_epub(data)
    assert (b.title, b.language) == ("T & U", "de")
    assert b.chapters == [("OEBPS/a.xhtml", "One", b"<p>1</p>"), ("OEBPS/b.xhtml", "Untitled", b"<p>2</p>")]
    assert b.resources == [("OEBPS/data.bin", "application/x-own", b"\0")]


def test_ids_differ():
    used = set()
    assert [K.unique(K.id_of(h), used) for h in ("a b", "a_b", "a_b_2", "1")] == ["a_b", "a_b_2", "a_b_2_2", "i1"]


def test_source_reads_every_format(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(K.epub_bytes("A", "en", "id", [("c.xhtml", "C", b"<p>x</p>")], [("r.css", "text/css", b"p{}")]))
    (tmp_path / "b.txt").write_text("Line <one>\nLine two\n")
    (tmp_path / "c.srt").write_text("1\r\n00:00:01,000 --> 00:00:02,000\r\nHi\r\nthere\r\n\r\nbad\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\n< & \"\r\n")
    (tmp_path / "d.docx").write_bytes(docx(["First", " ", "Second"]))
    (tmp_path / "e.mobi").write_bytes(mobi(b"<p>mobi text</p>"))
    (tmp_path / "f.epub").write_bytes(b"not a zip")
    (tmp_path / "g.xyz").write_bytes(b"?")
    spark.dataSource.register(K.BookSource)
    rows = {r["book_id"]: r for r in spark.read.format("book").load(str(tmp_path)).collect()}
    text = {k: bytes(r["content"]).decode() for k, r in rows.items() if r["content"] is not None}
    assert "<p>Line &lt;one&gt;</p>\n<p>Line two</p>" in text["b"] and text["c"].count("srt-entry") == 2 and "&lt; &amp; &quot;" in text["c"]
    assert "<p>First</p>\n<p>Second</p>" in text["d"] and "<p>mobi text</p>" in text["e"]
    assert rows["f"]["error"] and "unsupported" in rows["g"]["error"] and rows["a"]["title"] == "C"
    res = spark.read.format("book").option("kind", "resources").load(str(tmp_path)).collect()
    assert [(r["href"], r["mime"]) for r in res] == [("OEBPS/r.css", "text/css")]
    books = spark.createDataFrame([("a", "A2", None, None)], "book_id string, title string, language string, identifier string")
    made = K.epubs(spark.read.format("book").load(str(tmp_path / "a.epub")), books).first()
    assert K.read_epub(bytes(made["data"])).title == "A2"


def test_palmdoc():
    assert K.unpack_palmdoc(b"abc" + bytes([0x80, 0x18]) + bytes([0xC1])) == b"abcabc A"


def test_wrapping():
    assert K.as_xhtml("<?xml version='1.0'?><html/>", "t").startswith("<?xml version='1.0'?><html/>")
    assert K.as_xhtml("<html></html>", "t").startswith("<?xml") and "<p>a &amp; b</p>" in K.as_xhtml("a & b", "t")


def test_cues(spark):
    text = "1\n00:00:01,000 --> 00:00:02,000\na\nb\n\n2\n00:00:03,000 -> x\nc\n\nx\n00:00:03,000 --> 00:00:04,000\nc\n\n3\n00:00:05,000 --> 00:00:06,000\nd"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(srt.cues(F.col("t")).alias("c")).collect()
    assert [(c["idx"], c["text"]) for c in got[0]["c"]] == [(1, "a\nb"), (3, "d")] and got[1]["c"] is None and got[2]["c"] == []
    assert [(r[0], r[3]) for r in K.parse_srt(text)] == [(1, "a\nb"), (3, "d")]
