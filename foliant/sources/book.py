"""Book files (EPUB, DOCX, MOBI, plain text, SRT) as tables, and a writer of EPUB files.

    read_chapters(files(spark, "hdfs:///books/"))           -> chapters
    read_resources(files(spark, "hdfs:///books/"))          -> images, styles and the rest
    spark.dataSource.register(BookSource)                   the same by name, over a folder that all executors see:
    spark.read.format("book").load("/books/*")              one partition per file

A file that can't be read gives a row with its error and no chapter.
"""

from __future__ import annotations

import glob
import hashlib
import io
import os
import posixpath
import re
import struct
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree
from xml.sax.saxutils import escape as _escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foliant.functions.text import FORMATS

CHAPTERS = "book_id string, idx int, href string, title string, content binary, book_title string, language string, identifier string, source_path string, source_hash string, error string"
RESOURCES = "book_id string, href string, mime string, data binary"


def xml(text: str) -> str:
    return _escape(text, {'"': "&quot;", "'": "&apos;"})


def page(body: str, title: str) -> str:
    return f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{xml(title)}</title></head><body>\n{body}\n</body></html>'


def as_xhtml(text: str, title: str) -> str:
    """A document stays one; a fragment is wrapped; plain text becomes paragraphs."""
    t = text.lstrip("﻿ \t\r\n")
    if t.startswith("<?xml"):
        return t
    if t[:5].lower() == "<html":
        return '<?xml version="1.0" encoding="utf-8"?>\n' + t
    return page(t if t.startswith("<") else "\n".join(f"<p>{xml(x)}</p>" for x in t.splitlines()), title)


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _find(root: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (e for e in root.iter() if _local(e) == name)


class Book:
    def __init__(self, title: str | None = None, language: str | None = None, identifier: str | None = None) -> None:
        self.title, self.language, self.identifier = title, language, identifier
        self.chapters: list[tuple[str, str | None, bytes]] = []
        self.resources: list[tuple[str, str, bytes]] = []


def read_epub(data: bytes) -> Book:
    """Chapters in the order of the spine with the labels of the table of contents; all else of the manifest as resources."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf_path = next(_find(container, "rootfile")).attrib["full-path"]
        base = posixpath.dirname(opf_path)
        opf = ElementTree.fromstring(z.read(opf_path))
        place = lambda href: posixpath.normpath(posixpath.join(base, unquote(href)))
        first = lambda name: next((e.text.strip() for e in _find(opf, name) if e.text and e.text.strip()), None)
        book = Book(first("title"), first("language"), first("identifier"))
        items = {e.attrib["id"]: (place(e.attrib["href"]), e.attrib.get("media-type", "")) for e in _find(opf, "item")}
        spine = [items[e.attrib["idref"]] for e in _find(opf, "itemref") if e.attrib.get("idref") in items]
        exact: dict[str, str] = {}
        inside: dict[str, str] = {}
        for href, mime in items.values():
            if mime == "application/x-dtbncx+xml" and href in z.namelist():
                for point in _find(ElementTree.fromstring(z.read(href)), "navPoint"):
                    label = next((e.text.strip() for e in _find(point, "text") if e.text and e.text.strip()), None)
                    source = next((c.attrib.get("src", "") for c in point if _local(c) == "content"), "")
                    path, _, fragment = source.partition("#")
                    target = posixpath.normpath(posixpath.join(posixpath.dirname(href), unquote(path)))
                    if label and fragment:
                        inside.setdefault(target, label)
                    elif label:
                        exact[target] = label
        names = set(z.namelist())
        for href, _ in spine:
            if href in names:
                book.chapters.append((href, exact.get(href) or inside.get(href), z.read(href)))
        used = {h for h, _, _ in book.chapters}
        for href, mime in items.values():
            if href not in used and mime != "application/x-dtbncx+xml" and href in names:
                book.resources.append((href, mime, z.read(href)))
    return book


def read_docx(data: bytes, title: str) -> Book:
    """Body paragraphs that aren't blank: the texts of their own runs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for body in _find(root, "body"):
        for p in body:
            if _local(p) == "p":
                text = "".join(t.text or "" for r in p if _local(r) == "r" for t in r if _local(t) == "t")
                if text.strip():
                    out.append(f"<p>{xml(text)}</p>")
    book = Book(title)
    book.chapters.append(("chapter.xhtml", title, page("\n".join(out), title).encode()))
    return book


def read_text(data: bytes, title: str) -> Book:
    book = Book(title)
    lines = re.split(r"\r?\n", re.sub(r"\r?\n\Z", "", data.decode("utf-8-sig")))
    book.chapters.append(("chapter.xhtml", title, page("\n".join(f"<p>{xml(x)}</p>" for x in lines), title).encode()))
    return book


def parse_srt(text: str) -> list[tuple[int, str, str, str]]:
    out = []
    for block in text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n").strip().split("\n\n"):
        rows = block.strip().split("\n")
        times = rows[1].split(" --> ") if len(rows) > 2 else []
        if len(times) == 2 and rows[0].strip().isdigit():
            out.append((int(rows[0]), times[0].strip(), times[1].strip(), "\n".join(rows[2:])))
    return out


def read_srt(data: bytes, title: str) -> Book:
    book = Book(title)
    body = "\n".join(f'<div class="srt-entry" data-start="{xml(a)}" data-end="{xml(b)}"><p>{xml(t)}</p></div>' for _, a, b, t in parse_srt(data.decode("utf-8-sig")))
    book.chapters.append(("chapter.xhtml", title, page(body, title).encode()))
    return book


def unpack_palmdoc(data: bytes) -> bytes:
    """PalmDOC decompression: literals, runs of literals, back references and spaced letters."""
    out = bytearray()
    i = 0
    while i < len(data):
        c = data[i]
        i += 1
        if c == 0 or 9 <= c <= 0x7F:
            out.append(c)
        elif c <= 8:
            out += data[i : i + c]
            i += c
        elif c >= 0xC0:
            out += bytes((32, c ^ 0x80))
        elif i < len(data):
            pair = (c << 8 | data[i]) & 0x3FFF
            i += 1
            back, n = pair >> 3, (pair & 7) + 3
            for _ in range(n):
                out.append(out[-back] if 0 < back <= len(out) else 32)
    return bytes(out)


#: Primary languages of a MOBI header by their number.
MOBI_LANGUAGES = {1: "ar", 4: "zh", 5: "cs", 6: "da", 7: "de", 8: "el", 9: "en", 10: "es", 11: "fi", 12: "fr", 13: "he", 14: "hu", 16: "it", 17: "ja", 18: "ko", 19: "nl", 20: "no", 21: "pl", 22: "pt", 24: "ro", 25: "ru", 29: "sv", 31: "tr", 34: "uk", 42: "vi"}


def read_mobi(data: bytes, title: str) -> Book:
    """The whole book as one chapter; only files without rights management, plain or PalmDOC-compressed."""
    count = struct.unpack(">H", data[76:78])[0]
    at = [struct.unpack(">L", data[78 + 8 * k : 82 + 8 * k])[0] for k in range(count)] + [len(data)]
    record = lambda k: data[at[k] : at[k + 1]]
    head = record(0)
    compression, _, _, records, _, encryption = struct.unpack(">HHLHHH", head[:14])
    if encryption or compression not in (1, 2):
        raise ValueError("this MOBI file is encrypted or compressed in another way")
    encoding, language, extra = "cp1252", None, 0
    if head[16:20] == b"MOBI":
        size = struct.unpack(">L", head[20:24])[0]
        encoding = "utf-8" if struct.unpack(">L", head[28:32])[0] == 65001 else "cp1252"
        offset, length = struct.unpack(">LL", head[84:92])
        title = head[offset : offset + length].decode(encoding, "replace") or title
        language = MOBI_LANGUAGES.get(struct.unpack(">L", head[92:96])[0] & 0xFF)
        if size >= 228:
            extra = struct.unpack(">H", head[242:244])[0]
    text = b""
    for k in range(1, records + 1):
        raw = record(k)
        for bit in range(15, 0, -1):  # trailing entries, each with its size at the end
            if extra >> bit & 1 and raw:
                n = shift = 0
                for b in reversed(raw[-4:]):
                    n |= (b & 0x7F) << shift
                    shift += 7
                    if b & 0x80:
                        break
                raw = raw[: len(raw) - n]
        if extra & 1 and raw:
            raw = raw[: len(raw) - (raw[-1] & 3) - 1]
        text += raw if compression == 1 else unpack_palmdoc(raw)
    book = Book(title, language)
    book.chapters.append(("chapter.xhtml", title, as_xhtml(text.decode(encoding, "replace"), title).encode()))
    return book


def read_book(path: str, data: bytes) -> Book:
    stem, suffix = os.path.splitext(os.path.basename(path))
    kind = FORMATS.get(suffix[1:].lower())
    if kind is None:
        raise ValueError(f"unsupported format: {suffix}")
    return read_epub(data) if kind == "epub" else {"docx": read_docx, "text": read_text, "srt": read_srt, "mobi": read_mobi}[kind](data, stem)


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = tuple(FORMATS)) -> DataFrame:
    """(path, content) of the book files below a path of any file system that Spark reads; other files are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))


def _rows(book_files: DataFrame, schema: str, make) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):  # one file's rows at a time
                rows = list(make(path, bytes(content)))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return book_files.select("path", "content").where("path is not null and content is not null").mapInPandas(run, schema)


def _chapter_rows(path: str, data: bytes) -> Iterator[tuple]:
    name, digest = os.path.splitext(os.path.basename(unquote(path)))[0], hashlib.sha256(data).hexdigest()
    try:
        book = read_book(unquote(path), data)
    except Exception as e:
        yield name, None, None, None, None, None, None, None, path, digest, str(e)
        return
    for k, (href, title, content) in enumerate(book.chapters):
        yield name, k, href, title, content, book.title, book.language, book.identifier, path, digest, None


def _resource_rows(path: str, data: bytes) -> Iterator[tuple]:
    name = os.path.splitext(os.path.basename(unquote(path)))[0]
    try:
        yield from ((name, *r) for r in read_book(unquote(path), data).resources)
    except Exception:
        return  # its error is a row of the chapters


def read_chapters(book_files: DataFrame) -> DataFrame:
    """CHAPTERS of files (path, content); a file that can't be read gives one row with its error; null contents give none."""
    return _rows(book_files, CHAPTERS, _chapter_rows)


def read_resources(book_files: DataFrame) -> DataFrame:
    """RESOURCES of files (path, content): what the manifest names beside the chapters."""
    return _rows(book_files, RESOURCES, _resource_rows)


class BookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "book"

    def schema(self) -> str:
        return RESOURCES if self.options.get("kind") == "resources" else CHAPTERS

    def reader(self, schema) -> DataSourceReader:
        return BookReader(self.options)


class FilePart(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class BookReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.pattern, self.kind = options["path"], options.get("kind", "chapters")

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(os.path.join(self.pattern, "*") if os.path.isdir(self.pattern) else self.pattern))
        return [FilePart(p) for p in found if os.path.isfile(p)] or [FilePart("")]

    def read(self, part: FilePart) -> Iterator[tuple]:
        if not part.path:
            return
        with open(part.path, "rb") as f:
            data = f.read()
        yield from (_resource_rows if self.kind == "resources" else _chapter_rows)(part.path, data)


# ---------------------------------------------------------------- writing


def unique(base: str, used: set[str]) -> str:
    name, n = base, 2
    while name in used:
        name, n = f"{base}_{n}", n + 1
    used.add(name)
    return name


def href_of(href: str) -> str:
    bare = re.sub("^(?:OEBPS|EPUB)/", "", href.lstrip("/"))
    return bare or "index.xhtml"


def id_of(href: str) -> str:
    out = "".join(c if c.isalnum() or c in "-._" else "_" for c in href)
    return "i" + out if not out or out[0].isdigit() else out


def epub_bytes(title: str | None, language: str | None, identifier: str | None, chapters: list[tuple[str, str | None, bytes]], resources: list[tuple[str, str, bytes]] = ()) -> bytes:
    """A deterministic EPUB 2 file: mimetype first and stored, then container, package, contents, chapters, resources."""
    used = {"ncx", "bookid"}
    title, language, identifier = title or "Untitled", language or "en", identifier or "urn:book:unknown"
    rows = [(unique(id_of(href_of(h)), used), href_of(h), t or "Untitled", c) for h, t, c in chapters]
    extra = [(unique(id_of(href_of(h)), used), href_of(h), m, d) for h, m, d in resources]
    manifest = "\n".join(
        ['    <item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>']
        + [f'    <item id="{xml(i)}" href="{xml(h)}" media-type="application/xhtml+xml"/>' for i, h, _, _ in rows]
        + [f'    <item id="{xml(i)}" href="{xml(h)}" media-type="{xml(m)}"/>' for i, h, m, _ in extra]
    )
    spine = "\n".join(f'    <itemref idref="{xml(i)}"/>' for i, _, _, _ in rows)
    opf = f"""<?xml version="1.0" encoding="UTF-8"?>
<package xmlns="http://www.idpf.org/2007/opf" version="2.0" unique-identifier="bookid">
  <metadata xmlns:dc="http://purl.org/dc/elements/1.1/">
    <dc:title>{xml(title)}</dc:title>
    <dc:language>{xml(language)}</dc:language>
    <dc:identifier id="bookid">{xml(identifier)}</dc:identifier>
  </metadata>
  <manifest>
{manifest}
  </manifest>
  <spine toc="ncx">
{spine}
  </spine>
</package>
"""
    points = "\n".join(
        f'    <navPoint id="nav{k}" playOrder="{k}"><navLabel><text>{xml(t)}</text></navLabel><content src="{xml(h)}"/></navPoint>'
        for k, (_, h, t, _) in enumerate(rows, 1)
    )
    ncx = f"""<?xml version="1.0" encoding="UTF-8"?>
<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1">
  <head><meta name="dtb:uid" content="{xml(identifier)}"/></head>
  <docTitle><text>{xml(title)}</text></docTitle>
  <navMap>
{points}
  </navMap>
</ncx>
"""
    container = """<?xml version="1.0" encoding="UTF-8"?>
<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container">
  <rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles>
</container>
"""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data, how in [
            ("mimetype", b"application/epub+zip", zipfile.ZIP_STORED),
            ("META-INF/container.xml", container.encode(), zipfile.ZIP_DEFLATED),
            ("OEBPS/content.opf", opf.encode(), zipfile.ZIP_DEFLATED),
            ("OEBPS/toc.ncx", ncx.encode(), zipfile.ZIP_DEFLATED),
            *[(f"OEBPS/{h}", c, zipfile.ZIP_DEFLATED) for _, h, _, c in rows],
            *[(f"OEBPS/{h}", d, zipfile.ZIP_DEFLATED) for _, h, _, d in extra],
        ]:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = how
            z.writestr(info, data)
    return out.getvalue()


def epubs(chapters: DataFrame, books: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    """(book_id, data): an EPUB file of each book that has chapters, with its resources (book_id, href, mime, data).

    A file holds a whole book, so a book is one group here by its nature. Repeated rows count once, of rows that differ
    under one key the least; null keys are left out; a book without a row has no title.
    """

    def least(df: DataFrame, keys: list[str], others: list[str]) -> DataFrame:
        good = df.where(" and ".join(f"{k} is not null" for k in keys))
        return good.groupBy(*keys).agg(F.min(F.struct(*others)).alias("r")).select(*keys, "r.*")

    meta = least(books, ["book_id"], ["title", "language", "identifier"]).withColumnsRenamed({"title": "book_title"})
    rows = least(chapters, ["book_id", "idx"], ["href", "title", "content"]).join(meta, "book_id", "left")
    if resources is None:
        resources = rows.sparkSession.createDataFrame([], RESOURCES)
    extra = least(resources, ["book_id", "href"], ["mime", "data"])
    extra = extra.join(rows.select("book_id").distinct(), "book_id", "left_semi")

    def run(g: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        g, more = g.sort_values("idx"), more.sort_values("href")
        value = lambda c: g[c].iloc[0] if isinstance(g[c].iloc[0], str) else None
        parts = [(h or "", t if isinstance(t, str) else None, bytes(c or b"")) for h, t, c in zip(g["href"], g["title"], g["content"], strict=True)]
        others = [(h, m or "application/octet-stream", bytes(d or b"")) for h, m, d in zip(more["href"], more["mime"], more["data"], strict=True)]
        return pd.DataFrame({"book_id": [g["book_id"].iloc[0]], "data": [epub_bytes(value("book_title"), value("language"), value("identifier"), parts, others)]})

    return rows.groupBy("book_id").cogroup(extra.groupBy("book_id")).applyInPandas(run, "book_id string, data binary")
