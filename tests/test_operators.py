"""Operators on small tables, with nulls, repeated rows, ties and empty tables."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import html_tree as H
from foliant.operators import ocr, progress, resume, toc
from foliant.operators import translate as TR
from foliant.streaming import progress as SP

PAGES = "book_id string, page_number int, block_ix int, block_type string, text string, confidence float, bbox struct<x:int,y:int,w:int,h:int>"


def blocks(spark, rows):
    full = [(b, p, i, kind, t, 0.9, box) for b, p, i, kind, t, *rest in rows for box in [rest[0] if rest else None]]
    return spark.createDataFrame(full, PAGES)


def test_chunks_cache_and_reassembly(spark):
    docs = spark.createDataFrame([(1, "One. Two."), (2, None), (3, ""), (4, "One. Two."), (5, "Three\nfour.")], "doc_id long, text string")
    chunked = TR.keyed(TR.chunks(docs, ["doc_id"], "text", 64), "fake")
    cache = spark.createDataFrame([], "cache_key string, translation string")
    missing = TR.misses(chunked, cache)
    assert missing.count() == 2  # the repeated text is called once
    new = TR.call(missing, TR.Fake, 2)
    full = TR.upsert(cache, new)
    assert TR.misses(chunked, full).count() == 0
    done = {r["doc_id"]: r["translation"] for r in TR.reassemble(TR.lookup(chunked, full), ["doc_id"]).collect()}
    assert done == {1: "[ZH] One. Two.", 4: "[ZH] One. Two.", 5: "[ZH] Three four."}


def test_calls_are_retried_and_errors_kept(spark):
    class Bad:
        name = "bad"

        def translate(self, text):
            raise RuntimeError("no")

    missing = spark.createDataFrame([("k", "x")], "cache_key string, chunk string")
    row = TR.call(missing, Bad, 1, pauses=(0.0,)).first()
    assert row["translation"] is None and row["error"] == "no"
    failed = TR.reassemble(spark.createDataFrame([(1, 0, "a"), (1, 1, None)], "doc_id long, chunk_ix int, translation string"), ["doc_id"]).first()
    assert failed["failed"] and failed["translation"] is None


@pytest.mark.parametrize(("mode", "want"), [("bilingual", ["t", "o"]), ("interleaved", ["o", "t"]), ("translation_only", ["t"])])
def test_sides(spark, mode, want):
    df = spark.createDataFrame([(1, "o", "t"), (2, "o", None)], "k int, o string, t string")
    rows = TR.side_by_side(df, ["k"], "o", "t", mode).orderBy("k", "part").collect()
    assert [r["text"] for r in rows if r["k"] == 1] == want and [r["text"] for r in rows if r["k"] == 2] == ["o"]


def test_resume(spark):
    wanted = spark.createDataFrame([("j", k, bytearray(b"src")) for k in range(4)], "job_id string, idx int, content binary")
    kept = spark.createDataFrame([("j", 0, "completed", bytearray(b"done"), "h"), ("j", 1, "failed", None, "h"), ("j", 2, "completed", None, "h")], "job_id string, idx int, status string, content binary, source_hash string")
    assert sorted(r["idx"] for r in resume.pending(wanted, kept).collect()) == [1, 3]
    assert {r["idx"]: r["status"] for r in resume.backfill(wanted, kept).collect()} == {0: "completed", 1: "failed", 2: "completed", 3: "pending"}
    assert {r["idx"]: bytes(r["content"]) for r in resume.restore(wanted, kept).collect()} == {0: b"done", 1: b"src", 2: b"src", 3: b"src"}
    s = resume.summary(kept).first()
    assert (s["completed"], s["failed"], s["total"], s["pending"]) == (2, 1, 3, 0)
    sources = spark.createDataFrame([("j", "other")], "job_id string, current_hash string")
    assert resume.valid(kept, sources).count() == 0
    assert resume.pending(wanted.limit(0), kept).count() == 0


def test_failures(spark):
    rows = spark.createDataFrame([("a", 1, "y", "failed"), ("a", 0, "x", "failed"), ("b", 0, "x", "failed"), ("b", 1, "y", "completed")], "job_id string, idx int, href string, status string")
    got = {r["job_id"]: (r["failed"], r["hrefs"], r["all_failed"]) for r in resume.failures(rows).collect()}
    assert got == {"a": (2, "x, y", True), "b": (1, "x", False)}


def test_latest_takes_one_row_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y")], "k string, t int, v string")
    assert [tuple(r) for r in resume.latest(df, ["k"], "t").select("k", "t", "v").collect()] == [("a", 2, "y")]


def test_headers_cleaning_and_labels(spark):
    rows = [("b", p, 0, "paragraph", "My Book") for p in range(1, 6)] + [("b", p, 1, "paragraph", f"{p}") for p in range(1, 6)]
    rows += [("b", p, 2, "paragraph", f"Text of page {p} goes on and on.") for p in range(1, 6)]
    df = blocks(spark, rows)
    heads = ocr.repeated_headers(df, "greatest(2, floor(pages / 5))")
    assert [(r["header"], r["n"]) for r in heads.collect()] == [("MyBook", 5)]
    assert sorted(r["block_ix"] for r in ocr.clean(df, heads).collect()) == [2] * 5
    labels = blocks(spark, [("b", 1, 0, "paragraph", "μ-3σ"), ("b", 1, 1, "paragraph", "μ"), ("b", 1, 2, "paragraph", "μ+3σ"), ("b", 1, 3, "paragraph", "A sentence that is clearly one.")])
    got = ocr.group_labels(labels).orderBy("block_ix").collect()
    assert [(r["block_type"], r["merged"]) for r in got] == [("other", 3), ("paragraph", 1)] and got[0]["text"] == "μ-3σ\nμ\nμ+3σ"


def test_chapters(spark):
    df = blocks(spark, [("b", 1, 0, "paragraph", "pre"), ("b", 1, 1, "heading", "1 Chapter"), ("b", 2, 0, "heading", "1.1 Sub"), ("b", 2, 1, "heading", "References"), ("b", 3, 0, "paragraph", "end")])
    assert [r["chapter"] for r in ocr.chapter_of(df).orderBy("page_number", "block_ix").collect()] == [1, 1, 1, 2, 2]


def model_rows(cells):
    limit = max(5, min([h // 2 for *_, h in cells], default=10))
    rows = []
    for c in sorted(cells, key=lambda c: c[1]):
        for r in rows:
            if abs(r[0][1] - c[1]) <= limit:
                r.append(c)
                break
        else:
            rows.append([c])
    return [[c[0] for c in sorted(r, key=lambda c: c[0])] for r in rows]


def test_table_rows_are_anchored_at_first_cells(spark):
    cells = [(10, 100, 20, 20), (60, 108, 20, 20), (10, 117, 20, 20), (60, 119, 20, 20), (110, 125, 20, 20)]
    df = blocks(spark, [("b", 1, k, "table_cell", str(c[0]), c) for k, c in enumerate(cells)])
    got = ocr.table_runs(df).select(ocr.table_rows(F.col("cells")).alias("r")).first()["r"]
    assert [[c["bbox"]["x"] for c in row] for row in got] == model_rows(cells)


def test_grid_and_union(spark):
    df = blocks(spark, [("b", 1, k, "table_cell", "x", ((k % 3) * 300, 5, 10, 10)) for k in range(9)])
    assert ocr.grid_columns(ocr.table_runs(df)).first()["columns"] == 3
    box = ocr.box_union(df).first()["bbox"]
    assert tuple(box) == (0, 5, 610, 10)
    assert ocr.box_union(blocks(spark, [("b", 1, 0, "paragraph", "x")])).first()["bbox"] is None


def test_best_attempt_stops_early(spark):
    kind = "array<struct<text:string,confidence:double,anomaly:double>>"
    df = spark.createDataFrame([([("a", 0.5, 0.1), ("b", 0.8, 0.1), ("c", 0.99, 0.0)],), ([("a", 0.6, 0.5), ("b", 0.6, 0.2)],), ([],)], f"a {kind}")
    assert [(r["b"]["text"], r["b"]["confidence"]) for r in df.select(ocr.best_attempt(F.col("a"), F.lit(0.55)).alias("b")).collect()] == [("b", 0.8), ("b", 0.6), (None, 0.55)]


def test_captions(spark):
    df = blocks(spark, [("b", 1, 0, "image", "i"), ("b", 1, 1, "caption", "c"), ("b", 1, 2, "image", "j"), ("b", 2, 0, "caption", "d")])
    assert [(r["block_ix"], r["caption"]) for r in ocr.captions(df).orderBy("block_ix").collect()] == [(0, "c"), (2, None)]


def test_toc_labels(spark):
    df = spark.createDataFrame([("b", 0, "x#1", "first"), ("b", 1, "x#2", "second"), ("b", 2, "y", "old"), ("b", 3, "y", "new"), ("b", 4, "y#z", "part")], "book_id string, pos int, href string, label string")
    assert {r["path"]: r["label"] for r in toc.labels(df).collect()} == {"x": "first", "y": "new"}


EVENTS = "task_id string, seq long, event string, total long, chunk_index long, chunk_total long"
RUN = [
    ("a", 0, "Started", 10, None, None), ("a", 1, "ChapterFinished", None, None, None), ("a", 2, "ChapterFinished", None, None, None),
    ("b", 0, "Started", 2, None, None), ("b", 1, "ChunkFinished", None, 0, 2), ("c", 0, "Started", 2, None, None), ("c", 1, "Completed", None, None, None),
    ("d", 0, "Started", 4, None, None), ("d", 1, "ChapterFinished", None, None, None), ("d", 2, "Started", 8, None, None), ("e", 0, "ChapterFinished", None, None, None),
]
WANT = {"a": (10, 2, 20), "b": (2, 0, 25), "c": (2, 2, 100), "d": (8, 0, 0), "e": (None, 1, 0)}


def test_progress(spark):
    got = {r["task_id"]: (r["total"], r["completed"], r["progress"]) for r in progress.fold(spark.createDataFrame(RUN, EVENTS)).collect()}
    assert got == WANT
    row = spark.range(1).select(progress.remap(F.lit(50), 50, 0.5), progress.remap(F.lit(100), 90, 0.5)).first()
    assert tuple(row) == (75, 100)


def test_progress_stream_equals_batch(spark, tmp_path):
    for k, part in enumerate((RUN[:5], RUN[5:])):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = SP.fold(stream).writeStream.format("memory").queryName("progress_states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    last = spark.sql("select task_id, max_by(struct(total, completed, progress), seq) s from progress_states group by task_id").collect()
    assert {r["task_id"]: tuple(r["s"]) for r in last} == WANT


DOC = '<html><head><title>T</title></head><body><h1>Title</h1><p class="x">Hello <b>big</b> world.<br>Next<p>A</p><pre><p>code</p></pre><ul><li>Item one</li></ul><div class="no"><p>Hidden text</p></div><img alt="A cat" src="c.png"/></body></html>'


def test_selection():
    got = [(n.tag, a, t) for n, a, t in H.selected(H.Tree(DOC), H.Scope(exclude=(".no",)))]
    assert got == [("h1", None, "Title"), ("p", None, "Hello big world.\nNext"), ("li", None, "Item one"), ("img", "alt", "A cat")]
    assert not [x for x in H.selected(H.Tree(DOC), H.Scope(body=False, alt_text=False)) if x[1] is None]
    nested = H.selected(H.Tree("<div><p>inner text</p></div>"), H.Scope(tags=("div", "p")))
    assert [n.tag for n, _, _ in nested] == ["p"]
    skipped = H.selected(H.Tree("<div><pre><p>code</p></pre> text</div>"), H.Scope(tags=("div", "p")))
    assert [n.tag for n, _, _ in skipped] == ["div"]


@pytest.mark.parametrize("mode", ["bilingual", "interleaved", "translation_only"])
def test_bilingual_documents(mode):
    out = H.bilingual("<h1>Title</h1><ul><li>Item one</li></ul>", {0: "<b>T", 1: "I"}, mode, "auto", "zh-CN")
    assert '<h1 lang="zh-CN">&lt;b&gt;T</h1>' in out
    assert (">Title<" in out) == (mode != "translation_only")
    if mode == "bilingual":
        assert out.index("&lt;b&gt;T") < out.index("Title") and 'class="bilingual-li"' in out and 'lang="en"' in out
    if mode == "interleaved":
        assert out.index("&lt;b&gt;T") > out.index("Title") and "bilingual-li" not in out


def test_nodes_as_rows(spark):
    df = spark.createDataFrame([("b", 0, bytearray(DOC.encode())), ("b", 1, None), ("b", 2, bytearray(b""))], "book_id string, idx int, content binary")
    rows = H.nodes(df, ["book_id", "idx"]).collect()
    assert {r["idx"] for r in rows} == {0} and next(r for r in rows if r["tag"] == "b")["ancestors"] == ["p", "body", "html"]
    assert H.texts(df, ["book_id", "idx"]).where("tag = 'li'").first()["text"] == "Item one"


def test_ids_are_unique_though_bases_look_like_made_ones(spark):
    import random

    from foliant.operators import toc
    from foliant.sources.book import unique

    draw = random.Random(1)
    books = {"x": ["a", "a", "a_2"], "y": ["a_2", "a", "a", "a_2", "a_2_2", "b"]} | {f"r{k}": [draw.choice(["a", "a_2", "a_3", "a_2_2", "b", "b_x", "_2"]) for _ in range(20)] for k in range(6)}
    rows = [(b, i, base) for b, bases in books.items() for i, base in enumerate(bases)]
    made = {(r["book_id"], r["idx"]): r["id"] for r in toc.unique_ids(spark.createDataFrame(rows, "book_id string, idx int, base string")).collect()}
    for b, bases in books.items():
        used: set = set()
        assert [made[b, i] for i in range(len(bases))] == [unique(base, used) for base in bases]
