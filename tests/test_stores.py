"""Stores and services."""

from pyspark.sql import functions as F

from foliant.operators import backends as B
from foliant.operators import translate as TR
from foliant.sources import stores as S


def test_cache_is_warm_after_a_run(spark, tmp_path):
    cache = S.CacheTable(spark, str(tmp_path / "cache"))
    docs = spark.createDataFrame([(1, "One. Two."), (2, "Three.")], "doc_id long, text string")
    chunked = TR.keyed(TR.chunks(docs, ["doc_id"], "text", 1), "fake")
    assert cache.read().count() == 0
    missing = TR.misses(chunked, cache.read())
    cache.put(TR.call(missing, TR.Fake))
    assert TR.misses(chunked, cache.read()).count() == 0
    cold = TR.reassemble(TR.lookup(chunked, cache.read()), ["doc_id"]).orderBy("doc_id").collect()
    cache.put(cache.read())  # repeated rows change nothing
    assert TR.reassemble(TR.lookup(chunked, cache.read()), ["doc_id"]).orderBy("doc_id").collect() == cold
    cache.clear()
    assert cache.read().count() == 0


def test_checkpoint_files(spark, tmp_path):
    from datetime import datetime

    schema = "job_id string, source_hash string, source_path string, idx int, href string, status string, content binary, error string"
    rows = [(f"j{k}", "h", "p", i, "a", "completed" if i else "failed", bytearray(b"<p/>") if i else None, None if i else "e") for k in range(6) for i in (1, 0)]
    df = spark.createDataFrame(rows, schema).coalesce(1)
    path = str(tmp_path / "saves")
    S.write_checkpoints(df, path, datetime(2025, 1, 1))
    got = S.read_checkpoints(spark, path)
    assert sorted(map(tuple, got.select("job_id", "idx", "status", "error").collect())) == sorted((r[0], r[3], r[5], r[7]) for r in rows)  # the path that was written reads back
    assert {bytes(r["content"]) for r in got.where("content is not null").collect()} == {b"<p/>"}
    newer = spark.createDataFrame([("j0", "h", "p", 0, "a", "completed", bytearray(b"x"), None)], schema)
    S.write_checkpoints(newer, path, datetime(2025, 1, 2))
    (tmp_path / "saves" / "bad.json").write_text("{not json")
    (tmp_path / "saves" / "pretty.json").write_text('{\n  "job_id": "k",\n  "source_hash": null,\n  "chapters": [\n    {\n      "index": 0,\n      "href": "a"\n    }\n  ],\n  "extra": 1\n}')
    again = S.read_checkpoints(spark, path)
    assert [tuple(r) for r in again.where("job_id = 'j0'").select("idx", "status").collect()] == [(0, "completed")]
    assert again.where("job_id = 'k'").first()["status"] == "pending" and again.select("job_id").distinct().count() == 7


def test_a_run_that_dies_calls_nothing_twice(spark, tmp_path):
    class Dying:
        name = "fake"

        def translate(self, text):
            with open(f"{tmp_path}/calls", "a") as f:
                f.write(text + "\n")
            if text == "t7." and not (tmp_path / "second").exists():
                raise SystemExit
            return "[ZH] " + text

    docs = spark.createDataFrame([(k, f"t{k}.") for k in range(24)], "doc_id long, text string")
    chunked = TR.keyed(TR.chunks(docs, ["doc_id"], "text", 64), "fake")
    cache = S.CacheTable(spark, str(tmp_path / "cache"))
    import pytest

    with pytest.raises(Exception):  # noqa: B017
        TR.fill(cache, TR.misses(chunked, cache.read()), Dying, waves=6, partitions=1, pauses=())
    kept = {r["translation"] for r in cache.read().collect()}
    (tmp_path / "second").write_text("")
    before = (tmp_path / "calls").read_text().split("\n")
    TR.fill(cache, TR.misses(chunked, cache.read()), Dying, waves=6, partitions=1, pauses=())
    after = (tmp_path / "calls").read_text().split("\n")[len(before) - 1 :]
    assert cache.read().select("cache_key").distinct().count() == 24 and not {"[ZH] " + t for t in after} & kept
    TR.fill(cache, TR.misses(chunked, cache.read()), Dying, waves=2, partitions=1, pauses=())
    assert cache.read().count() == 24


def test_log(spark):
    df = spark.sql("select timestamp'2025-01-02 03:04:05' time, 'm' message, d details from values ('x'), (null), ('') t(d)")
    assert [r[0] for r in S.log_text(df).collect()] == ["[2025-01-02 03:04:05] m\n  x", "[2025-01-02 03:04:05] m", "[2025-01-02 03:04:05] m"]


def test_services(spark):
    class Sharper:
        def verify(self, image, mime, text, scale):
            if scale == 1.0:
                raise RuntimeError("busy")
            return text.upper(), 0.5 * scale

    images = spark.createDataFrame([("b", 1, bytearray(b"one\ntwo"), "x"), ("b", 2, None, "x"), ("b", 3, bytearray(b"\xff"), "x")], "book_id string, page_number int, image binary, mime string")
    got = {r["page_number"]: r for r in B.recognise(images, B.FakeReader).collect()}
    assert [x["text"] for x in got[1]["blocks"]] == ["one", "two"] and got[2]["error"] == "no image" and got[3]["error"]
    cand = images.where("page_number = 1").select("*", F.lit(0).alias("block_ix"), F.lit("abc").alias("text"), F.lit(0.6).alias("confidence"))
    row = B.verify(cand, Sharper).first()
    assert (row["text"], row["confidence"], row["changed"]) == ("ABC", 0.75, True)


def test_calls_are_tried_again_and_end(spark):
    class Slow:
        name = "slow"

        def __init__(self):
            self.n = 0

        def translate(self, text):
            import time

            self.n += 1
            if text == "late":
                time.sleep(3)
            if text == "bad" or (text == "twice" and self.n < 2):
                raise RuntimeError("busy")
            return "" if text == "empty" else text.upper()

    rows = spark.createDataFrame([(t, t) for t in ("late", "bad", "twice", "empty", "good")], "cache_key string, chunk string")
    got = {r["cache_key"]: (r["translation"], r["error"]) for r in TR.call(rows, Slow, partitions=2, pauses=(0.0,), limit=1.0).collect()}
    assert got == {"late": (None, "no answer in time"), "bad": (None, "busy"), "twice": ("TWICE", None), "empty": (None, "empty answer"), "good": ("GOOD", None)}


def test_services_over_http():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from foliant.operators import services as V

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, body, code=200):
            data = json.dumps(body).encode()
            self.send_response(code)
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self._answer({"data": [{"id": "m1"}, {"id": 2}], "models": [{"name": "m2"}]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, self.headers.get("Authorization") or self.headers.get("x-api-key"), body))
            if body["messages"][-1]["content"] == "fail":
                return self._answer({"error": "no"}, 500)
            self._answer({"choices": [{"message": {"content": " out "}}], "content": [{"text": "out"}], "message": {"content": "out"}})

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        for kind, models in (("openai", ["m1"]), ("anthropic", ["m1"]), ("ollama", ["m2"]), ("deepseek", ["m1"])):
            t = V.translator(kind.upper(), base_url=url, model="m", prompt="p", api_key="k")
            assert t.translate("in") == "out" and t.list_models() == models and t.name == f"{kind}:m"
            t.health_check()
            try:
                t.translate("fail")
                raise AssertionError
            except RuntimeError as e:
                assert "500" in str(e)
        paths = [a[0] for a in asked[::2]]
        assert paths == ["/chat/completions", "/v1/messages", "/api/chat", "/chat/completions"]
        assert asked[0][1] == "Bearer k" and asked[2][1] == "k" and asked[2][2]["system"] == "p" and asked[4][2]["stream"] is False
    finally:
        server.shutdown()
    assert V.translator("fake").translate("a") == "[ZH] a"
    try:
        V.translator("nobody")
        raise AssertionError
    except KeyError as e:
        assert "nobody" in str(e)
