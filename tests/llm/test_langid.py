"""Languages: held-out accuracy, mixed documents, labels, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import langid as L


@pytest.fixture(scope="module")
def samples(spark, data):
    return sorted((r["lang"], r["text"]) for r in spark.read.parquet(f"{data}/lang_samples.parquet").collect())


@pytest.fixture(scope="module")
def model(samples):
    return L.Classifier(samples)


@pytest.mark.parametrize("change", [lambda t: t, L.fold_accents, str.upper])
def test_held_out(samples, change):
    half = L.Classifier(samples[::2])
    scores, _ = half.scores([change(t) for _, t in samples[1::2]])
    assert np.mean([L.LANGUAGES[k] == lang for k, (lang, _) in zip(scores.argmax(1), samples[1::2], strict=True)]) >= 0.97


def test_scores_are_the_kernel_machine(samples):
    """The block product equals kernels computed pair by pair, times the classifiers' weights."""
    few = samples[::12]
    m = L.Classifier(few, per_language=5)
    known = set(m.keys.tolist())
    grams = lambda t: {int(k) for keys in L._keys(L.codes([t])) for k in keys} & known
    one = m.scores(["Das ist ein kurzer Satz."])[0][0]
    weight = dict(zip(m.keys.tolist(), m.weights, strict=True))
    g = grams("Das ist ein kurzer Satz.")
    assert np.allclose(one, sum(weight[k] for k in g) / np.sqrt(len(g)) + m.bias, atol=1e-4)
    batch = m.scores(["\U0001f600 eins", "", "Das ist ein kurzer Satz.", "12"])[0]
    assert np.allclose(batch[2], one, atol=1e-4)


def test_labels(spark):
    labels = ["en", "EN", "en_GB", "deu", "German", "zh-Hans", "  ", "", None, "auto", "und", "unknown", "pt-BR", "Japanese", "fre", "русский"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in labels], "label string").select(L.label_code(F.col("label"))).collect()]
    assert got == ["en", "en", "en", "de", "de", "zh", None, None, None, None, None, None, "pt", "ja", "fr", "ru"]


def test_documents(spark, model):
    en, de = "The old reader walked back to the library in the rain. ", "Der alte Leser ging bei Regen in die Bibliothek zurück. "
    rows = [(1, en * 3, "de", "x"), (2, en * 3 + de * 3, "en", "x"), (3, en * 3 + de, "en", "x"), (4, None, "en", "x"), (5, "", None, "x"), (6, "12 — ★", "en", "x"), (None, de, None, "x"), (1, en * 3, "de", "x")]
    got = L.label_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, label string"), model, 4.0).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and by[1]["lang"] == "en" and by[None]["lang"] == "de"
    assert {x["lang"] for x in by[2]["languages"]} == {"en", "de"} and [x["lang"] for x in by[3]["languages"]] == ["en"]
    assert [by[k]["lang"] for k in (4, 5, 6)] == [None] * 3 and by[4]["languages"] == []
    assert [s["lang"] for s in by[2]["segments"]] == ["en", "de"] and by[2]["segments"][0]["start"] == 0
    assert 0 < by[1]["confidence"] <= 1
    assert L.label_documents(spark.createDataFrame([], "doc_id long, text string, lang string"), model, 4.0).count() == 0


def test_books(spark, model):
    en, de = (x * 4 for x in ("The old reader walked back to the library in the rain. ", "Der alte Leser ging bei Regen in die Bibliothek zurück. "))
    wrap = lambda t: bytearray(f"<p>{t}</p><pre><code>def x(): pass</code></pre>".encode())
    chapters = spark.createDataFrame([("a", 0, wrap(en)), ("a", 1, wrap(de)), ("a", 1, wrap(de)), ("b", 0, wrap(de)), ("c", 0, None), (None, 0, wrap(en)), ("d", 0, bytearray(b"<pre>x = 1</pre>"))], "book_id string, idx int, content binary")
    cues = spark.createDataFrame([("e", "Der alte Leser ging"), ("e", None), ("e", "in die Bibliothek zurück")], "book_id string, text string")
    parts = L.score_parts(chapters, model, True, "idx").unionByName(L.score_parts(cues, model, False))
    got = {r["book_id"]: (r["lang"], r["languages"]) for r in L.label_books(parts, 4.0).collect()}
    assert got["a"][1] == ["de", "en"] and got["b"] == ("de", ["de"]) and got["e"] == ("de", ["de"]) and got["d"] == (None, [])
    assert set(got) == {"a", "b", "d", "e"}


def test_segments_of_chapters(spark, data):
    from foliant.llm import langid

    model, temperature = langid.train(spark.read.parquet(f"{data}/lang_samples.parquet"), spark.read.parquet(f"{data}/documents.parquet"))
    en, de = "The old reader walked back to the library in the rain. Nobody in the town remembered the quiet teacher. ", "Der alte Leser ging bei Regen in die Bibliothek zurück. Niemand in der Stadt erinnerte sich an die stille Lehrerin. "
    rows = [("b", 1, bytearray(f"<p>{en}</p><p>{de}</p>".encode())), ("b", 2, None), ("b", 3, bytearray(b"<pre>x = 1</pre>")), (None, 4, bytearray(en.encode()))]
    got = {r["idx"]: r for r in langid.label_texts(spark.createDataFrame(rows, "book_id string, idx int, content binary"), ["book_id", "idx"], "content", model, temperature, True).collect()}
    assert [s["lang"] for s in got[1]["segments"]] == ["en", "de"] and all(s["confidence"] > 0.5 for s in got[1]["segments"])
    assert got[2]["lang"] is None and got[3]["lang"] is None and got[4]["lang"] == "en"
