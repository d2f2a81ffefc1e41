"""Defects of pairs, short and long."""

import pytest

from foliant.llm import langid as L
from foliant.llm import pairs as P


@pytest.fixture(scope="module")
def model(spark, data):
    return L.train(spark.read.parquet(f"{data}/lang_samples.parquet"))[0]


def test_templates():
    assert P.template("guild of Torusk", "gremio de Torusk") == ("guild of @", "gremio de @", False)
    assert P.template("guild of Torusk", "gremio de Toru") == ("guild of @", "gremio de", True)
    assert P.template("Torusk", "Torusk") == ("torusk", "torusk", False)
    assert P.template("königliches Archiv", "archivo real") == ("königliches @", "archivo real", False)


def test_short(spark, model):
    jobs = spark.createDataFrame([("es", "es", "en"), ("fr", "fr", "en"), ("de", "de", "en")], "job_id string, target_lang string, source_lang string")
    good = [("es", "ink tax", "impuesto sobre la tinta"), ("fr", "ink tax", "taxe sur l'encre"), ("es", "guild of Torusk", "gremio de Torusk"), ("es", "guild of Balos", "gremio de Balos"), ("es", "Torusk", "Torusk"), ("fr", "Torusk", "Torusk")] * 8
    bad = [
        ("es", "ink tax", "", "empty"), ("es", "ink tax", None, "empty"), ("fr", "ink tax", "​", "empty"), ("fr", "ink tax", "<p></p>", "empty"), ("es", "ink tax", "N/A", "empty"),
        ("es", "ink tax", "Lo siento, pero no puedo traducir este texto.", "refusal"), ("fr", "ink tax", "As a language model I am unable to provide this translation.", "refusal"),
        ("es", "ink tax", "“INK TAX” ", "copy"), ("es", "guild of Torusk", "gremio de", "truncated"), ("es", "guild of Torusk", "gremio de Toru", "truncated"),
        ("es", "ink tax", "impuesto sobre la", "truncated"), ("es", "ink tax", "taxe sur l'encre", "other_language"),
    ]
    rows = [(k, j, t, r, "x") for k, (j, t, r, *_) in enumerate([*good, *bad])] + [(None, "es", "a", "b", "x"), (900, "zz", "a", "b", "x"), (901, "es", None, "b", "x")]
    glossary = spark.createDataFrame(rows, "entry_id long, job_id string, term string, translation string, defect string")
    got = {r["entry_id"]: r["defect"] for r in P.short_defects(P.short_features(glossary, jobs, model)).collect()}
    assert got == {len(good) + k: d for k, (*_, d) in enumerate(bad)}
    assert P.short_defects(P.short_features(glossary.limit(0), jobs, model)).count() == 0


EN = ["The old reader walked back to the library in the rain.", "Nobody in the town remembered the quiet teacher.", "It took three days before the printer understood the letter.", "The price of the notebook rose to six crowns.", "Some readers prefer the second edition; others ask for the first.", "The harbour was closed during the long winter."]
DE = ["Der alte Leser ging bei Regen in die Bibliothek zurück.", "Niemand in der Stadt erinnerte sich an die stille Lehrerin.", "Es dauerte drei Tage, bis der Drucker den Brief verstand.", "Der Preis des Heftes stieg auf sechs Kronen.", "Manche Leser möchten die zweite Ausgabe, andere fragen nach der ersten.", "Der Hafen war während des langen Winters geschlossen."]


def page(sentences, heading="<h1>Titel</h1>"):
    return bytearray(("<html><head><title>t</title></head><body>" + heading + "".join(f"<p>{s}</p>" for s in sentences) + "</body></html>").encode())


def test_long(spark, model):
    answers = [
        (0, page(DE), None), (1, None, "empty"), (2, bytearray(b" \n"), "empty"), (3, page([]), "empty"), (4, page(["Es tut mir leid, aber dabei kann ich nicht helfen."]), "refusal"), (5, page(EN), "copy"),
        (6, page(["Le vieux lecteur est retourné à la bibliothèque sous la pluie.", "Personne ne se souvenait de la maîtresse.", "Il fallut trois jours.", "Le prix du carnet monta à six couronnes.", "Certains préfèrent la deuxième édition.", "Le port était fermé."]), "other_language"),
        (7, page(DE[:2]), "truncated"), (8, page([*DE[:5], "Der Hafen war während des lan"]), "truncated"), (9, page([" ".join(DE)]), None), (10, page(["„Es tut mir leid“, sagte der Drucker, „aber ich kann nicht helfen.“", *DE]), None),
    ]
    code = bytearray(b"<html><body><h1>X</h1><pre><code>def f(): return 1</code></pre></body></html>")
    extra = "x string, defect string"
    jobs = spark.createDataFrame([("j", "b", "de", "x"), ("j", "b", "de", "x")], "job_id string, book_id string, target_lang string, hash string")
    chapters = spark.createDataFrame([("b", k, page(EN), "x", "x") for k in range(11)] + [("b", 11, code, "x", "x"), ("b", 0, page(EN), "x", "x")], f"book_id string, idx int, content binary, {extra}")
    rows = [("j", k, "completed", c, "x") for k, c, _ in answers] + [("j", 11, "completed", code, "x"), ("j", 0, "completed", page(DE), "x"), ("j", 5, "failed", None, "x"), ("z", 1, "completed", None, "x"), ("j", 99, "completed", None, "x")]
    done = spark.createDataFrame(rows, "job_id string, idx int, status string, content binary, lang string")
    got = {r["idx"]: r["defect"] for r in P.long_defects(chapters, jobs, done, model).collect()}
    assert got == {k: d for k, _, d in answers if d}
    assert P.long_defects(chapters, jobs, done.limit(0), model).count() == 0


def test_spikes(spark):
    rows = [(k % 700,) for k in range(2000)] + [(500,)] * 60
    assert [r[0] for r in P.spikes(spark.createDataFrame(rows, "tokens int")).collect()] == [500]


def test_shortened(spark):
    df = spark.createDataFrame([("es", "gremio", 9), ("es", "gremio de", 1), ("es", "gremio de @", 5), ("es", "faro", 3), ("fr", "gremio", 1), ("es", "", 4), (None, "faro", 1), (None, "faro del", 1)], "target string, text string, n long")
    assert sorted(tuple(r) for r in P.shortened(df).collect()) == [("es", "gremio", "gremio de", 1), ("es", "gremio de", "gremio de @", 5)]
    assert P.shortened(df.limit(0)).count() == 0


def test_shortened_over_the_edges_of_tasks(spark):
    words = [f"w{k:03d}" + "x" * n for k in range(40) for n in range(1, 12)]
    want = {(a, b) for a, b in zip(sorted(words), sorted(words)[1:]) if b.startswith(a)}
    assert len(want) == 40 * 10
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for kind, of in (("string", str), ("binary", lambda w: bytearray(w.encode()))):
            df = spark.createDataFrame([("es", of(w), 1) for w in words], f"target string, text {kind}, n long")
            got = {(r["text"], r["longer"]) if kind == "string" else (r["text"].decode(), r["longer"].decode()) for r in P.shortened(df).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_chains_and_refusals():
    text = "abcdefgh" * 100
    assert P.chain_of(text).startswith(P.chain_of(text[:300])) and len(P.chain_of(text)) == 4 * (800 // P.CHAIN) and P.chain_of("short") == b""
    assert P.is_refusal("I'm sorry, but I cannot help with that. " * 200) and not P.is_refusal("")
    assert not P.is_refusal("I cannot help you, said the printer. " + "The old reader walked back to the library in the rain. " * 200)


def test_an_answer_that_is_the_beginning_of_another(spark, model):
    many = [f"Satz Nummer {k} steht in der alten Bibliothek am stillen Hafen der Stadt." for k in range(40)]
    asked = [f"Sentence number {k} stands in the old library at the quiet harbour of the town." for k in range(40)]
    jobs = spark.createDataFrame([("j", "b", "de"), ("k", "b", "de")], "job_id string, book_id string, target_lang string")
    chapters = spark.createDataFrame([("b", k, page(asked)) for k in range(8)], "book_id string, idx int, content binary")
    rows = [("j", k, "completed", page([f"Kapitel {k} beginnt hier.", *many])) for k in range(8)] + [("k", 3, "completed", page(["Kapitel 3 beginnt hier.", *many[:33]]))]
    done = spark.createDataFrame(rows, "job_id string, idx int, status string, content binary")
    got = {(r["job_id"], r["idx"]): r["defect"] for r in P.long_defects(chapters, jobs, done, model).collect()}
    assert got == {("k", 3): "truncated"}


def test_both_ways_of_joining_agree(spark, data, model, monkeypatch):
    tables = [spark.read.parquet(f"{data}/{t}.parquet") for t in ("chapters", "job_options", "checkpoints")]
    few = sorted(map(tuple, P.long_defects(*tables, model).collect()))
    monkeypatch.setattr(P, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, P.long_defects(*tables, model).collect())) == few


def test_a_chapter_of_marks_only(spark, model):
    jobs = spark.createDataFrame([("j", "b", "de")], "job_id string, book_id string, target_lang string")
    chapters = spark.createDataFrame([("b", 0, page(["…", "…", "…", "…"])), ("b", 1, page(EN))], "book_id string, idx int, content binary")
    done = spark.createDataFrame([("j", 0, "completed", page(DE)), ("j", 1, "completed", page(DE[:2]))], "job_id string, idx int, status string, content binary")
    assert {(r["idx"], r["defect"]) for r in P.long_defects(chapters, jobs, done, model).collect()} == {(1, "truncated")}
