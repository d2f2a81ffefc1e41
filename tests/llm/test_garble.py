"""Wrong decodings: made on purpose and restored; right text left alone."""

import pytest

from foliant.llm import garble as G


@pytest.fixture(scope="module")
def trained(spark, data):
    return G.train(spark.read.parquet(f"{data}/lang_samples.parquet"), spark.read.parquet(f"{data}/documents.parquet"))


def samples(spark, data, langs):
    return [(r["lang"], r["text"]) for r in spark.read.parquet(f"{data}/lang_samples.parquet").collect() if r["lang"] in langs]


@pytest.mark.parametrize(("langs", "right", "wrong"), [
    (("fr", "es", "pt", "de"), "utf-8", "cp1252"), (("fr", "es", "pt"), "utf-8", "mac_roman"), (("fr", "es"), "utf-8", "cp437"), (("ru",), "utf-8", "cp1251"),
    (("fr", "pt"), "cp1252", "cp1251"), (("fr", "pt"), "mac_roman", "cp1252"), (("ru",), "cp1251", "cp1252"), (("ru",), "cp866", "cp1251"), (("zh",), "gb18030", "cp1252"),
])
def test_restored(spark, data, trained, langs, right, wrong):
    models, margin = trained
    made = found = good = 0
    for _, text in samples(spark, data, langs):
        try:
            bad = text.encode(right).decode(wrong)
        except UnicodeError:
            continue
        if bad == text or sum(a != b for a, b in zip(text, bad)) < 3:
            continue
        made += 1
        garbled, _, _, _, out = G.examine(bad, models, margin)
        found += garbled
        good += out == text
    if made >= 5:
        assert found >= 0.9 * made and good >= 0.7 * made, (made, found, good)


def test_twice(spark, data, trained):
    models, margin = trained
    text = "La préface bleue avait attendu ce jardin imprimé à la dernière page."
    bad = text.encode().decode("latin-1").encode().decode("latin-1")
    garbled, recovered, _, chains, out = G.examine(bad, models, margin)
    assert garbled and recovered and out == text and chains


def test_right_text_stays(spark, data, trained):
    models, margin = trained
    for _, text in samples(spark, data, ("en", "de", "fr", "es", "pt", "it", "ru", "zh", "ja")):
        assert not G.examine(text, models, margin)[0], text
    for text in ("±5 ¬ √2 = ¾?", "Ω ≠ ∑", "Ð, Þ, Æ…", "I don’t know — “really”…", "caf&#233; naïve", "├── a.css\n└── b/", "", "plain"):
        assert not G.examine(text, models, margin)[0], text


def test_lost_and_referenced(trained):
    models, margin = trained
    garbled, recovered, reason, _, _ = G.examine("Zwischen Torusk und dem fr�hen Manuskript", models, margin)
    assert garbled and not recovered and reason == "lost"
    assert G.examine("la leyenda peque&#195;&#177;a segu&#195;&#173;a all&#195;&#173;", models, margin)[4] == "la leyenda pequeña seguía allí"
    assert G.examine(None, models, margin) == (False, False, None, [], None)


def test_rows(spark, trained):
    models, margin = trained
    df = spark.createDataFrame([("a", 1, bytearray("el último".encode().decode("latin-1").encode()), "x"), ("a", 2, None, "x"), (None, None, bytearray(b""), "x"), ("a", 1, bytearray(b"ok" * 50000), "x"), ("b", 1, bytearray(b"\xff\xfe"), "x")], "book_id string, idx int, content binary, restored string")
    got = G.find_garbled(df, ["book_id", "idx"], "content", models, margin).collect()
    assert len(got) == 5 and [r["restored"] for r in got if r["idx"] == 1][0] == "el último" and [r for r in got if r["book_id"] == "b"][0]["garbled"]
    assert G.find_garbled(df.limit(0), ["book_id", "idx"], "content", models, margin).count() == 0


def test_bytes_in_another_encoding(spark, trained):
    models, margin = trained
    text = "La préface bleue avait attendu ce jardin imprimé à la dernière page."
    assert G.examine(text.encode("cp1252"), models, margin) == (True, True, "bytes", ["utf-8/cp1252"], text)
    assert G.examine("Забытый рассказ вышел зимой в тихом городе.".encode("cp1251"), models, margin)[4] == "Забытый рассказ вышел зимой в тихом городе."
    assert G.examine(text.encode(), models, margin)[0] is False


def test_share_restored_exactly(spark, data, trained):
    """Held-out documents, damaged on purpose: how many come out as they were."""
    models, margin = trained
    texts = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").where("text is not null").collect() if not r["text"].isascii() and G.LOST not in r["text"]]
    texts = [t for t in texts if not G.examine(t, models, margin)[0]]
    made = good = found = 0
    for text in texts:
        try:
            bad = text.encode("utf-8").decode("cp1252")
        except UnicodeDecodeError:
            continue
        made += 1
        got = G.examine(bad, models, margin)
        found += got[0]
        good += got[4] == text
    assert made >= 10 and found == made and good >= 0.9 * made, (made, found, good)


def test_models_know_every_record(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    rare = [chr(0x1400 + k) for k in range(300)]
    text = F.concat(F.lit("word number "), F.col("id").cast("string"), F.when(F.col("id") % 100 == 0, F.expr("concat(' a', char_at[cast(id / 100 as int)], 'b')")).otherwise(""))
    samples = spark.range(30_000).withColumn("char_at", F.array(*map(F.lit, rare))).select(F.lit("en").alias("lang"), text.alias("text"))
    documents = spark.range(4000).select(F.lit("fr").alias("lang"), F.concat(F.lit("mot "), F.col("id").cast("string")).alias("text"))
    models, margin = G.train(samples.unionByName(samples.limit(50)), documents)
    assert set(rare) <= models.alphabet and margin == G.LEAST_MARGIN
    counted = G.count_grams(G.clean_records(samples, documents)).where("order = 0").collect()
    want = Counter((G.LANGUAGES.index(r["lang"]), c) for r in samples.unionByName(documents).collect() for w in r["text"].split() for c in w + "  ")
    assert {(r["lang"], chr(r["gram"])): r["n"] for r in counted} == want
    assert 0 < sum(r["held_n"] for r in counted) < sum(r["n"] for r in counted)
    with pytest.raises(ValueError):
        G.train(samples.limit(0), documents.limit(0))
