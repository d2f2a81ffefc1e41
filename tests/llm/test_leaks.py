"""Leaks against brute force over all pairs."""

import random

from foliant.llm import leaks

ITEMS = "item_id long, suite string, lang string, text string"


def brute(doc, item, by_char):
    d, i = ((leaks.chars if by_char else leaks.words)(leaks.fold(x)) for x in (doc, item))
    least = leaks.CHAR_RUN if by_char else leaks.WORD_RUN
    hit = [False] * len(i)
    for a in range(len(d) - least + 1):
        for b in range(len(i) - least + 1):
            if d[a : a + least] == i[b : b + least]:
                hit[b : b + least] = [True] * least
    return sum(hit), len(i)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(25)]
    items = [(k, "s", "en", " ".join(rng.choices(vocabulary, k=rng.randint(5, 60)))) for k in range(12)]
    docs = []
    for k in range(60):
        words = rng.choices(vocabulary + ["zz"], k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items)[3].split()
            a = rng.randrange(len(w))
            words += [x.upper() for x in w[a : a + rng.randint(3, 30)]] + ["cut"] * rng.randint(0, 1)
        docs.append((k, ", ".join(words)))
    got = {(r["doc_id"], r["item_id"]): r["exact_tokens"] for r in leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS), block=5).collect() if r["exact_tokens"]}
    want = {(d, i): n for d, t in docs for i, _, _, x in items if (n := brute(t, x, False)[0])}
    assert got == want


def test_characters_markup_case_and_tolerance(spark):
    zh = "1158年，昀熙州议会雇昀璟韶抄写了239卷淳晟式经文。至今还在争论。"
    en = "the quick brown fox jumps over the lazy dog and runs far away from here"
    items = spark.createDataFrame([(1, "s", "zh", zh), (2, "s", "en", en), (3, "s", "en", None), (None, "s", "en", en), (4, "s", "en", "too short")], ITEMS)
    docs = spark.createDataFrame(
        [
            (1, "前面 1158 年，昀熙州议会、雇昀璟韶抄写了 239 卷", "x"), (2, "<b>THE</b> quick, brown fox\njumps over the lázy dog", "x"), (3, "the quick brown fox", "x"),
            (4, "the quick brown cat jumps over the lazy dog and runs far", "x"), (5, None, "x"), (6, "", "x"), (None, en, "x"), (7, "too short", "x"),
        ], "doc_id long, text string, item_id string",
    )
    got = {(r["doc_id"], r["item_id"]): r for r in leaks.find_leaks(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 2), (4, 2)}
    assert got[1, 1]["exact_tokens"] >= 12 and got[2, 2]["exact_tokens"] == 9
    assert got[4, 2]["tolerant_tokens"] == 12 and got[4, 2]["exact_tokens"] == 8
    assert leaks.find_leaks(docs.limit(0), items).count() == 0 and leaks.find_leaks(docs, items.limit(0)).count() == 0
