"""Scanned pages: noise made on purpose, found and repaired."""

from foliant.llm import scan as S

BLOCKS = "book_id string, page_number int, block_ix int, text string, block_type string, title string"
BOOKS = "book_id string, title string, author string"
CLEAN = "The patient reader walked towards the narrow harbour and opened the second letter under the yellow lamp."


def test_lines():
    for line in ("8", "[8]", "– 8 –", "· 8 ·", "p. 8", "Page 8", "pág. 8", "Seite 8", "8 / 27", "viii", "8.", "VIII"):
        assert S.is_page_number(line, 8), line
    for line in ("9", "1837", "8 apples", "Chapter 8", "", "8 9", "8. Der Sturm"):
        assert not S.is_page_number(line, 8), line
    assert S.split_furniture("THE OLD RIVER  |  · 6 ·", 6) == ("THE OLD RIVER", True)
    assert S.split_furniture("Page 6 The old river", 6) == ("The old river", True)
    assert S.split_furniture("The old river", 6) == ("The old river", False)


def test_misreadings():
    for read, printed in (("towarcls", "towards"), ("hcar", "hear"), ("scariner", "scanner"), ("vvidow", "widow"), ("markef", "market"), ("book5eller", "bookseller"), ("c1osed", "closed"), ("l6gère", "légère"), ("p@ssed", "passed"), ("ſtorm", "storm")):
        assert S.misreading(read, printed), read
        assert set(S.skeletons(read)) & set(S.skeletons(printed)), read
    assert not S.misreading("tür", "für") and not S.misreading("market", "market") and not S.misreading("reader", "leader")


def noisy(spark):
    rows = [("a", 1, 0, "The Old River", "heading", "x")] + [("a", p, 0, "THE OLD RIVER" if p % 2 else "THE OLD R1VER  |  " + str(p), "other", "x") for p in range(2, 8)]
    rows += [("a", p, 1, CLEAN + " It is a well-known letter.", "paragraph", "x") for p in range(1, 8)]
    rows += [("a", p, 9, f"– {p} –", "paragraph", "x") for p in (1, 3, 5)]
    rows += [
        ("a", 2, 2, "The pat-\nient reader opened the second letter.", "paragraph", "x"), ("a", 3, 2, "It is a well-\nknown letter.", "paragraph", "x"), ("a", 4, 2, "The reacler opened the sccond letter.", "paragraph", "x"),
        ("a", 5, 2, "The reader walked to-", "paragraph", "x"), ("a", 6, 2, "wards the harbour.", "paragraph", "x"), ("a", 6, 3, "6", "table_cell", "x"), ("a", 7, 2, "", "paragraph", "x"), ("a", 7, 3, None, "paragraph", "x"),
        ("a", 2, 2, "The pat-\nient reader opened the second letter.", "paragraph", "x"), (None, 1, 1, "x", "paragraph", "x"), ("b", 1, 0, "Alone.", None, "x"), ("b", 1, 1, "word " * 20000, "paragraph", "x"),
    ]
    # the first running text of page 6 goes last, so that the broken word's rest follows it
    rows = [("a", 6, 4, t, k, x) if (b, p, i) == ("a", 6, 1) else (b, p, i, t, k, x) for b, p, i, t, k, x in rows]
    return spark.createDataFrame(rows, BLOCKS), spark.createDataFrame([("a", "The old river", None), ("a", "The old river", None), ("b", None, None)], BOOKS)


def test_noise_and_repair(spark):
    blocks, books = noisy(spark)
    fixed = S.clean_blocks(blocks, books)
    fixed = fixed.cache()
    found = {(r["page_number"], r["block_ix"], r["noise"]) for r in S.noise_of(fixed).where("book_id = 'a'").collect()}
    want = {(p, 0, "header") for p in range(2, 8)} | {(p, 0, "pagenum") for p in (2, 4, 6)} | {(p, 9, "pagenum") for p in (1, 3, 5)} | {(2, 2, "hyphen"), (5, 2, "hyphen"), (4, 2, "misread")}
    assert found == want
    text = {(r["page_number"], r["block_ix"]): r["text"] for r in fixed.where("book_id = 'a'").collect()}
    assert text[2, 2] == "The patient reader opened the second letter." and text[3, 2] == "It is a well-known letter." and text[4, 2] == "The reader opened the second letter."
    made = [r["text"] for r in S.paragraphs(fixed).where("book_id = 'a'").orderBy("page_number", "block_ix").collect()]
    assert "The reader walked towards the harbour." in made and not any("RIVER" in t for t in made)
    assert S.clean_blocks(blocks.limit(0), books).count() == 0


def test_paragraphs_cross_buckets(spark):
    rows = [("a", p, 0, f"Sentence {p} goes", "paragraph", "x") if p == S.BUCKET - 1 else ("a", p, 0, "on and ends here." if p == S.BUCKET else f"Leaf {p} has a sentence.", "paragraph", "x") for p in range(1, 2 * S.BUCKET + 3)]
    fixed = S.clean_blocks(spark.createDataFrame(rows, BLOCKS), spark.createDataFrame([], BOOKS))
    made = [r["text"] for r in S.paragraphs(fixed).orderBy("page_number").collect()]
    assert f"Sentence {S.BUCKET - 1} goes on and ends here." in made and len(made) == 2 * S.BUCKET + 1


def test_both_ways_of_linking_agree(spark, monkeypatch):
    blocks, books = noisy(spark)
    few = sorted(map(tuple, S.noise_of(S.clean_blocks(blocks, books)).collect()))
    monkeypatch.setattr(S, "BROADCAST_WORDS", -1)
    assert sorted(map(tuple, S.noise_of(S.clean_blocks(blocks, books)).collect())) == few


def in_one_go(rows):
    """Paragraphs of one book without buckets."""
    import re

    out, current = [], None
    for _, page, ix, text, prose, opened in sorted(r for r in rows if r[3]):
        low = text[:1].islower() or text[:1].isdigit()
        if prose and current is not None and low:
            before = out[current][2]
            out[current][2] = re.sub(f"[{S.HYPHENS}]\\s*$", "", before) + text if S._END_HYPHEN.search(before) else f"{before} {text}"
        else:
            out.append([page, ix, text])
        if prose:
            current = (current if current is not None and low else len(out) - 1) if opened else None
    return sorted(map(tuple, out))


def test_paragraphs_lose_no_text_at_buckets(spark):
    import random

    schema = "book_id string, page_number int, block_ix int, text string, prose boolean, open boolean"
    books = {
        "ends": [("ends", 39, 0, "The end.", True, False), ("ends", 40, 0, "1984 was a cold year.", True, False)],
        "long": [("long", p, 0, "The start" if p == 39 else "goes on", True, True) for p in range(39, 43)] + [("long", 43, 0, "and ends.", True, False)],
        "far": [("far", 39, 0, "It breaks off", True, True), ("far", 170, 0, "and ends here.", True, False), ("far", 171, 0, "low again.", True, False)],
        "through": [("through", 2, 0, "A long para-", True, True)] + [("through", p, 0, "graph" if p == 3 else "more", True, True) for p in range(3, 130)] + [("through", 130, 1, "end.", True, False)],
        "low": [("low", 0, 0, "begins low.", True, False), ("low", 80, 0, "begins low again", True, True)],
    }
    draw = random.Random(3)
    for k in range(12):
        b = f"random{k}"
        books[b] = [(b, p, x, draw.choice(["Up", "low", "7 digits", "bro-", "1-", "two words-", "", "Table"]), draw.random() < 0.8, draw.random() < 0.8) for p in range(170) if draw.random() < (0.9 if k % 2 else 0.1) for x in range(draw.randrange(4))]
    made = {b: [] for b in books}
    for r in S.paragraphs(spark.createDataFrame([r for rows in books.values() for r in rows], schema)).collect():
        made[r["book_id"]].append((r["page_number"], r["block_ix"], r["text"]))
    for b, rows in books.items():
        assert sorted(made[b]) == in_one_go(rows), b
    assert len(made["ends"]) == 2 and [t for _, _, t in made["long"]] == ["The start goes on goes on goes on and ends."]


def test_misread_words_beside_dashes_and_spaces(spark):
    rows = [("a", p, 0, CLEAN, "paragraph", "x") for p in range(1, 60)]
    texts = ("She waited—the reacler came.", "The reacler… went.", "The letter/reacler went.", "The\u00a0reacler\twent.", "The letter–reacler  went.")
    rows += [("a", 90, 0, "See https://x.org/reacler/a there.", "paragraph", "x")] + [("a", 60 + k, 0, t, "paragraph", "x") for k, t in enumerate(texts)]
    fixed = S.clean_blocks(spark.createDataFrame(rows, BLOCKS), spark.createDataFrame([], BOOKS)).where("page_number >= 60").orderBy("page_number").collect()
    assert fixed.pop()["text"] == "See https://x.org/reacler/a there."
    assert [r["text"] for r in fixed] == [t.replace("reacler", "reader") for t in texts]
    assert all(r["misread"] for r in fixed)


def test_both_ways_of_linking_agree_on_broken_compounds(spark, monkeypatch):
    rows = [("a", p, 0, CLEAN + " It is a well-known letter.", "paragraph", "x") for p in range(1, 30)]
    rows += [("a", 40, 0, "It is a wcll-known letter.", "paragraph", "x"), ("a", 41, 0, "It is a wcll-\nknown letter.", "paragraph", "x"), ("a", 42, 0, "One—reac-\nler, and the rea-\nder/letfer.", "paragraph", "x"), ("a", 43, 0, "The letfer of a reacler.", "paragraph", "x")]
    blocks, books = spark.createDataFrame(rows, BLOCKS), spark.createDataFrame([], BOOKS)
    few = sorted(map(tuple, S.clean_blocks(blocks, books).drop("header", "pagenum").collect()))
    assert [r[4] for r in few if r[1] == 41] == ["It is a well-known letter."]
    monkeypatch.setattr(S, "BROADCAST_WORDS", -1)
    assert sorted(map(tuple, S.clean_blocks(blocks, books).drop("header", "pagenum").collect())) == few


SAID = ("The judge said that the {} was right.", "Every day the {} walked with a stick.", "A letter came for the {} at noon.", "The old {} had a white beard.")
KEPT = ("Her hands were {} and dry now.", "Keep the glass {} after use.", "It was a very {} white shirt.", "They made it {} with hot water.")


def company_rows(right: str, read: str, own: list[str]):
    """Blocks in which `right` is usual, `read` is once its misreading, and in own sentences a word of its own."""
    other = [s.format(w) for s in KEPT for w in ("bright", "warm", "fresh", "smooth")]
    text = [s.format(right) for s in SAID for _ in range(12)] + other * 6 + own
    return [("a", 1, k, t, "paragraph", "x") for k, t in enumerate(text)]


def test_a_right_word_survives_its_frequent_likeness(spark):
    own = [s.format("clean") for s in KEPT]
    rows = company_rows("dean", "clean", own)
    blocks, books = spark.createDataFrame(rows, BLOCKS), spark.createDataFrame([], BOOKS)
    assert S.misreading("clean", "dean")
    fixed = S.clean_blocks(blocks, books).orderBy("block_ix").collect()
    assert [r["text"] for r in fixed[-4:]] == own and not any(r["misread"] for r in fixed)
    misread = S.clean_blocks(spark.createDataFrame(company_rows("dean", "clean", [s.format("clean") for s in SAID]), BLOCKS), books).orderBy("block_ix").collect()
    assert [r["text"] for r in misread[-4:]] == [s.format("dean") for s in SAID] and all(r["misread"] for r in misread[-4:])


def test_one_occurrence_is_judged_by_its_company(spark):
    blocks = spark.createDataFrame(company_rows("hear", "bear", [KEPT[0].format("bear"), SAID[3].format("bear")]), BLOCKS)
    fixed = S.clean_blocks(blocks, spark.createDataFrame([], BOOKS)).orderBy("block_ix").collect()
    assert fixed[-2]["text"] == KEPT[0].format("bear") and fixed[-1]["text"] == SAID[3].format("hear")


def test_vectors_decide():
    import numpy as np

    draw = np.random.default_rng(3)
    reference = S.unit(draw.standard_normal((100, S.DIMENSIONS)))
    v = S.unit(draw.standard_normal(S.DIMENSIONS))
    target = {"n": 50, "target": "dean", "vector": v.tolist(), "proven": False}
    assert S.in_context(v, [target], False, reference) == "dean" and S.in_context(-v, [target], False, reference) is None and S.in_context(-v, [target], True, reference) == "dean"
    assert S.in_context(0 * v, [target], False, reference) is None and S.in_context(0 * v, [target | {"proven": True}], False, reference) == "dean"
    assert S.in_context(v, [target, {"n": 5000, "target": "clear", "vector": (-v).tolist(), "proven": False}], False, reference) == "dean"
    near, far = np.rint(v * S.SCALE) * 40, np.rint(reference[0] * S.SCALE) * 40
    assert S.keeps_company(np.rint(v * S.SCALE) * 4, 4, near, 40, reference) and not S.keeps_company(np.rint(v * S.SCALE) * 4, 4, far, 40, reference)
    c = S.Company(["a", "b", "c"], np.array([[0, 4, 1], [4, 0, 1], [1, 1, 0]]))
    assert c.vectors.shape == (4, S.DIMENSIONS) and not c.vectors[3].any()


def test_hyphens_beside_digits_and_compounds_over_blocks(spark):
    rows = [("a", p, 0, CLEAN + " It is a well-known letter.", "paragraph", "x") for p in range(1, 30)]
    rows += [("a", 40, 0, "The years 1914-\n1918 and 12-\n34 were cold.", "paragraph", "x"), ("a", 41, 0, "It is a well-", "paragraph", "x"), ("a", 300, 0, "known letter of the nar-", "paragraph", "x"), ("a", 700, 0, "row lane.", "paragraph", "x")]
    fixed = S.clean_blocks(spark.createDataFrame(rows, BLOCKS), spark.createDataFrame([], BOOKS)).cache()
    noise = {(r["page_number"], r["noise"]) for r in S.noise_of(fixed).collect()}
    assert noise == {(300, "hyphen")}
    made = {r["page_number"]: r["text"] for r in S.paragraphs(fixed).collect()}
    assert made[40] == "The years 1914-1918 and 12-34 were cold." and made[41] == "It is a well-known letter of the narrow lane."


def test_ambiguous_glyphs_have_all_readings():
    assert len(S.skeletons("6a6b6")) == 8 * 2 and S.skeletons("6666a") == ()


def test_rows_that_differ_under_one_key(spark):
    rows = [("a", 1, 0, "Second text here.", "paragraph", "x"), ("a", 1, 0, "First text here.", "paragraph", "x")]
    assert [r["text"] for r in S.clean_blocks(spark.createDataFrame(rows * 2, BLOCKS), spark.createDataFrame([], BOOKS)).collect()] == ["First text here."]


def test_links_are_compared_with_every_frequent_word(spark, monkeypatch):
    words = [f"{a}{b}{c}wort" for a in "bdgkmnprst" for b in "aeiou" for c in "dgkmnprstbvwxz"]
    rows = [("a", p, k, " ".join(words[k * 14 : k * 14 + 14]) + " the und.", "paragraph", "x") for p in range(1, 7) for k in range(50)]
    seen = []
    real = S.repair
    monkeypatch.setattr(S, "repair", lambda bodies, judged, linked, company, reference: seen.append(reference) or real(bodies, judged, linked, company, reference))
    for bound in (S.BROADCAST_WORDS, -1):
        monkeypatch.setattr(S, "BROADCAST_WORDS", bound)
        S.clean_blocks(spark.createDataFrame(rows, BLOCKS), spark.createDataFrame([], BOOKS)).count()
    assert len(words) == 700 and [r.shape for r in seen] == [(702, S.DIMENSIONS)] * 2 and (seen[0] == seen[1]).all()
