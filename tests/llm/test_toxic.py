"""Content scores: spellings, contexts and exceptions."""

import pytest

from foliant.llm import toxic as X

LEXICON = [("idiot", "abuse", 0.5), ("vermin", "hate", 0.45), ("porn", "sexual", 0.45), ("kill", "abuse", 0.35), ("cock", "sexual", 0.45)]


@pytest.fixture(scope="module")
def matcher():
    return X.Matcher(LEXICON)


def found(m, text):
    return {c for c, v in m.judge(m.hits(text)).items() if v >= X.THRESHOLD}


@pytest.mark.parametrize("text", ["You are an idiot, Bob.", "You are an 1d10t.", "YOU ARE AN I D I O T, BOB", "You are an id​iot.", "You are an іdіоt.", "you i*iot", "Du bist ein Arschloch.", "Fuck off.", "You are a b*****d."])
def test_abuse(matcher, text):
    assert found(matcher, text) == {"abuse"}


@pytest.mark.parametrize("text", ['"You idiot," she told the mirror.', "We had to kill the process.", "The cock crowed.", "The handbook on sexual health explains it.", "", "The plan was idiotic", "const vrup_x = load(3)", "The glossary marks \"vermin\" as an insult."])
def test_harmless(matcher, text):
    assert not found(matcher, text)


def test_categories(matcher):
    assert found(matcher, "They are vermin and should be driven out of town.") == {"hate"}
    assert found(matcher, "Uncensored porn clips, every night. You idiot!") == {"sexual", "abuse"}


def test_rows_weights_and_rates(spark):
    lexicon = spark.createDataFrame([(1, "idiot", "abuse", 3), (2, "idiot", "abuse", 3), (3, None, "abuse", 1), (4, "x", None, 1)], "entry_id long, term string, category string, severity int")
    rows = [(1, "You idiot!", "s", "x"), (2, "All is well.", "s", "x"), (3, None, "s", "x"), (4, "", "t", "x"), (5, "You idiot!", None, "x"), (None, "You idiot!", "s", "x"), (1, "You idiot!", "s", "x"), (6, "You idiot! " * 20000, "t", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, abuse string")
    labels = spark.createDataFrame([(1, "a", "abuse"), (1, "a", "abuse"), (1, "b", "none"), (2, "a", "none"), (None, "a", "none"), (5, "a", None)], "doc_id long, reviewer string, verdict string")
    scores = X.score_documents(docs, lexicon, labels)
    assert sorted(map(tuple, X.cases(scores).collect())) == [(1, "abuse"), (5, "abuse"), (6, "abuse")]
    rates = {r["source"]: (r["documents"], r["abuse_share"]) for r in X.source_rates(scores).collect()}
    assert rates == {"s": (4, 0.5), "t": (2, 0.5), None: (1, 1.0)}
    assert {r["doc_id"]: r["abuse"] for r in scores.collect()}[2] == 0.0 and scores.count() == 7  # every document has a score
    assert X.score_documents(docs, lexicon.limit(0), labels.limit(0)).count() == scores.count()
    assert X.score_documents(docs.limit(0), lexicon, labels).count() == 0


def test_reviews_move_weights(spark):
    lexicon = spark.createDataFrame([(1, "bloody", "abuse", 2)], "entry_id long, term string, category string, severity int")
    docs = spark.createDataFrame([(k, "A bloody good day.", "s") for k in range(30)], "doc_id long, text string, source string")
    rows = X.read_lexicon(lexicon)
    labels = lambda v: spark.createDataFrame([(k, "a", v) for k in range(30)], "doc_id long, reviewer string, verdict string")
    low, high = (X.learn(docs, labels(v), rows).entries["bloody"][0][2] for v in ("none", "abuse"))
    assert low < rows[0][2] < high


def test_reviews_teach_runs_of_words(spark):
    calm = ["The harbour was quiet at noon.", "A letter came for the clockmaker.", "We counted every lamp in the street."]
    rows = [(k, f"{calm[k % 3]} May your kettle never boil again. {calm[(k + 1) % 3]}" if k < 8 else f"{calm[k % 3]} The kettle boils at noon. {calm[(k + 1) % 3]}", "s") for k in range(200)]
    docs = spark.createDataFrame([*rows, (500, "May your kettle never boil, friend.", "s"), (501, "The kettle boils.", "s")], "doc_id long, text string, source string")
    # two wrong reviews in conflict with others, one confirmed document that shares nothing
    labels = spark.createDataFrame([(k, "a", "abuse" if k < 8 or k == 100 else "none") for k in range(200)] + [(3, "b", "none"), (3, "c", "abuse")], "doc_id long, reviewer string, verdict string")
    lexicon = spark.createDataFrame([], "entry_id long, term string, category string, severity int")
    found = {r["doc_id"] for r in X.cases(X.score_documents(docs, lexicon, labels)).collect()}
    assert found == {*range(8), 500}
    matcher = X.learn(docs, labels, [])
    assert "may your kettle never" in matcher.entries and not any(e in matcher.entries for e in ("the harbour was quiet", "letter came for the", "kettle"))
    assert X.beyond_chance(3, 3, 0.5) == pytest.approx(0.125) and X.beyond_chance(0, 3, 0.5) == 1.0


@pytest.mark.parametrize(("category", "text"), [("abuse", "Ты идиот, Иван."), ("abuse", "你这个白痴,走开。"), ("abuse", "お前はバカだ。"), ("abuse", "Чтоб ты сдох!"), ("abuse", "我要杀了你"), ("hate", "外国人は国へ帰れ。"), ("hate", "他们都是寄生虫。"), ("abuse", "Sei un coglione.")])
def test_languages_without_spaces_or_latin_letters(matcher, category, text):
    assert found(matcher, text) == {category}


@pytest.mark.parametrize("text", ["バカンスに行きたい。", "この本ばかり読んでいた。", "他打开窗户,看着河。", "Он прочитал слово и закрыл книгу.", "垃圾桶在门口。", "Это слово — «идиот» — как оскорбление."])
def test_harmless_in_such_languages(matcher, text):
    assert not found(matcher, text)


def test_hints_count_less_in_long_sentences(matcher):
    near, far = "The vermin and parasites, like vermin of thieves", "The vermin " + "of the old and quiet harbour where nobody ever walks at noon or night " * 20 + " parasites thieves"
    score = lambda t: matcher.judge(matcher.hits(t)).get("hate", 0.0)
    assert score(near) > 2 * score(far) > 0


#: Written for the test, in other words than the test tables have.
UNSEEN = [
    ("abuse", "I will break both your arms, little man."), ("abuse", "We are going to kill you, traitor."), ("abuse", "I hope your whole family dies in a fire and you rot."),
    ("abuse", "What a worm you are."), ("abuse", "We know where you live, Martin."), ("abuse", "Ich schlage dir die Zähne ein."), ("abuse", "On va te péter la tête."), ("abuse", "Te rompo las piernas."),
    ("abuse", "Du bist ein Schwein."), ("abuse", "You will regret the day we met."),
    ("hate", "The northerners are nothing but savages."), ("hate", "These migrants should be deported or hunted."), ("hate", "Kick the gypsies out of our village."), ("hate", "They multiply like cockroaches."),
    ("hate", "Die Zugewanderten sind Abschaum."), ("hate", "Il faut les exterminer."), ("hate", "Los vecinos del norte son escoria."), ("hate", "Our country would be safer without those believers."), ("hate", "We must burn their mosque."),
    ("sexual", "He pushed his tongue over her nipples."), ("sexual", "She lay naked and moaned as he entered."), ("sexual", "Free hardcore porn, hot couples tonight."), ("sexual", "Er vögelte sie, nackt und stöhnend; sie fickten."), ("sexual", "Jadeaba desnuda sobre la cama."),
]
CALM = [
    "The rabbits breed quickly and the fox is shy.", "We should burn the old letters in the house.", "The doctor looked at her naked shoulder and throat.", "They are not animals, they are people.", "I know where you put the keys.",
    "The parcels should be sent back.", "You are not a pig.", "He broke his leg in the snow.", "Jump to the next page, please.", "Die Ratten waren im Keller.", "The world would be better with more books.",
    "The word vermin is an insult.", "Dick held his tongue.", "The thieves took the lamp.", "He kissed her hands and face.", "Les voleurs ont pris la lampe.",
]


def test_constructions_find_other_words(matcher):
    right = [c in found(matcher, t) for c, t in UNSEEN]
    assert sum(right) >= 0.9 * len(UNSEEN), [t for (_, t), r in zip(UNSEEN, right, strict=True) if not r]
    assert not [t for t in CALM if found(matcher, t)]


def test_no_sentence_of_a_document_is_an_entry():
    for piece in ("once sold at market it suited them", "touch a book they breed", "deserves to lose its windows", "eating through a straw", "translation i want my money", "behind the shop", "told the mirror", "eaten the bindings"):
        assert piece not in X.Matcher([]).entries
    assert all(len(e.split()) <= 5 for e in X.Matcher([]).entries if not e.startswith("@") and not X._WIDE.search(e))


@pytest.mark.parametrize("text", ["You b!tch.", "You sh!thead, go.", "You b!!ch", "Du bist ein Miiiistkerl.", "You idiooot!", "You asssshoooole", "youuu moron", "You b!!!!tch", "you miiiistk*rl", "Fuuuuck off.", "You I D I O O O T"])
def test_masks_and_stretched_letters(matcher, text):
    assert "abuse" in found(matcher, text)


def test_stretched_words_that_are_none(matcher):
    for text in ("You said hmmm and aaah, brrr.", "You sooo good, reader!", "You wait!now", "The www address is yours."):
        assert not found(matcher, text)


def test_gate_admits_all_that_unmasking_changes(matcher, data, monkeypatch):
    import random
    import re

    import pyarrow.parquet as pq

    draw = random.Random(5)
    texts = ["".join(draw.choice("bitchasé1!5_*$ .ж٣") for _ in range(12)) for _ in range(20_000)] + ["you " + w[:k] + draw.choice("!1*é٣") * n + w[k + n :] for w in sorted(matcher.words) for k in range(1, len(w)) for n in (1, 2)]
    texts += [t for t in pq.read_table(f"{data}/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    gated = [matcher.fold(t) for t in texts]
    monkeypatch.setattr(X, "_SIGN_INSIDE", re.compile(""))
    assert [t for t, g in zip(texts, gated, strict=True) if matcher.fold(t) != g] == []


def test_all_terms_are_read(spark):
    lexicon = spark.range(100_050).selectExpr("concat('term', id) term", "'hate' category", "1 severity")
    assert len(X.read_lexicon(lexicon)) == 100_050
