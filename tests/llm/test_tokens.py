"""Ids of the tree equal those of the whole text."""

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = "ab Z9'stlrevmd.,\n\t  é日本語。、！٣²ªـ‍\U0001f600́<|endoftext|>_-"


def whole(text):
    return tokens.encoding(PATH, tokens.PATTERN)[0].encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(ODD, max_size=120), st.integers(1, 12), st.integers(1, 8))
def test_tree_equals_whole(text, leaf, window):
    ids = tokens.encode(text, PATH, leaf=leaf, window=window)
    assert ids == whole(text)
    assert tokens.decode(ids, PATH, leaf=leaf) == text


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400))
def test_any_unicode(text):
    text = text.encode("utf-8", "ignore").decode()
    assert tokens.encode(text, PATH, leaf=5, window=2) == whole(text)


def test_long_runs():
    for text in ("字" * 5000, "a" * 5000, " " * 5000, "x y" * 3000, "it's we'll " * 900):
        assert tokens.encode(text, PATH) == whole(text)


def test_pattern_is_the_public_one():
    assert tokens.PATTERN == public_tokenizers.PATTERN


def test_corpus(spark):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (None, "<|endoftext|>", "x"), (5, "ab " * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = tokens.encode_corpus(df).collect()
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in got) == sorted((i or 0, whole(t) if t else []) for i, t, _ in rows)
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_whole_table(spark, data):
    from foliant.llm.queries import p6_ids

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["ids"] for r in p6_ids(spark, data).collect()}
    assert got == {k: whole(t) if t else [] for k, t in texts.items()}
