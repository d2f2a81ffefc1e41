"""Text expressions against plain models."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import blocks as B
from foliant.functions import text as T

SPACES = "\t\n\v\f\r \x85\xa0    　"


def frame(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")


def column(spark, texts, expression):
    return [r["x"] for r in frame(spark, texts).select("k", expression.alias("x")).orderBy("k").collect()]


def model_sentences(text):
    out, cur, k = [], "", 0
    while k < len(text):
        cur += text[k]
        if text[k] in ".!?。！？\n" and k + 1 < len(text) and text[k + 1] in SPACES:
            out.append(cur)
            cur = ""
            k += 1
            while k < len(text) and text[k] in SPACES:
                k += 1
            continue
        k += 1
    return [s.strip(SPACES) for s in [*out, cur] if s.strip(SPACES)]


def model_pack(sentences, budget):
    done, open_, used = [], [], 0
    for s in sentences:
        n = math.ceil(len(s) / 4)
        if n > budget:
            if open_:
                done.append(" ".join(open_))
            done += [s[i : i + 4 * budget] for i in range(0, len(s), 4 * budget)]
            open_, used = [], 0
        elif open_ and used + n > budget:
            done.append(" ".join(open_))
            open_, used = [s], n
        else:
            open_, used = [*open_, s], used + n
    return [*done, " ".join(open_)] if open_ else done


def test_sentences(spark):
    assert column(spark, ["First. Second! Third?", "", None, " \n ", "a.b", "一。 二？"], T.sentences(F.col("text"))) == [
        ["First.", "Second!", "Third?"], [], None, [], ["a.b"], ["一。", "二？"],
    ]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab. !\n。　x\U0001f600", max_size=80), min_size=20, max_size=40))
def test_sentences_and_chunks_follow_the_model(spark, texts):
    assert column(spark, texts, T.sentences(F.col("text"))) == [model_sentences(t) for t in texts]
    assert column(spark, texts, T.pack(T.sentences(F.col("text")), 3)) == [model_pack(model_sentences(t), 3) for t in texts]


def test_chunks_stay_in_budget(spark):
    made = column(spark, ["a" * 200, "First sentence.   Second sentence.", ""], T.pack(T.sentences(F.col("text")), 10))
    assert len(made[0]) == 5 and all(len(c) <= 40 for c in made[0]) and made[1] == ["First sentence. Second sentence."] and made[2] == []


def test_lines_and_paragraphs(spark):
    assert column(spark, ["Line one\nLine two\n", "", "a\r\n\r\nb", None], T.lines(F.col("text"))) == [["Line one", "Line two"], [], ["a", "", "b"], None]
    assert column(spark, ["a\nb\n\n c  d \n\n\n", ""], T.paragraphs(F.col("text"))) == [["a b", "c d"], []]
    assert column(spark, ["a\nb\nc", "a", "a\n "], T.other_lines(F.col("text"))) == ["b\nc", None, None]


def test_escape(spark):
    assert column(spark, ["<a & 'b' \"c\">"], T.escape(F.col("text"))) == ["&lt;a &amp; &apos;b&apos; &quot;c&quot;&gt;"]


def test_anomaly(spark):
    got = column(spark, ["", "abc", "????", "��", "aaaab"], T.anomaly(F.col("text")))
    assert got == [0.0, 0.0, pytest.approx(1.0), pytest.approx(1.0), pytest.approx(0.64)]


def test_formats_and_names(spark):
    assert column(spark, ["a/b.EPUB", "x.azw3", "x.xyz", "noext", ".srt"], T.book_format(F.col("text"))) == ["epub", "mobi", None, None, None]
    assert column(spark, ["/EPUB/ch01.xhtml", "/", "1chapter.xhtml"], T.manifest_id(T.clean_href(F.col("text")))) == ["ch01.xhtml", "index.xhtml", "i1chapter.xhtml"]
    assert column(spark, ["zh_CN.UTF-8", "en"], T.locale(F.col("text"))) == ["zh-CN", "en"]
    name = T.output_name(F.col("text"), F.lit("/x/book.epub"), F.lit("en"), F.lit("de"), F.lit("bilingual"))
    assert column(spark, ["{stem}-{target_lang}", " ", None], name) == ["book-de", "book_de", "book_de"]


def test_json_helpers(spark):
    assert column(spark, ['{"a": "x // y", /* c */ "b": 1} // end'], T.strip_json_comments(F.col("text"))) == ['{"a": "x // y",  "b": 1} ']
    assert column(spark, ["```json\n{}\n```", "{}"], T.strip_fences(F.col("text"))) == ["{}", "{}"]
    assert column(spark, ['{"choices":[{"message":{"content":"a"}}]}', '{"content":[{"text":"b"}]}', '{"message":{"content":"c"}}', "no"], T.answer_text(F.col("text"))) == ["a", "b", "c", None]
    boxes = column(spark, ['{"x":1,"y":2,"w":3,"h":4}', "[1,2,3,4]", "[1,2,3,4,5]", '{"x":1}', "[1,2]", "[1,2,3,-4]", None], B.box(F.col("text")))
    assert [b and tuple(b) for b in boxes] == [(1, 2, 3, 4)] * 3 + [None] * 4


def test_close_matches(spark):
    rows = spark.createDataFrame([("1.1details", "1.1details"), ("abcdefghij", "abcdefgh"), ("abcdefghij", "abc")], "a string, b string")
    assert [r[0] for r in rows.select(T.is_close(F.col("a"), F.col("b"))).collect()] == [True, True, False]


def test_block_predicates(spark):
    texts = ["229", "890 - 905.", "12345", "-", "text", "", "Chapter 3: x", "Output format: json", "[12]"]
    assert column(spark, texts, B.is_page_number(F.col("text"))) == [True, True, False, True, False, False, False, False, False]
    assert column(spark, texts, B.is_leaked(F.col("text"))) == [False] * 6 + [True, True, False]
    assert column(spark, texts, B.is_artifact(F.col("text")))[-1] is True
    heads = ["Abstract", "1 Chapter", "1.1 Sub", "第1章", "第一", ""]
    assert column(spark, heads, B.is_top_heading(F.col("text"))) == [True, True, False, True, False, False]


def test_budget_and_prompt(spark):
    row = spark.range(1).select(
        T.source_budget(F.lit(4000), F.lit(2000), F.lit(100)).alias("a"), T.source_budget(F.lit(10), F.lit(10), F.lit(100)).alias("b"),
        T.fill_prompt(F.lit("{source_lang}>{target_lang}"), F.lit("auto"), F.lit("de"), T.glossary_lines(F.array(F.struct(F.lit("t").alias("term"), F.lit("u").alias("translation"))))).alias("c"),
        T.duration(F.lit(3725)).alias("d"), T.duration(F.lit(65)).alias("e"),
    ).first()
    assert tuple(row) == (1800, 1, "the original language>de\nUse the following glossary:\n- t => u\n", "1:02:05", "1:05")


def test_job_key_changes_with_each_part(spark):
    base = ["p", "de", "bilingual", "x", "m"]
    rows = [base] + [[*base[:k], base[k] + "2", *base[k + 1 :]] for k in range(5)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    keys = [r[0] for r in df.select(T.job_key(*[F.col(c) for c in "abcde"])).collect()]
    assert len(set(keys)) == 6 and all(re.fullmatch("[0-9a-f]{16}", k) for k in keys)
