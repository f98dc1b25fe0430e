"""Tokenizer, tags, lemmas and stop words: the columns and the plain functions agree."""

import pytest
from pyspark.sql import functions as F

from phrasemill.functions import text as T
from phrasemill.functions.stopwords import LISTS, StopWords, get_stopwords, language_code
from phrasemill.operators import document as D
from phrasemill.operators import tokens as K

WORDS = "running cats studies boxes beautiful quickly information Harbour the and upon not 3.14 state classes stopped tried ties passing éétée naïve I A USA usable music er goes hashes".split()
TEXTS = ["Hello world! How are you? Fine.", "Hello 👋 world! How are you? 🎉", "机器学习是人工智能的一个子集。深度学习使用神经网络。", "Dr. smith's state-of-the-art foo_bar, 3.14.\nNew line\r\n\r\nand \"quoted.\" Then", "", "   ", "...", None, "one",
         "It cost 1,000 or 1,234.5; at 10:30 a.m. see U.S.A, v.1 3.x a:b l'été 3'4 _.x x_.y 12,34,56 e.g. end.", ",".join(map(str, range(20000))), "a.b" * 20000]


@pytest.mark.parametrize("word,lemma", [("running", "run"), ("cats", "cat"), ("studies", "study"), ("boxes", "box")])
def test_lemmas(word, lemma):
    assert T.py_lemma(word) == lemma


@pytest.mark.parametrize("word,tag", [("beautiful", "ADJ"), ("running", "VERB"), ("quickly", "ADV"), ("information", "NOUN"), ("Harbour", "PROPN"), ("the", "DET"), ("3.14", "NUM"), ("not", "PART")])
def test_tags(word, tag):
    assert T.py_tag(word) == tag


def test_columns_agree_with_python(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", T.lemma_of(F.col("w")).alias("lemma"), T.tag_of(F.col("w")).alias("tag"), T.scrub(F.concat("w", F.lit(", X-1 "))).alias("scrub"))
    for r in df.collect():
        assert (r.lemma, r.tag, r.scrub) == (T.py_lemma(r.w), T.py_tag(r.w), T.py_scrub(r.w + ", X-1 ")), r.w


def test_relation_agrees_with_the_kernel(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    found = {}
    for r in K.tokens(docs).orderBy("doc_id", "token_idx").collect():
        found.setdefault(r.doc_id, []).append((r.text, r.lemma, r.pos, r.start, r.end, r.sentence_idx, r.is_stopword))
    own = D.tokenizer()
    for i, text in enumerate(TEXTS):
        assert found.get(i, []) == [tuple(t) for t in own(text, "en")], text
        for t in own(text, "en"):
            assert text[t.start : t.end] == t.text
    assert len({t.sentence_idx for t in own(TEXTS[1], "en")}) >= 2
    assert len({t.sentence_idx for t in own(TEXTS[2], "zh")}) == 2


def test_stop_words():
    assert len(LISTS) == 18 and language_code("English") == "en" and language_code("xx") == "en"
    assert "the" in get_stopwords("en") and "und" in get_stopwords("german")
    own = StopWords.with_additional("en", ["Foo"])
    assert "foo" in own and "THE" in own and "foo" not in own.remove(["foo"])
    assert "Foo" in StopWords.from_list(["Foo"], case_sensitive=True) and "foo" not in StopWords.from_list(["Foo"], case_sensitive=True)
    assert len(StopWords.empty()) == 0
