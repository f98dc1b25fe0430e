"""Sentences and phrases as vectors: relations behind the summaries of operators.document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit(rows: DataFrame, weight: Column, *parts: str) -> DataFrame:
    """rows with ``x``: weight over the length of the vector that the rows of one part are; rows of a vector of length 0 go."""
    size = F.sqrt(F.sum(weight * weight).over(Window.partitionBy(*parts)))
    return rows.withColumn("size", size).where("size > 0").withColumn("x", weight / F.col("size")).drop("size")


def document_vectors(phrases: DataFrame) -> DataFrame:
    """doc_id, lemma, x: phrases(doc_id, lemma, score) as a unit vector."""
    best = phrases.groupBy("doc_id", "lemma").agg(F.max("score").alias("score"))
    return unit(best, F.col("score"), "doc_id").select("doc_id", "lemma", "x")


def sentence_words(tokens: DataFrame, least: int = 5, most: int = 100) -> DataFrame:
    """doc_id, sentence_idx, words: the sentences of least to most tokens, their lemmas in order with a space around each."""
    rows = tokens.groupBy("doc_id", "sentence_idx").agg(F.array_sort(F.collect_list(F.struct("token_idx", F.lower("lemma").alias("lemma")))).alias("t"))
    words = F.concat(F.lit(" "), F.array_join(F.transform("t", lambda x: x["lemma"]), " "), F.lit(" "))
    return rows.where((F.size("t") >= least) & (F.size("t") <= most)).select("doc_id", "sentence_idx", words.alias("words"))


def phrases_in_sentences(sentences: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc_id, sentence_idx, lemma, score: the phrases whose words a sentence has, one behind the other."""
    own = phrases.groupBy("doc_id", "lemma").agg(F.max("score").alias("score"))
    return sentences.join(own, "doc_id").where(F.expr("instr(words, concat(' ', lower(lemma), ' ')) > 0")).select("doc_id", "sentence_idx", "lemma", "score")


def relevance(sentences: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc_id, sentence_idx, relevance: the cosine of each sentence's vector with the document's; 0 without a phrase."""
    vectors = unit(phrases_in_sentences(sentences, phrases), F.col("score"), "doc_id", "sentence_idx").withColumnRenamed("x", "own")
    found = vectors.join(document_vectors(phrases), ["doc_id", "lemma"]).groupBy("doc_id", "sentence_idx").agg(F.sum(F.col("own") * F.col("x")).alias("relevance"))
    return sentences.select("doc_id", "sentence_idx").join(found, ["doc_id", "sentence_idx"], "left").fillna(0.0, ["relevance"])
