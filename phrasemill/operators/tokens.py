"""Documents to tokens and sentences, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stopwords import language_of, stopword_table
from . import batches as B


def tokens(docs: DataFrame, extra_stopwords: Iterable[str] = (), min_length: int = 1, by_doc: bool = False) -> DataFrame:
    """doc_id, lang, token_idx, sentence_idx, text, lemma, pos, start, end, is_stopword, in no order.

    Offsets count characters from the start of the document; token_idx and sentence_idx count from 0.  Words are numbered
    where the document is read, array by array; nothing is shuffled.  by_doc brings a document's tokens together,
    for what groups by document more than once; words shorter than min_length aren't tokens.
    """
    words = B.relation(docs, B.token_rows, B.TOKENS, extra_stopwords, min_length)
    return words.repartition("doc_id") if by_doc else words


def flag_stopwords(rows: DataFrame, extra: Iterable[str] = (), code: Column | None = None) -> DataFrame:
    """rows(text, lang, ...) with is_stopword: the lower-case text is in its language's list; code is the list's key, if it is known.

    The lists are a table of fixed size (18 languages, a few thousand words), so this join broadcasts it.
    """
    stop = F.broadcast(stopword_table(rows.sparkSession, extra))
    code = language_of(rows["lang"]) if code is None else code
    joined = rows.withColumn("_code", code).withColumn("_low", F.lower("text")).join(stop, (F.col("_code") == F.col("stop_lang")) & (F.col("_low") == F.col("stop_word")), "left")
    return joined.withColumn("is_stopword", F.col("stop_word").isNotNull()).drop("_code", "_low", "stop_lang", "stop_word")


def sentences(tokens_: DataFrame) -> DataFrame:
    """doc_id, sentence_idx, start_token, end_token (exclusive), start, end, n_tokens, of sentences with a token."""
    return tokens_.groupBy("doc_id", "sentence_idx").agg(
        F.min("token_idx").alias("start_token"),
        (F.max("token_idx") + 1).alias("end_token"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.count("*").alias("n_tokens"),
    )
