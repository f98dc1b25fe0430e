"""Candidates and word graphs as relations keyed by doc_id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

INCLUDE = ("NOUN", "ADJ", "PROPN", "VERB")


def kept(pos: Column, stop: Column, include: Sequence[str] = INCLUDE) -> Column:
    return ~stop & pos.isin(*(include or T.CONTENT_TAGS))


def occurrences(tokens: DataFrame, include: Sequence[str] = INCLUDE, use_pos: bool = True) -> DataFrame:
    """doc_id, sentence_idx, token_idx, key, lemma: the tokens that the graph is made of."""
    return tokens.where(kept(F.col("pos"), F.col("is_stopword"), include)).select(
        "doc_id", "sentence_idx", "token_idx", T.graph_key(F.col("lemma"), F.col("pos"), use_pos).alias("key"), "lemma"
    )


def word_candidates(occ: DataFrame) -> DataFrame:
    """doc_id, key, lemma, first_position: a node for each key."""
    return occ.groupBy("doc_id", "key").agg(F.first("lemma").alias("lemma"), F.min("token_idx").alias("first_position"))


def cooccurrences(occ: DataFrame, window: int = 3, cross_sentence: bool = False, binary: bool = False) -> DataFrame:
    """doc_id, a, b (a < b), w: how often two keys are less than ``window`` kept tokens apart, or 1 if binary.

    The look-ahead of a fixed number of rows stands for the range join.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    parts = ["doc_id"] if cross_sentence else ["doc_id", "sentence_idx"]
    w = Window.partitionBy(*parts).orderBy("token_idx")
    ahead = occ.select("doc_id", "key", F.array(*(F.lead("key", d).over(w) for d in range(1, window))).alias("ahead")).select("doc_id", "key", F.explode("ahead").alias("next"))
    pairs = ahead.where("next IS NOT NULL AND key <> next").select("doc_id", F.least("key", "next").alias("a"), F.greatest("key", "next").alias("b"))
    return pairs.groupBy("doc_id", "a", "b").agg((F.lit(1) if binary else F.count("*")).cast("double").alias("w"))


def edges(pairs: DataFrame) -> DataFrame:
    """doc_id, src, dst, w: both directions."""
    return pairs.select("doc_id", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), "w").select(
        "doc_id", "e.src", "e.dst", "w"
    )


def directed_edges(rows: DataFrame) -> DataFrame:
    """doc_id, src, dst, w: rows(doc_id, src, dst, w) with the weights of one direction added up."""
    return rows.groupBy("doc_id", "src", "dst").agg(F.sum("w").alias("w"))


def followers(occ: DataFrame) -> DataFrame:
    """doc_id, src, dst, w = 1: each key and the next one of its sentence."""
    w = Window.partitionBy("doc_id", "sentence_idx").orderBy("token_idx")
    return occ.select("doc_id", F.col("key").alias("src"), F.lead("key").over(w).alias("dst"), F.lit(1.0).alias("w")).where("dst IS NOT NULL")


def node_degrees(nodes: DataFrame, edges_: DataFrame) -> DataFrame:
    """doc_id, key, degree, total_weight; a node without an edge has 0 (it dangles)."""
    out = edges_.groupBy("doc_id", F.col("src").alias("key")).agg(F.count("*").alias("degree"), F.sum("w").alias("total_weight"))
    return nodes.join(out, ["doc_id", "key"], "left").select("doc_id", "key", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("total_weight", F.lit(0.0)).alias("total_weight"))


def dangling(nodes: DataFrame, edges_: DataFrame) -> DataFrame:
    return nodes.select("doc_id", "key").join(edges_.select("doc_id", F.col("src").alias("key")).distinct(), ["doc_id", "key"], "left_anti")


def graph_stats(degrees: DataFrame) -> DataFrame:
    """doc_id, nodes, edges (directed), avg_degree."""
    return degrees.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.sum("degree").alias("edges"), (F.sum("degree") / F.count("*")).alias("avg_degree"))


def within_limits(stats: DataFrame, max_nodes: int | None, max_edges: int | None) -> DataFrame:
    """stats with ``error``: the limit that the document's graph exceeds, told before it is ranked."""
    over = F.lit(None).cast("string")
    if max_edges is not None:
        over = F.when(F.col("edges") > max_edges, F.concat(F.lit("max_edges exceeded: "), F.col("edges"))).otherwise(over)
    if max_nodes is not None:
        over = F.when(F.col("nodes") > max_nodes, F.concat(F.lit("max_nodes exceeded: "), F.col("nodes"))).otherwise(over)
    return stats.withColumn("error", over)


def teleport(nodes: DataFrame, weight: Column) -> DataFrame:
    """doc_id, key, p: weight normalised over the document; uniform where it sums up to 0."""
    w = Window.partitionBy("doc_id")
    return nodes.select("doc_id", "key", weight.cast("double").alias("x")).select(
        "doc_id", "key", F.when(F.sum("x").over(w) > 0, F.col("x") / F.sum("x").over(w)).otherwise(F.lit(1.0) / F.count("*").over(w)).alias("p")
    )


def position_weight() -> Column:
    return F.lit(1.0) / (F.col("first_position") + 1)


def focus_weight(terms: Sequence[str], bias: float = 5.0) -> Column:
    return F.when(F.col("lemma").isin(*terms), F.lit(float(bias))).otherwise(F.lit(1.0)) if terms else F.lit(1.0)


#: rows of a caller's dictionary up to which its table is broadcast
MOST_BROADCAST = 100_000


def topic_teleport(nodes: DataFrame, weights: dict[str, float], min_weight: float = 0.0) -> DataFrame:
    """Weights by lemma, min_weight for the others: a left join with the caller's dictionary."""
    table = nodes.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "lemma string, topic_weight double")
    table = F.broadcast(table) if len(weights) <= MOST_BROADCAST else table
    return teleport(nodes.join(table, "lemma", "left"), F.coalesce("topic_weight", F.lit(float(min_weight))))


def sparse_teleport(nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """teleport() by weights(doc_id, key, weight); nodes that aren't there weigh 0."""
    own = nodes.select("doc_id", "key").join(weights.select("doc_id", "key", "weight"), ["doc_id", "key"], "left")
    return teleport(own, F.coalesce("weight", F.lit(0.0)))


def top_nodes(scores: DataFrame, n: int) -> DataFrame:
    """The n best of scores(doc_id, key, score) in each document, with rank; scores count to ten decimals, ties go by key."""
    w = Window.partitionBy("doc_id").orderBy(F.round("score", 10).desc(), "key")
    return scores.select("doc_id", "key", "score", F.row_number().over(w).alias("rank")).where(F.col("rank") <= n)


def sentence_sets(tokens: DataFrame) -> DataFrame:
    """doc_id, sentence_idx, lemmas: the distinct lemmas of the sentence's tokens that aren't stop words."""
    return tokens.groupBy("doc_id", "sentence_idx").agg(F.array_sort(F.collect_set(F.when(~F.col("is_stopword"), F.col("lemma")))).alias("lemmas"))


def sentence_similarity(sets: DataFrame, min_similarity: float = 0.0) -> DataFrame:
    """doc_id, a, b (a < b), w: Jaccard similarity of sentences where it is above min_similarity.

    Sentences meet by a shared lemma (an equi-join), not all with all; two without a lemma are alike (1).
    """
    sized = sets.select("doc_id", "sentence_idx", "lemmas", F.size("lemmas").alias("n"))
    each = sized.where("n > 0").select("doc_id", "sentence_idx", "n", F.explode("lemmas").alias("lemma"))
    other = each.select("doc_id", F.col("sentence_idx").alias("b"), F.col("n").alias("nb"), "lemma")
    both = (
        each.withColumnRenamed("sentence_idx", "a")
        .join(other, ["doc_id", "lemma"])
        .where("a < b")
        .groupBy("doc_id", "a", "b", "n", "nb")
        .agg(F.count("*").alias("common"))
        .select("doc_id", "a", "b", (F.col("common") / (F.col("n") + F.col("nb") - F.col("common"))).alias("w"))
    )
    none = sized.where("n = 0").select("doc_id", F.col("sentence_idx").alias("a"))
    empty = none.join(none.select("doc_id", F.col("a").alias("b")), "doc_id").where("a < b").select("doc_id", "a", "b", F.lit(1.0).alias("w"))
    return both.union(empty).where(F.col("w") > min(max(min_similarity, 0.0), 1.0))
