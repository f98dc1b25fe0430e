"""Noun chunks and phrases as relations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .document import Scored
from .document import resolve_overlaps as sweep
from .document import resolve_overlaps_greedy as greedy

OVERLAP_TYPES = pa.schema(
    [("doc_id", pa.int64()), *((n, pa.int32()) for n in ("start_token", "end_token", "start_char", "end_char")), ("text", pa.string()), ("lemma", pa.string()), ("score", pa.float64()), ("is_kept", pa.bool_())]
    + [("overlaps_start", pa.int32()), ("overlaps_end", pa.int32())]
)


def chunk_tokens(tokens: DataFrame, min_length: int = 1, max_length: int = 4, determiners: bool = False) -> DataFrame:
    """tokens in noun chunks, with chunk_start (the chunk's first token_idx).

    A chunk is adjectives and then nouns, within a sentence and without stop words: islands of a window, that
    begin where nothing came before or a noun was followed by an adjective.  Of a longer one the last
    max_length tokens are the chunk; an island without a noun or of less than min_length isn't one.
    """
    kind = F.when(~F.col("is_stopword") & (F.col("pos") == "ADJ"), "A").when(~F.col("is_stopword") & F.col("pos").isin("NOUN", "PROPN"), "N")
    if determiners:
        kind = kind.when(~F.col("is_stopword") & (F.col("pos") == "DET"), "D")
    w = Window.partitionBy("doc_id", "sentence_idx").orderBy("token_idx")
    before = F.lag("kind").over(w)
    begins = F.col("kind").isNotNull() & (before.isNull() | ((before == "N") & (F.col("kind") != "N")) | ((F.col("kind") == "D")) | ((before == "A") & (F.col("kind") == "D")))
    marked = tokens.withColumn("kind", kind).withColumn("begins", F.coalesce(begins, F.lit(False)))
    islands = marked.withColumn("island", F.sum(F.col("begins").cast("int")).over(w)).where("kind IS NOT NULL")
    own = Window.partitionBy("doc_id", "sentence_idx", "island")
    sized = (
        islands.withColumn("last_noun", F.max(F.when(F.col("kind") == "N", F.col("token_idx"))).over(own))
        .where("token_idx <= last_noun")
        .withColumn("first", F.min("token_idx").over(own))
    )
    sized = sized.withColumn("chunk_start", F.greatest("first", F.col("last_noun") + 1 - max_length))
    return sized.where((F.col("last_noun") + 1 - F.col("first") >= min_length) & (F.col("token_idx") >= F.col("chunk_start"))).drop("kind", "begins", "island", "last_noun", "first")


def chunks(members: DataFrame) -> DataFrame:
    """doc_id, sentence_idx, start_token, end_token, start_char, end_char, text, lemma of chunk_tokens()."""
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_idx", c))), lambda x: x[c]), " ")
    return members.groupBy("doc_id", "sentence_idx", F.col("chunk_start").alias("start_token")).agg(
        (F.max("token_idx") + 1).alias("end_token"), F.min("start").alias("start_char"), F.max("end").alias("end_char"), in_order("text").alias("text"), in_order("lemma").alias("lemma")
    )


def phrase_candidates(members: DataFrame, max_phrases: int = 200) -> DataFrame:
    """doc_id, cand (from 0, in order), start_token, end_token, lemma, terms: of each document's first chunks."""
    w = Window.partitionBy("doc_id").orderBy("start_token")
    rows = members.groupBy("doc_id", F.col("chunk_start").alias("start_token")).agg(
        (F.max("token_idx") + 1).alias("end_token"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_idx", "lemma"))), lambda x: x["lemma"]), " ").alias("lemma"),
        F.array_sort(F.collect_set("text")).alias("terms"),
    )
    return rows.withColumn("cand", F.row_number().over(w) - 1).where(F.col("cand") < max_phrases)


def jaccard_pairs(cands: DataFrame) -> DataFrame:
    """doc_id, a, b (a < b), distance, below 1: pairs that share a term, found by an equi-join on it."""
    each = cands.select("doc_id", "cand", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    other = each.select("doc_id", F.col("cand").alias("b"), F.col("n").alias("nb"), "term")
    return (
        each.withColumnRenamed("cand", "a")
        .join(other, ["doc_id", "term"])
        .where("a < b")
        .groupBy("doc_id", "a", "b", "n", "nb")
        .agg(F.count("*").alias("common"))
        .select("doc_id", "a", "b", (1.0 - F.col("common") / (F.col("n") + F.col("nb") - F.col("common"))).alias("distance"))
    )


def candidate_gaps(cands: DataFrame) -> DataFrame:
    """doc_id, a, b (a < b), gap, weight = 1 / gap: all pairs of a document's candidates (at most max_phrases of them)."""
    l, r = cands.select("doc_id", F.col("cand").alias("a"), F.col("start_token").alias("sa"), F.col("end_token").alias("ea")), cands.select("doc_id", F.col("cand").alias("b"), F.col("start_token").alias("sb"))
    gap = F.greatest(F.lit(1), F.col("sb") - F.col("sa") - (F.col("ea") - F.col("sa") - 1))
    return l.join(r, "doc_id").where("a < b").select("doc_id", "a", "b", gap.cast("int").alias("gap"), (1.0 / gap).alias("weight"))


def topic_graph(gaps: DataFrame, clusters: DataFrame, edge_weight: float = 1.0) -> DataFrame:
    """doc_id, ca, cb (ca < cb), w: gap weights summed between clusters(doc_id, cand, cluster)."""
    l, r = clusters.select("doc_id", F.col("cand").alias("a"), F.col("cluster").alias("x")), clusters.select("doc_id", F.col("cand").alias("b"), F.col("cluster").alias("y"))
    return (
        gaps.join(l, ["doc_id", "a"])
        .join(r, ["doc_id", "b"])
        .where("x <> y")
        .groupBy("doc_id", F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb"))
        .agg((F.sum("weight") * edge_weight).alias("w"))
    )


def without_intra(gaps: DataFrame, clusters: DataFrame) -> DataFrame:
    """doc_id, src, dst, w, both directions: gap weights between candidates of different clusters(doc_id, cand, cluster)."""
    l, r = clusters.select("doc_id", F.col("cand").alias("a"), F.col("cluster").alias("x")), clusters.select("doc_id", F.col("cand").alias("b"), F.col("cluster").alias("y"))
    apart = gaps.join(l, ["doc_id", "a"]).join(r, ["doc_id", "b"]).where("x <> y")
    ends = lambda s, d: F.struct(F.col(s).alias("src"), F.col(d).alias("dst"))
    return apart.select("doc_id", F.explode(F.array(ends("a", "b"), ends("b", "a"))).alias("e"), "weight").select("doc_id", "e.src", "e.dst", F.col("weight").alias("w"))


def alpha_boosts(edges: DataFrame, cands: DataFrame, clusters: DataFrame, alpha: float = 1.1) -> DataFrame:
    """doc_id, src, dst, boost: what the first candidate of each cluster gains from a candidate of another cluster.

    That is the weight of the edges from the cluster's other members to that candidate, times alpha * exp(1 / (1 + the first one's place)).
    """
    placed = clusters.join(cands.select("doc_id", "cand", "start_token"), ["doc_id", "cand"])
    first = placed.groupBy("doc_id", "cluster").agg(F.min("start_token").alias("place"), F.min_by("cand", "start_token").alias("first"))
    others = placed.join(first, ["doc_id", "cluster"]).where("cand <> first").select("doc_id", "cluster", "first", "place", F.col("cand").alias("src"))
    return (
        edges.join(others, ["doc_id", "src"])
        .groupBy("doc_id", F.col("dst").alias("src"), F.col("first").alias("dst"), "place")
        .agg(F.sum("w").alias("sum_w"))
        .select("doc_id", "src", "dst", (F.lit(float(alpha)) * F.exp(1.0 / (1.0 + F.col("place"))) * F.col("sum_w")).alias("boost"))
    )


def topic_phrases(cands: DataFrame, clusters: DataFrame, scores: DataFrame) -> DataFrame:
    """doc_id, cluster, lemma, score, count, start_token: each topic by its first candidate, with scores(doc_id, cluster, score)."""
    rows = clusters.join(cands, ["doc_id", "cand"]).groupBy("doc_id", "cluster").agg(F.min_by("lemma", "start_token").alias("lemma"), F.min("start_token").alias("start_token"), F.count("*").alias("count"))
    return rows.join(scores, ["doc_id", "cluster"])


def best_by_lemma(cands: DataFrame, scores: DataFrame) -> DataFrame:
    """doc_id, lemma, cand, score, count: of the candidates of one lemma the one with the highest score, the last of several."""
    rows = cands.join(scores.select("doc_id", "cand", "score"), ["doc_id", "cand"])
    best = F.struct(F.round("score", 12).alias("r"), F.col("cand").alias("c"))
    return rows.groupBy("doc_id", "lemma").agg(F.max_by("cand", best).alias("cand"), F.max("score").alias("score"), F.count("*").alias("count"))


OVERLAPS = "doc_id long, start_token int, end_token int, start_char int, end_char int, text string, lemma string, score double, is_kept boolean, overlaps_start int, overlaps_end int"


def resolve_overlaps(scored: DataFrame, how: str = "greedy") -> DataFrame:
    """OVERLAPS of scored(doc_id, start_token, end_token, start_char, end_char, text, lemma, score): which chunks stay.

    greedy: the best first, whatever overlaps one that stays goes, with the place of that one; sweep: from left to right, a
    chunk that overlaps the last one replaces it if its score is higher.  A document's chunks are one group.
    """
    if how not in ("greedy", "sweep"):
        raise ValueError(f"unknown way: {how}")
    names = [f.split()[0] for f in OVERLAPS.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(names[:8]).to_pylist()
        rows.sort(key=lambda r: (r["start_char"], -r["score"], r["end_char"], r["start_token"]))
        chunks = [Scored((r["start_token"], i), r["start_char"], r["end_char"], r["text"], r["lemma"], r["score"]) for i, r in enumerate(rows)]
        of: dict[int, Scored] = {}
        if how == "greedy":
            kept, dropped = greedy(chunks)
            of = {c.chunk[1]: other for c, other in dropped}
        else:
            kept = sweep(chunks)
        stay = {c.chunk[1] for c in kept}
        for i, r in enumerate(rows):
            r |= {"is_kept": i in stay, "overlaps_start": of[i].start_char if i in of else None, "overlaps_end": of[i].end_char if i in of else None}
        return pa.Table.from_pylist(rows, schema=OVERLAP_TYPES)

    cols = [F.col(n.split()[0]).cast(n.split()[1]).alias(n.split()[0]) for n in OVERLAPS.split(", ")[:8]]
    return scored.select(*cols).groupBy("doc_id").applyInArrow(run, OVERLAPS)


def chunk_scores(members: DataFrame, scores: DataFrame, aggregate: str = "sum", use_pos: bool = True) -> DataFrame:
    """chunks() with ``score`` over its tokens' scores(doc_id, key, score); tokens without a node don't count."""
    keyed = members.withColumn("key", T.graph_key(F.col("lemma"), F.col("pos"), use_pos)).join(scores.select("doc_id", "key", "score").hint("shuffle_hash"), ["doc_id", "key"], "left")
    how = {"sum": F.sum("score"), "mean": F.avg("score"), "max": F.max("score"), "rms": F.sqrt(F.avg(F.col("score") * F.col("score")))}[aggregate]
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_idx", c))), lambda x: x[c]), " ")
    return keyed.groupBy("doc_id", F.col("chunk_start").alias("start_token")).agg(
        (F.max("token_idx") + 1).alias("end_token"), in_order("text").alias("text"), in_order("lemma").alias("lemma"), F.coalesce(how, F.lit(0.0)).alias("score")
    )


def phrases(scored: DataFrame, grouping: str = "scrubbed_text", aggregate: str = "sum") -> DataFrame:
    """doc_id, text, lemma, score, count, offsets: scored chunks as phrases, grouped by scrubbed text or by lemma.

    By scrubbed text the best variant, the last of several, gives text, lemma and score; by lemma the
    most frequent text, the least of several, stands for all and the scores are aggregated once more.
    """
    rows = scored.where("score > 0")
    offsets = F.array_sort(F.collect_list(F.struct(F.col("start_token").alias("start"), F.col("end_token").alias("end")))).alias("offsets")
    if grouping == "scrubbed_text":
        best = F.struct(F.round("score", 10).alias("r"), F.col("start_token").alias("s"))
        return (
            rows.groupBy("doc_id", T.scrub(F.col("text")).alias("g"))
            .agg(F.max_by("text", best).alias("text"), F.max_by("lemma", best).alias("lemma"), F.max("score").alias("score"), F.count("*").alias("count"), offsets)
            .drop("g")
        )
    how = {"sum": F.sum("score"), "mean": F.avg("score"), "max": F.max("score"), "rms": F.sqrt(F.avg(F.col("score") * F.col("score")))}[aggregate]
    texts = rows.groupBy("doc_id", "lemma", "text").agg(F.count("*").alias("n")).groupBy("doc_id", "lemma").agg(F.min_by("text", F.struct(-F.col("n"), F.col("text"))).alias("text"))
    return rows.groupBy("doc_id", "lemma").agg(how.alias("score"), F.count("*").alias("count"), offsets).join(texts, ["doc_id", "lemma"]).select("doc_id", "text", "lemma", "score", "count", "offsets")


def ranked(phrases_: DataFrame, top_n: int = 10) -> DataFrame:
    """phrases with rank (from 1) and the first top_n of each document; all for 0.  Scores count to ten decimals."""
    first = F.col("offsets")[0]
    w = Window.partitionBy("doc_id").orderBy(F.round("score", 10).desc(), first["start"], first["end"] - first["start"], "lemma")
    rows = phrases_.withColumn("rank", F.row_number().over(w))
    return rows.where(F.col("rank") <= top_n) if top_n else rows


def merge_adjacent(scored: DataFrame) -> DataFrame:
    """Scored chunks of a document that follow each other without a token between, as one: texts joined, scores summed."""
    w = Window.partitionBy("doc_id", "sentence_idx").orderBy("start_token")
    begins = F.coalesce((F.lag("end_token").over(w) != F.col("start_token")).cast("int"), F.lit(1))
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_token", c))), lambda x: x[c]), " ")
    return (
        scored.withColumn("begins", begins)
        .withColumn("run", F.sum("begins").over(w))
        .groupBy("doc_id", "sentence_idx", "run")
        .agg(F.min("start_token").alias("first_token"), F.max("end_token").alias("end_token"), in_order("text").alias("text"), in_order("lemma").alias("lemma"), F.sum("score").alias("score"))
        .drop("run")
        .withColumnRenamed("first_token", "start_token")
    )
