"""Relations made of arrays of a few documents: whole, without shuffles of words, and bounded."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phrasemill.operators import batches as B
from phrasemill.operators import document as D
from phrasemill.operators import spread as S
from phrasemill.plans.queries import QUERIES, SQL
from phrasemill.sources import topic_weights as L

SMALL = "/root/testdata/sf0.001"
NARROW = (
    "intra_topic_removal",
    "merge_adjacent",
    "multipartite_boost",
    "overlaps_greedy",
    "overlaps_sweep",
    "phrases_lemma",
    "phrases_scrubbed",
    "textrank_top_n",
    "topic_graph_given_clusters",
    "chunk_scores_sum",
    "chunk_scores_mean",
    "chunk_scores_max",
    "sentence_relevance",
    "chunk_scores_rms",
    "dangling_nodes",
    "graph_limits",
    "node_degree",
    "cooccur_cross",
    "teleport_focus",
    "teleport_sparse",
    "noun_chunks",
    "chunk_len_cap",
    "topic_representatives",
    "sentence_jaccard",
    "sentences",
)


@pytest.mark.parametrize("name", NARROW)
def test_words_are_not_shuffled(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("RoundRobinPartitioning") <= 1 and "Join" not in plan  # texts, dealt out


def test_words_are_counted_before_they_are_shuffled(spark):
    plan = QUERIES["pos_tags"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "sum(n" in plan


def words(*docs: str) -> B.Words:
    import re

    items = [re.findall(r"\x01|\w+|[^\w\x01]+", x) for x in docs]
    return B.Cutter()(pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(["en"] * len(docs)), pa.array(["en"] * len(docs)), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "lang", "list", "items"]))


def test_boosts_of_all_candidates():
    """A plain loop over all pairs, of more candidates than 200, block by block."""
    rng = random.Random(1)
    w = words(" the ".join(rng.choice("cat dog fox owl bee".split()) if k % 3 else f"word{k}" for k in range(450)))
    c = B.candidates(w, None)
    assert len(c.doc) == 450 and "cand < 200" not in SQL["multipartite_boost"]
    start, cluster = c.start.tolist(), c.clusters().tolist()
    want = {}
    for k in set(cluster):
        own = [i for i in range(450) if cluster[i] == k]
        if len(own) > 1:
            gain = sum(1.0 / max(1, abs(start[i] - start[j])) for i in own[1:] for j in range(450) if cluster[j] != k)
            want[own[0]] = (450 - len(own), 1.1 * np.exp(1.0 / (1.0 + start[own[0]])) * gain)
    for most in (B.MOST_PAIRS, 1000):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(B, "MOST_PAIRS", most)
            (found,) = B.alpha_boosts(1.1, None)(w)
        got = {i: (n, x) for i, n, x in zip(found["dst"].tolist(), found["n"].tolist(), found["boost"].tolist())}
        assert got.keys() == want.keys() and all(got[i] == (want[i][0], pytest.approx(want[i][1])) for i in want)


def test_pairs_that_share_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    rows = np.unique(rng.integers(0, 40, (300, 2)), axis=0)
    of, what, doc = rows[:, 0], rows[:, 1], np.arange(40) // 15
    sets = [set(what[of == i].tolist()) for i in range(40)]
    want = {(i, j): len(sets[i] & sets[j]) for i in range(40) for j in range(i + 1, 40) if doc[i] == doc[j] and sets[i] & sets[j]}
    for most in (1 << 20, 50, 1):
        monkeypatch.setattr(B, "MOST_PAIRS", most)
        parts = list(B.sharing(of, doc, what))
        assert {(a, b): n for p in parts for a, b, n in zip(*(x.tolist() for x in p))} == want and sum(len(p[0]) for p in parts) == len(want)
        assert most > 50 or len(parts) > 5


def test_a_few_documents_at_once(monkeypatch):
    monkeypatch.setattr(B, "MOST_ITEMS", 10)
    batch = pa.RecordBatch.from_arrays([pa.array([["a"] * n for n in (3, 7, 1, 25, 0, 4, 9)])], names=["items"])
    assert [p.column("items").to_pylist() for p in B.few([batch])] == [[["a"] * n for n in part] for part in ((3, 7), (1,), (25,), (0, 4), (9,))]
    assert max(p.num_rows for p in B.few([batch], 1)) == 1 and sum(p.num_rows for p in B.few([batch], 1)) == 7


def test_greedy_overlaps_by_search():
    rng = random.Random(2)
    for _ in range(200):
        chunks = [D.Scored((0, i), a := rng.randrange(30), a + rng.randrange(5), "", "", rng.randrange(6)) for i in range(25)]
        kept, dropped = [], []
        for c in sorted(chunks, key=lambda c: -c.score):
            other = next((k for k in kept if c.start_char < k.end_char and k.start_char < c.end_char), None)
            dropped.append((c, other)) if other else kept.append(c)
        assert D.resolve_overlaps_greedy(chunks) == (sorted(kept, key=lambda c: c.start_char), dropped)


def test_long_tasks_are_cut(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    monkeypatch.setattr(S, "MOST_SPREAD", 1)
    assert S.spread(docs).rdd.getNumPartitions() == 1
    monkeypatch.setattr(S, "A_TASK", 10_000)
    assert S.spread(docs).rdd.getNumPartitions() > 5


def test_lda_weights_without_a_shuffle_of_documents(spark):
    bags = spark.createDataFrame([(i, ["a", "b", "c"] * 2 if i % 2 else ["d", "e", "a"]) for i in range(20)], "doc_id long, words array<string>")
    model, vectors, vocabulary = L.fit_lda_bags(bags, k=3, vocabulary=5, iterations=2)
    assert vectors.is_cached
    for how in ("max", "mean"):
        found = L.topic_weights_from_lda(model, vectors, vocabulary, 2, how)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join Cross") < plan.index("Aggregate")  # no aggregate of documents' rows
        p = {r.doc_id: list(r.topicDistribution) for r in model.transform(vectors).collect()}
        topics = spark.createDataFrame([(d, t, x) for d, xs in p.items() for t, x in enumerate(map(float, xs))], "doc_id long, topic int, p double")
        terms = spark.createDataFrame([(r.topic, vocabulary[i], float(x)) for r in model.describeTopics(2).collect() for i, x in zip(r.termIndices, r.termWeights)], "topic int, word string, p double")
        want = {(r.doc_id, r.lemma): r.weight for r in L.weights_from_topics(topics, terms, how).collect()}
        got = {(r.doc_id, r.lemma): r.weight for r in found.collect()}
        assert got == pytest.approx(want)


def test_a_sentence_of_a_no_break_space_counts():
    text = "One.\n\u00a0\nTwo."
    assert [t.sentence_idx for t in D.tokenizer()(text, "en")] == [0, 2]
