"""Stages of the caller's own, observers, errors, and what documents bring with them."""

import json
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

import phrasemill
from phrasemill import errors
from phrasemill.operators import document as D
from phrasemill.operators import graphs as G
from phrasemill.operators import phrases as P
from phrasemill.plans import api, spec
from phrasemill.plans.builder import PipelineBuilder
from phrasemill.plans.config import TextRankConfig, plan_for
from phrasemill.sources import json_docs, spacy_tokens
from phrasemill.sources.topic_weights import with_topic_weights

from .fixtures import TR3

TEXT = "Machine learning uses algorithms. Deep learning uses neural networks. Machine learning models improve with data."


def lemmas(results):
    return [p.lemma for p in results[0].phrases]


def test_each_stage_can_be_replaced():
    run = lambda **stages: PipelineBuilder().stage(**stages).build().run_documents([TR3])
    plain = PipelineBuilder().build().run_documents([TR3])
    assert run() == plain
    assert "datum" not in " ".join(lemmas(run(preprocess=lambda tokens: tokens[:4])))
    only = run(candidates=lambda tokens, plan: [i for i, t in enumerate(tokens) if t.lemma in ("machine", "learning")])
    assert set(" ".join(lemmas(only)).split()) <= {"machine", "learning", "deep", "model"} and only != plain
    star = run(graph=lambda tokens, chosen, plan: D.Graph.of(["model|NOUN", "deep|ADJ", "network|NOUN"], {(0, 1): 1.0, (0, 2): 1.0}))
    assert lemmas(star)[0] == "machine learning model"
    doubled = run(transforms=(lambda g, tokens, plan: g._replace(w=g.w * 2), lambda g, tokens, plan: g._replace(w=g.w / 2)))
    assert doubled == plain
    pulled = run(teleport=lambda g, tokens, plan: np.array([float(k.startswith("network")) for k in g.keys]))
    assert "network" in lemmas(pulled)[0]
    ranked = run(rank=lambda g, p, cfg: (np.arange(len(g.keys), dtype=float), 7, 0.0, True))
    assert ranked[0].iterations == 7 and ranked[0].converged
    own = run(phrases=lambda tokens, g, scores, plan: [D.Phrase(k, k, float(s), 1, [(0, 1)]) for k, s in zip(g.keys, scores)])
    assert all("|" in p.text for p in own[0].phrases)
    assert run(format=lambda r: {"n": len(r.phrases)}) == [{"n": len(plain[0].phrases)}]


def test_clusters_and_transforms_in_order():
    build = lambda: PipelineBuilder("multipartite_rank")
    plain = build().build().run_documents([TR3])
    assert build().transforms(0.0, 1.1).build().run_documents([TR3]) == plain
    assert build().transforms(1.1, 1.1).build().run_documents([TR3]) != plain
    seen = []

    def note(w, cands, clusters):
        seen.append((len(cands), sorted(i for c in clusters for i in c)))
        return w

    assert build().transforms(note, 1.1, note).build().run_documents([TR3]) == plain
    assert len(seen) == 2 and seen[0][1] == list(range(seen[0][0]))
    one = PipelineBuilder("topic_rank").stage(cluster=lambda cands, plan: [[i for i in range(len(cands))]]).build().run_documents([TR3])
    assert len(one[0].phrases) == 1
    assert D.cluster_sets([{1, 2}, {1, 2}, {7}], 0.25) == [[0, 1], [2]]


def test_a_failing_stage_is_the_documents_error(spark):
    def fails(tokens):
        if len(tokens) < 3:
            raise RuntimeError("too short")
        return tokens

    built = PipelineBuilder().stage(preprocess=fails).build()
    docs = spark.createDataFrame([(1, TEXT), (2, "one word")], "doc_id long, text string")
    rows = {r.doc_id: r for r in D.extract_results(docs, built.plan).collect()}
    assert rows[1].error is None and rows[1].phrases
    assert rows[2].error.code == "stage_failed" and rows[2].error.stage == "preprocess" and "too short" in rows[2].error.message
    bad = PipelineBuilder().stage(rank=lambda g, p, cfg: 1 / 0).build().run_documents([TR3])
    assert bad[0].error[:2] == ("stage_failed", "rank")
    made = PipelineBuilder().stage(format=lambda r: [p.text for p in r.phrases]).build().formatted(docs)
    assert {r.doc_id: json.loads(r.value) for r in made.collect()}[1]


def test_observers():
    class Notes(api.PipelineObserver):
        def __init__(self):
            self.seen = []

        def on_stage_start(self, stage):
            self.seen.append(stage)

        def on_tokens(self, tokens):
            self.n_tokens = len(tokens)

        def on_candidates(self, candidates):
            self.candidates = candidates

        def on_graph(self, graph):
            self.graph = graph

        def on_rank(self, rank):
            self.rank = rank

        def on_phrases(self, phrases):
            self.phrases = phrases

    notes, timing = Notes(), api.StageTimingObserver()
    result = api.TopicRank(observers=[notes, timing]).extract_tokens(TR3)
    assert notes.seen == ["preprocess", "candidates", "graph", "teleport", "rank", "phrases"] == [s for s, _ in timing.reports]
    assert notes.n_tokens == len(TR3) and notes.candidates and len(notes.phrases) == len(result)
    reports = dict(timing.reports)
    assert reports["graph"].nodes == len(notes.graph.keys) and reports["rank"].iterations == result.iterations and reports["rank"].converged
    assert timing.total_duration_ms == pytest.approx(sum(r.duration_us for r in reports.values()) / 1000)


def test_residuals():
    for name in ("textrank", "topic_rank"):
        plan = plan_for(name, TextRankConfig(debug_level="full"))
        (r,) = D.run_documents([TR3], plan)
        found = r.debug["residuals"]
        assert len(found) == r.iterations and found[-1] == r.debug["convergence_summary"]["final_delta"]
        assert found[-1] <= 1e-6 < found[-2]
    assert spec.plan_of({"preset": "textrank", "expose": {"pagerank": {"residuals": True}}}).config.debug_level == "full"
    assert spec.plan_of({"preset": "textrank", "expose": {"pagerank": {"residuals": False}}}).config.debug_level == "stats"
    assert api.BaseTextRank(TextRankConfig(debug_level="full")).extract_tokens(TR3).debug.residuals


def test_dense_and_sparse_ranks_agree():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40):
        w = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.6), 1)
        w += w.T
        src, dst = np.nonzero(w)
        g = D.Graph([str(i) for i in range(n)], src, dst, w[src, dst])
        p = rng.random(n)
        for teleport in (None, p / p.sum()):
            for weighted in (True, False):
                traces = [[]]
                a = D._dense_rank(g, teleport, TextRankConfig(), weighted, traces[0])
                (b,) = D._sparse_ranks([g], [teleport], TextRankConfig(), weighted, None)
                assert np.allclose(a[0], b[0], atol=1e-12) and a[1] == b[1] == len(traces[0]) and a[3] == b[3]


def test_error_kinds():
    with pytest.raises(errors.InvalidConfig):
        TextRankConfig().with_damping(1.5)
    assert TextRankConfig().with_top_n(3).with_window_size(4) == TextRankConfig(top_n=3, window_size=4)
    with pytest.raises(AttributeError):
        TextRankConfig().with_nothing
    with pytest.raises(errors.EmptyInput):
        api.BaseTextRank().extract_tokens([], strict=True)
    with pytest.raises(errors.NoCandidates):
        api.BaseTextRank().extract_tokens([D.Token("the", "the", "DET", 0, 3, 0, True)], strict=True)
    with pytest.raises(errors.ConvergenceFailure):
        api.BaseTextRank(TextRankConfig(max_iterations=1)).extract_tokens(TR3, strict=True)
    with pytest.raises(errors.PipelineRuntimeError) as e:
        api.BaseTextRank(TextRankConfig(max_tokens=2)).extract_tokens(TR3)
    assert (e.value.code, e.value.stage, e.value.path) == ("limit_exceeded", "preprocess", "/runtime/preprocess")
    assert isinstance(e.value, ValueError)


def test_json_that_is_wrong_stops_no_other_line():
    good = json.dumps({"tokens": [{"text": "cat", "lemma": "cat", "pos": "NOUN", "start": 0, "end": 3, "sentence_idx": 0, "token_idx": 0}]})
    bad = json.dumps({"tokens": [], "config": {"damping": 1.5, "window_size": 1}})
    out = [json.loads(x) for x in json_docs.extract_jsonl_from_json("\n".join(["[" * 200_000, good, bad])).split("\n")]
    assert "error" in out[0] and out[1]["phrases"] and "damping" in out[2]["error"]


def test_documents_bring_their_own_terms(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, TEXT), (3, TEXT)], "doc_id long, text string")
    weights = spark.createDataFrame([(1, "network", 5.0), (1, "network", 1.0), (2, "machine", 5.0), (9, "x", 1.0)], "doc_id long, lemma string, weight double")
    rows = D.extract(with_topic_weights(docs, weights), plan_for("topical_pagerank", topic_weights=(("algorithm", 9.0),))).collect()
    of = lambda i: [(r.text, r.score) for r in sorted(rows, key=lambda r: r["rank"]) if r.doc_id == i]
    for i, own in ((1, {"network": 5.0}), (2, {"machine": 5.0}), (3, {"algorithm": 9.0})):
        assert of(i) == api.TopicalPageRank(own).extract_keywords(TEXT).as_tuples()
    focus = docs.withColumn("focus_terms", F.when(F.col("doc_id") == 1, F.array(F.lit("Data"))))
    rows = D.extract(focus, plan_for("biased_textrank", focus_terms=("machine",))).collect()
    assert of(1) == api.BiasedTextRank(["data"]).extract_keywords(TEXT).as_tuples()
    assert of(2) == api.BiasedTextRank(["machine"]).extract_keywords(TEXT).as_tuples()


def test_overlaps_as_a_table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for doc in range(6):
        for _ in range(30):
            a, n = int(rng.integers(0, 60)), int(rng.integers(1, 8))
            rows.append((doc, a, a + n, a, a + n, f"t{a}", f"l{n}", float(rng.random())))
    table = spark.createDataFrame(rows, "doc_id long, start_token int, end_token int, start_char int, end_char int, text string, lemma string, score double")
    for how in ("greedy", "sweep"):
        found = P.resolve_overlaps(table, how).collect()
        assert len(found) == len(rows)
        for doc in range(6):
            own = sorted((r for r in rows if r[0] == doc), key=lambda r: -r[7])
            kept = {(r.start_char, r.end_char, r.score) for r in found if r.doc_id == doc and r.is_kept}
            assert all(a[1] <= b[0] for a, b in zip(sorted(kept), sorted(kept)[1:]))
            if how == "greedy":  # the best that doesn't overlap what is taken, again and again
                expected = []
                for r in own:
                    if all(r[4] <= e[0] or r[3] >= e[1] for e in expected):
                        expected.append((r[3], r[4], r[7]))
                assert kept == set(expected)
                assert all(r.is_kept != (r.overlaps_start is not None) for r in found if r.doc_id == doc)
    with pytest.raises(ValueError):
        P.resolve_overlaps(table, "other")


def test_directed_graphs(spark):
    rows = [("a", "b", 1.0), ("b", "a", 2.0), ("a", "b", 0.5), ("c", "c", 1.0)]
    g = D.Graph.directed(rows)
    assert g.keys == ["a", "b", "c"] and g.neighbours("a") == [("b", 1.5)] and g.total_weight("b") == 2.0 and g.degree("c") == 1 and g.node("x") is None
    table = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, src string, dst string, w double")
    assert {(r.src, r.dst): r.w for r in G.directed_edges(table).collect()} == {("a", "b"): 1.5, ("b", "a"): 2.0, ("c", "c"): 1.0}


def test_spacy_documents():
    token = lambda text, at, pos, stop=False: SimpleNamespace(text=text, lemma_=text.lower(), pos_=pos, idx=at, is_stop=stop, is_space=text.isspace())
    doc = SimpleNamespace(sents=[[token("Deep", 0, "ADJ"), token("networks", 5, "NOUN"), token("\n", 13, "SPACE")], [token("The", 14, "DET", True), token("networks", 18, "NOUN")]], user_data={})
    tokens = spacy_tokens.tokens_of(doc)
    assert [(t.text, t.pos, t.start, t.end, t.sentence_idx, t.is_stopword) for t in tokens][-2:] == [("The", "DET", 14, 17, 1, True), ("networks", "NOUN", 18, 26, 1, False)]
    assert len(tokens) == 4
    assert spacy_tokens.KeyphraseComponent("position")(doc) is doc and doc.user_data["phrases"]


def test_exported_names():
    for name in phrasemill.__all__:
        assert getattr(phrasemill, name) is not None
    assert phrasemill.extract_keywords(TEXT, top_n=2)
    for f in (api.extract_keyphrases, api.extract_keyphrases_position, api.extract_keyphrases_singlerank, api.extract_keyphrases_topic, api.extract_keyphrases_multipartite):
        assert f(TR3)
    assert api.extract_keyphrases_biased(TR3, ["machine"]) == api.BiasedTextRank(["machine"]).extract_tokens(TR3).phrases
    assert api.extract_keyphrases_topical(TR3, {"machine": 1.0}) == api.TopicalPageRank({"machine": 1.0}).extract_tokens(TR3).phrases
    assert api.TopicRank().with_similarity_threshold(2.0).with_edge_weight(-1).with_max_phrases(5).settings == {"cluster_threshold": 1.0, "edge_weight": 0.0, "max_phrases": 5, "linkage": "average"}
    assert api.MultipartiteRank().with_alpha(-1).settings["alpha"] == 0.0


def test_a_threshold_of_zero_is_one(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    n = lambda threshold: len({r.cluster for r in D.clusters(docs, plan_for("topic_rank", cluster_threshold=threshold)).collect()})
    assert n(0.0) <= n(0.25) and n(0.0) < n(0.9)
