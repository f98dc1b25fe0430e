"""Results that are known to many digits."""

import numpy as np
import pytest

from phrasemill.operators import document as D
from phrasemill.plans.config import TextRankConfig, plan_for
from tests.fixtures import RICH, TR1, TR3, tokens


def run(toks, variant="textrank", **settings):
    cfg = settings.pop("config", TextRankConfig())
    return D.run_documents([toks], plan_for(variant, cfg, **settings))[0]


def test_one_sentence():
    r = run(TR1)
    assert (r.iterations, r.converged) == (9, True)
    assert [(p.text, pytest.approx(p.score, abs=1e-8)) for p in r.phrases] == [("Machine learning", 0.2846505870), ("artificial intelligence", 0.2846505870), ("subset", 0.2153494130)]


def test_three_sentences():
    r = run(TR3)
    assert r.iterations == 21
    expected = [
        ("Machine learning models", 0.4249608102), ("Machine learning", 0.3179496860), ("Deep learning", 0.2746293119),
        ("neural networks", 0.1412982971), ("data", 0.0616928699), ("algorithms", 0.0567178525),
    ]
    assert [p.text for p in r.phrases] == [t for t, _ in expected]
    assert [p.score for p in r.phrases] == pytest.approx([s for _, s in expected], abs=1e-8)


def test_one_iteration():
    r = run(TR3, config=TextRankConfig(max_iterations=1))
    assert not r.converged and r.iterations == 1 and r.phrases


@pytest.mark.parametrize("variant", ["textrank", "position_rank", "biased_textrank", "single_rank", "topical_pagerank", "topic_rank", "multipartite_rank", "sentence_rank"])
def test_empty(variant):
    r = run([], variant)
    assert (r.phrases, r.iterations, r.converged) == ([], 0, True)


def test_topic_rank():
    r = run(RICH, "topic_rank")
    expected = {
        "neural network": 0.2579807, "machine learning algorithm": 0.2114519, "deep learning model": 0.1531721, "data analysis": 0.1479700, "large dataset": 0.1399592,
        "deep learning application": 0.0894658,
    }
    assert r.iterations == 17
    assert [p.lemma for p in r.phrases] == list(expected)
    assert [p.score for p in r.phrases] == pytest.approx(list(expected.values()), abs=1e-5)


def test_multipartite_rank():
    r = run(RICH, "multipartite_rank")
    expected = {
        "machine learning algorithm": 0.2536742, "neural network": 0.2351832, "large dataset": 0.1184485, "deep learning model": 0.1157130, "machine learning technique": 0.0855296,
        "data analysis": 0.0795817, "deep learning application": 0.0500771,
    }
    assert r.iterations == 20
    assert [p.lemma for p in r.phrases] == list(expected)
    assert [p.score for p in r.phrases] == pytest.approx(list(expected.values()), abs=1e-5)


def test_blocks_rank_as_single_documents():
    docs = [TR1, TR3, RICH, [], TR3]
    plan = plan_for("single_rank")
    assert D.run_documents(docs, plan) == [D.run_documents([d], plan)[0] for d in docs]


def test_canonical_text_of_a_tie():
    toks = tokens("Networks/network/NOUN ‖ networks/network/NOUN")
    r = run(toks, config=TextRankConfig(phrase_grouping="lemma"))
    assert r.phrases[0].text == "Networks" and r.phrases[0].count == 2


@pytest.mark.parametrize("a,b,gap", [((0, 1), (1, 2), 1), ((0, 2), (2, 4), 1), ((3, 5), (3, 5), 1), ((0, 3), (10, 12), 8), ((10, 12), (0, 3), 8), ((0, 5), (3, 7), 1)])
def test_gaps(a, b, gap):
    cands = [D.Candidate(D.Chunk(*x), "", "", frozenset()) for x in (a, b)]
    assert D.gaps(cands)[0, 1] == gap


@pytest.mark.parametrize("sets,n", [(["ab", "cd", "ef"], 3), (["ab", "ab"], 1), (["ab", "abc", "xyz"], 2)])
def test_clusters(sets, n):
    assert len(D.hac(D.jaccard_distances([frozenset(s) for s in sets]), 0.25)) == n


def test_clusters_against_plain_loops():
    rng = np.random.default_rng(3)
    for linkage in ("average", "single", "complete"):
        for _ in range(20):
            sets = [frozenset(rng.choice(list("abcdefgh"), rng.integers(1, 4), replace=False)) for _ in range(9)]
            dist = D.jaccard_distances(sets)
            own = [[i] for i in range(9)]
            how = {"average": np.mean, "single": np.min, "complete": np.max}[linkage]
            while len(own) > 1:
                d, i, j = min((round(float(how(dist[np.ix_(own[i], own[j])])), 12), i, j) for i in range(len(own)) for j in range(i + 1, len(own)))
                if d > 0.74 + 1e-12:
                    break
                own[i] += own.pop(j)
            found = D.hac(dist, 0.25, linkage)
            assert [sorted(c) for c in found] == [sorted(c) for c in own]


def test_triangle_and_star():
    one = D.Graph.of(list("abc"), {(0, 1): 1.0, (1, 2): 1.0, (0, 2): 1.0})
    star = D.Graph.of(list("habc"), {(0, 1): 1.0, (0, 2): 1.0, (0, 3): 1.0})
    (a, *_), (b, *_) = D.pagerank([one, star], [None, None], TextRankConfig())
    assert a == pytest.approx([1 / 3] * 3)
    assert b.argmax() == 0 and b.sum() == pytest.approx(1)


def test_position_and_focus_move_the_scores():
    early = tokens("Early/early/NOUN topic/topic/NOUN is/be/VERB important/important/ADJ ‖ Late/late/NOUN topic/topic/NOUN is/be/VERB important/important/ADJ")
    plan = plan_for("position_rank")
    p = D.prepare(early, plan)
    s = dict(zip(p.graph.keys, D.pagerank([p.graph], [p.teleport], plan.config)[0][0]))
    assert s["early|NOUN"] > s["late|NOUN"]
    nine = TR3[:9]
    score = {}
    for term in ("machine", "neural"):
        plan = plan_for("biased_textrank", focus_terms=(term,), bias_weight=10.0)
        p = D.prepare(nine, plan)
        score[term] = dict(zip(p.graph.keys, D.pagerank([p.graph], [p.teleport], plan.config)[0][0]))
    assert score["machine"]["machine|NOUN"] > score["neural"]["machine|NOUN"]


def test_sentence_similarity():
    spans = [D.SentenceSpan(i, i, i + 1, frozenset(s)) for i, s in enumerate(["123", "234", "56"])]
    g = D.sentence_graph(spans, 0.0)
    assert len(g.src) == 2 and g.w[0] == 0.5
    assert len(D.sentence_graph(spans, 0.6).src) == 0


def test_overlaps():
    a, b = D.Scored(D.Chunk(0, 2), 0, 15, "a", "a", 1.0), D.Scored(D.Chunk(1, 3), 5, 20, "b", "b", 2.0)
    kept, dropped = D.resolve_overlaps_greedy([a, b])
    assert kept == [b] and dropped == [(a, b)] and D.resolve_overlaps([a, b]) == [b]


def test_fox():
    fox = tokens("The/the/DET quick/quick/ADJ brown/brown/ADJ fox/fox/NOUN jumps/jump/VERB over/over/ADP the/the/DET lazy/lazy/ADJ dog/dog/NOUN")
    assert D.noun_chunks(fox, 1, 5) == [(1, 4), (7, 9)]
    assert D.noun_chunks(fox, 1, 2) == [(2, 4), (7, 9)]
    assert D.noun_chunks(fox, 1, 5, determiners=True) == [(0, 4), (6, 9)]


def test_summary_leaves_short_sentences():
    phrases = [D.Phrase("machine learning", "machine learning", 0.5, 1, []), D.Phrase("neural networks", "neural network", 0.3, 1, [])]
    toks = tokens("Machine/machine/NOUN learning/learning/NOUN is/be/VERB very/very/ADV good/good/ADJ ‖ AI/ai/NOUN is/be/VERB fun/fun/NOUN ‖ Neural/neural/ADJ networks/network/NOUN are/be/VERB really/really/ADV nice/nice/ADJ")
    chosen, relevance, diversity = D.summary(toks, phrases, 2)
    assert [s.sentence_idx for s in chosen] == [0, 2] and relevance > 0 and diversity == 1.0
