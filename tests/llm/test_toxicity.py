import random
from collections import Counter

import numpy as np
import pytest

from phrasemill.llm import toxicity

from .data import documents, empty, hard

CLEAN = [f"w{i}" for i in range(400)]
BAD = ["idiotic", "moronic", "wretched", "worthless"]


def corpus(n, share, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        toxic = rng.random() < share
        words = rng.choices(CLEAN, k=40) + (rng.sample(BAD, 2) if toxic else [])
        rng.shuffle(words)
        out.append((i, " ".join(words), int(toxic)))
    return out


def brute(model, text):
    words = {"".join(c for c in t.lower() if c.isalnum()) for t in text.split()} - {""}
    starts = Counter(w[:5] for w in words if len(w) > 5)
    own = words | {"^" + s for s in starts} | {"2^" + s for s, n in starts.items() if n > 1} | {"3^" + s for s, n in starts.items() if n > 2}
    return 1 / (1 + np.exp(-np.clip(model.bias + sum(model.weights.get(f.encode(), 0.0) for f in own), -30, 30)))


def test_held_out(spark):
    rows = corpus(900, 0.1, 1)
    docs = documents(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows if i % 2], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert 0.05 < model.prior < 0.2
    found = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    held = [(found[i].is_toxic, t) for i, _, t in rows if i % 2 == 0]
    assert np.mean([x for x, t in held if t]) > 0.9 and np.mean([x for x, t in held if not t]) < 0.02
    for i, text, _ in rows[:50]:
        assert abs(found[i].toxic_score - brute(model, text)) < 1e-9


def test_labels_of_clean_documents_have_no_part(spark):
    """The unlabelled are documents without a label, and the prior is estimated from them."""
    rows = corpus(1200, 0.15, 4)
    docs = documents(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows if i % 2], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert abs(model.prior - 0.15) < 0.04
    assert toxicity.train(docs, labels.where("toxic = 1").union(labels.where("toxic = 0").withColumn("toxic", labels["toxic"] * 0))) == model
    assert toxicity.train(docs, labels.where("toxic = 1").union(labels.where("toxic = 0").selectExpr("doc_id", "1 - quality AS quality", "toxic"))) == model


def sample(seed, share=0.3, n=300):
    rows = corpus(n, share, seed)
    sets = [toxicity.document_features(t) for _, t, _ in rows]
    truth = np.array([r[2] for r in rows])
    counts = Counter(f for s in [s for s, t in zip(sets, truth) if t][: n // 5] for f in s)
    at = {f: i for i, f in enumerate(sorted(f for f, k in counts.items() if k > 1))}
    docs = [np.array(sorted(at[f] for f in s if f in at), np.int64) for s in sets]
    return [d for d, t in zip(docs, truth) if t][: n // 5], docs, truth, sorted(at)


@pytest.mark.parametrize("bias", [-4.0, 4.0, -30.0])
def test_gradient_of_both_branches(bias):
    """Against differences of the risk; a bias that calls everything clean makes the second term negative for a large prior."""
    p, u, _, names = sample(3)
    p, u = toxicity.Rows.of(p), toxicity.Rows.of(u)
    rng = np.random.default_rng(1)
    w, prior = rng.normal(0, 0.1, len(names)), 0.3
    for feature in range(len(names)):  # the positives look toxic, the unlabelled clean
        if names[feature] in {x.encode() for x in BAD}:
            w[feature] = 8.0 if bias < 0 else 0.1
    g, gb, clipped = toxicity.gradient(p, u, w, bias, prior)
    first, second = toxicity.risk(p, u, w, bias, prior)
    assert clipped == (second < 0)
    objective = lambda w, b: -toxicity.risk(p, u, w, b, prior)[1] if clipped else sum(toxicity.risk(p, u, w, b, prior))
    for i in rng.choice(len(names), 25, replace=False):
        step = np.zeros(len(names))
        step[i] = 1e-5
        assert abs((objective(w + step, bias) - objective(w - step, bias)) / 2e-5 - g[i]) < 1e-6
    assert abs((objective(w, bias + 1e-5) - objective(w, bias - 1e-5)) / 2e-5 - gb) < 1e-6


def test_both_branches_run():
    p, u, _, names = sample(5)
    rows = toxicity.Rows.of(p), toxicity.Rows.of(u)
    assert toxicity.gradient(*rows, np.zeros(len(names)), -1.0, 0.3)[2] is False
    assert toxicity.gradient(*rows, np.array([20.0 if n in {x.encode() for x in BAD} else 0.0 for n in names]), -8.0, 0.5)[2] is True
    assert toxicity.fit(*rows, len(names), 0.6)[2] > 0  # too high a prior


def test_risk_is_corrected_by_the_prior():
    """Without the correction all unlabelled would count as clean."""
    for prior, n in ((0.3, 400), (None, 2000)):
        p, u, truth, names = sample(2, n=n)
        model = toxicity.learn(p, u, names, prior)
        w = np.array([model.weights.get(f, 0.0) for f in names])
        score = toxicity.Rows.of(u).score(w, model.bias)
        assert ((score > 0) == truth).mean() > 0.95


def test_hard_rows(spark):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, None, None), (None, 1, 1), (77, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    docs = hard(spark)
    out = toxicity.scored(docs, toxicity.train(docs, labels))
    assert out.count() == docs.count() and out.where("toxic_score IS NULL OR toxic_score NOT BETWEEN 0 AND 1").count() == 0
    blank = {round(r.toxic_score, 12) for r in out.where("doc_id IN (4, 5, 6)").collect()}
    assert len(blank) == 1  # the bias alone
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.scored(docs, none).where("is_toxic").count() == 0
    assert toxicity.scored(empty(spark), none).count() == 0
    assert toxicity.train(empty(spark), labels).weights == {}
