import math

import numpy as np

from phrasemill.llm import rule_ensemble as R
from phrasemill.llm.quality_rules import STATISTICS, with_statistics

from .data import OTHER, PROSE, documents, empty, hard
from .test_quality_rules import brute as statistics


def labelled(spark, n=240):
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        docs.append((i, (PROSE if i % 2 else OTHER) * (1 + i % 4) if good else f"$$$ {i} ### buy|now|{i} !!! " * (2 + i % 5)))
        labels.append((i, int(good), 0))
    return documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(spark):
    docs, labels = labelled(spark)
    model = R.train(docs, labels.where("doc_id % 2 = 0"))
    assert 0 < len(model.rules) < 60
    held = R.scored(docs, model).join(labels, "doc_id").where("doc_id % 2 = 1")
    assert held.count() == 120 and held.where("is_kept <> (quality = 1)").count() == 0


def test_compiled_rules_are_the_ensemble(spark):
    docs, labels = labelled(spark)
    model = R.train(docs, labels)
    x = with_statistics(hard(spark), []).toPandas()[STATISTICS].to_numpy(float)
    expected = sorted(np.round(1 / (1 + np.exp(-R.evaluate(model, x, STATISTICS))), 9))
    found = R.scored(hard(spark), model)
    assert sorted(np.round([r.quality_score for r in found.collect()], 9)) == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_scores_against_plain_rules(spark):
    """Each rule by hand, from statistics counted in plain Python."""
    docs, labels = labelled(spark, 90)
    model = R.train(docs, labels)
    assert model.rules
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in R.scored(docs, model).collect():
        own = statistics(texts[r.doc_id])
        odds = model.intercept
        for path, weight in model.rules:
            if all(own[name] > bound if above else own[name] <= bound for name, above, bound in path):
                odds += weight
        assert abs(r.quality_score - 1 / (1 + math.exp(-odds))) < 1e-9 and r.is_kept == (odds >= 0)


def test_odds_of_zero_keep(spark):
    docs = documents(spark, [(1, PROSE), (2, None)])
    assert [(r.quality_score, r.is_kept) for r in R.scored(docs, R.Ensemble(0.0, ())).collect()] == [(0.5, True)] * 2
    on = R.Ensemble(-1.0, ((((("n_words"), False, 0.0),), 1.0),))  # a bound that the empty text is on
    assert {r.doc_id: r.is_kept for r in R.scored(docs, on).collect()} == {1: False, 2: True}


def test_splits_against_all_cuts():
    """The cut that lessens the squares the most, of equals the first: tried one by one."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        x, r = rng.integers(0, 6, (25, 3)).astype(float), rng.normal(size=25)
        squares = lambda v: ((v - v.mean()) ** 2).sum()
        best = None
        for j in range(3):
            values = np.unique(x[:, j])
            for low, high in zip(values, values[1:]):
                left = x[:, j] <= (low + high) / 2
                if min(left.sum(), (~left).sum()) >= 4:
                    gain = squares(r) - squares(r[left]) - squares(r[~left])
                    if best is None or gain > best[0] + 1e-12:
                        best = (gain, (j, (low + high) / 2))
        assert R._split(x, r, 4) == best[1]


def test_lasso_is_at_its_optimum():
    """No weight's slope exceeds the penalty, and those that aren't 0 have just that slope."""
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2, (300, 8)).astype(float)
    y = (a[:, 0] + a[:, 1] * a[:, 2] + rng.normal(0, 0.3, 300) > 1).astype(float)
    b, w = R._lasso(a, y, 1e-2, steps=4000)
    slope = a.T @ (1 / (1 + np.exp(-(a @ w + b))) - y) / len(y)
    assert np.abs(slope).max() <= 1e-2 + 1e-5 and (w != 0).any() and (w == 0).any()
    assert np.abs(slope[w != 0] + 1e-2 * np.sign(w[w != 0])).max() < 1e-5


def test_paths_split_where_the_residual_does():
    x = np.array([[1.0], [2.0], [3.0], [4.0]] * 10)
    paths, value = R.tree_paths(x, (x[:, 0] > 2).astype(float), ["s"], 1)
    assert set(paths) == {(("s", False, 2.5),), (("s", True, 2.5),)}
    assert (value == (x[:, 0] > 2)).all()


def test_lasso_leaves_useless_rules_out():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2, (500, 12)).astype(float)
    _, w = R._lasso(a, a[:, 0], 2e-2)
    assert w[0] > 1 and (np.abs(w[1:]) < 0.1).all()


def test_hard_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0), (3, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    docs = hard(spark)
    out = R.scored(docs, R.train(docs, labels))
    assert out.count() == docs.count() and out.where("quality_score IS NULL OR is_kept IS NULL").count() == 0
    only = R.train(docs, labels.where("doc_id = 3"))
    assert only.rules == () and R.scored(docs, only).where("NOT is_kept").count() == 0
    assert R.train(empty(spark), labels).rules == () and R.scored(empty(spark), only).count() == 0
