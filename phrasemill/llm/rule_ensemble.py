"""Quality classifier: a sparse ensemble of rules.

Boosted regression trees over the text statistics of the labelled sample give paths, each path from a root
is a conjunctive rule, lasso logistic regression weighs the rules, and what keeps a weight is compiled into
one Spark column expression over the statistics: no model is sent to executors, and no user function runs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .quality_rules import STATISTICS, with_statistics

MOST_LABELLED, SEED = 8000, 5
TREES, DEPTH, LEAST, SHRINK = 30, 3, 8, 0.3
LASSO = 2e-3
Condition = tuple[str, bool, float]  # statistic, whether it is above (else at most) the bound, bound


class Ensemble(NamedTuple):
    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]  # conjunction and weight


def _split(x: np.ndarray, r: np.ndarray, least: int) -> tuple[int, float] | None:
    """The statistic and bound that cut the squares of r the most; of equals, the first."""
    n, best = len(r), (1e-9, None)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, s = x[order, j], np.cumsum(r[order])
        k = np.arange(1, n)
        gain = s[:-1] ** 2 / k + (s[-1] - s[:-1]) ** 2 / (n - k) - s[-1] ** 2 / n
        gain[(v[1:] <= v[:-1]) | (k < least) | (n - k < least)] = -1
        if len(gain) and gain.max() > best[0]:
            i = int(gain.argmax())
            best = (float(gain[i]), (j, float((v[i] + v[i + 1]) / 2)))
    return best[1]


def tree_paths(x: np.ndarray, r: np.ndarray, names: list[str], depth: int = DEPTH, least: int = LEAST) -> tuple[list[tuple[Condition, ...]], np.ndarray]:
    """Each node's path below the root, and the tree's value for each row."""
    paths, value = [], np.zeros(len(r))

    def grow(at: np.ndarray, path: tuple[Condition, ...]) -> None:
        if path:
            paths.append(path)
        value[at] = r[at].mean()
        if len(path) < depth and len(at) >= 2 * least and (cut := _split(x[at], r[at], least)):
            above = x[at, cut[0]] > cut[1]
            grow(at[~above], (*path, (names[cut[0]], False, cut[1])))
            grow(at[above], (*path, (names[cut[0]], True, cut[1])))

    if len(r):
        grow(np.arange(len(r)), ())
    return paths, value


def _holds(path: tuple[Condition, ...], x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, bound in path:
        out &= (x[:, names.index(name)] > bound) == above
    return out


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of L1-penalised logistic regression, by accelerated proximal gradient steps."""
    n, m = a.shape
    rate = 4.0 / (np.linalg.norm(a, 2) ** 2 / n + 1.0)
    w = v = np.zeros(m)
    b = vb = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    t = 1.0
    for _ in range(steps):
        g = (1 / (1 + np.exp(-np.clip(a @ v + vb, -30, 30))) - y) / n
        u = v - rate * (a.T @ g)
        w2, b2 = np.sign(u) * np.maximum(0, np.abs(u) - rate * penalty), vb - rate * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return float(b), w


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, penalty: float = LASSO) -> Ensemble:
    """The ensemble for labels y (0 or 1); one that keeps everything if there is but one kind of label."""
    if not len(y) or y.min() == y.max():
        return Ensemble(1.0 if not len(y) or y[0] else -1.0, ())
    paths, score = [], np.zeros(len(y))
    for _ in range(trees):
        new, value = tree_paths(x, y - 1 / (1 + np.exp(-score)), names)
        paths += new
        score = score + 4 * SHRINK * value
    by_rows: dict[bytes, tuple[Condition, ...]] = {}
    for path in sorted(set(paths), key=lambda p: (len(p), p)):
        held = _holds(path, x, names)
        if held.any() and not held.all():
            by_rows.setdefault(held.tobytes(), path)  # of rules that hold for the same rows, the shortest
    kept = list(by_rows.values())
    if not kept:  # nothing tells the labels apart
        return Ensemble(float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), ())
    b, w = _lasso(np.stack([_holds(p, x, names) for p in kept], 1).astype(float), y.astype(float), penalty)
    return Ensemble(b, tuple((p, float(c)) for p, c in zip(kept, w) if abs(c) > 1e-6))


def evaluate(model: Ensemble, x: np.ndarray, names: list[str]) -> np.ndarray:
    return model.intercept + sum((w * _holds(p, x, names) for p, w in model.rules), np.zeros(len(x)))


def compiled(model: Ensemble, column: Callable[[str], Column] = F.col) -> Column:
    """The ensemble's log-odds as a column expression over columns of the statistics' names."""

    def rule(path: tuple[Condition, ...]) -> Column:
        sides = [(column(n) > F.lit(b)) if above else (column(n) <= F.lit(b)) for n, above, b in path]
        return reduce(lambda a, b: a & b, sides)

    terms = [F.when(rule(p), F.lit(w)).otherwise(F.lit(0.0)) for p, w in model.rules]
    return reduce(lambda a, b: a + b, terms, F.lit(model.intercept))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, seed: int = SEED) -> Ensemble:
    """From at most ``most`` labelled documents, in the order of a seeded hash; of several labels the least counts."""
    known = (
        labels.select(labels["doc_id"].cast("long").alias("id"), labels["quality"].cast("int").alias("quality"))
        .where("id is not null and quality is not null")
        .groupBy("id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("id", F.lit(seed)), "id")
        .limit(most)
    )  # bounded, so it is safe to broadcast
    own = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text")).join(F.broadcast(known), "id")
    rows = with_statistics(own, [own["id"], own["quality"]]).toPandas().sort_values(["id", *STATISTICS], kind="stable")
    return fit(rows[STATISTICS].to_numpy(float), rows["quality"].to_numpy(float), STATISTICS)


def scored(docs: DataFrame, model: Ensemble) -> DataFrame:
    """doc_id, quality_score (probability), is_kept (0.5 or more): a row for each of docs.

    A text that is null or empty is judged by its statistics, all zero; a very long one by all of it.  Odds of 0, a
    probability of one half, keep a document.  Repeated rows are judged each; a null doc_id stays null; an empty
    table has an empty result; columns beside doc_id and text have no part.
    """
    odds = with_statistics(docs, [docs["doc_id"].cast("long").alias("doc_id")]).select("doc_id", compiled(model).alias("odds"))
    return odds.select("doc_id", (1 / (1 + F.exp(-F.col("odds")))).alias("quality_score"), (F.col("odds") >= 0).alias("is_kept"))


def op7_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
