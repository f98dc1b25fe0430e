"""Toxicity from confirmed examples and unlabelled text: non-negative positive-unlabelled learning.

A linear classifier over the presence of words and word beginnings (and of two or three words that begin so) minimises the non-negative PU risk
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))
with the logistic loss, by proximal Adam steps in numpy.  Positives are documents labelled toxic; the unlabelled
ones are documents without a label, and no label of a clean document is looked at.  The class prior is estimated from the same two samples:
a classifier fitted on one half of each scores the other, and the prior is the least ratio of the unlabelled to
the positives above a score.  Both samples are bounded (MOST_POSITIVE, MOST_UNLABELLED), so is the number of
features (MOST_FEATURES); Spark counts the features, the driver gets their numbers only.  All documents are scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Known, plain, table

MOST_POSITIVE, MOST_UNLABELLED, MOST_FEATURES, SEED = 2000, 6000, 200_000, 11
#: the prior that is assumed until it is estimated
FIRST_PRIOR, PRIOR_ROUNDS = 0.1, 3
BEGINNING = 5
L1, STEPS, RATE = 4e-4, 300, 0.08


class Model(NamedTuple):
    bias: float
    weights: dict[bytes, float]
    prior: float
    clipped: int = 0  # steps at which the clean risk was below 0


def features(word: bytes) -> tuple[bytes, ...]:
    """Of a word as plain() gives it: itself, and how it begins."""
    start = word.decode()[:BEGINNING].encode()
    return (word, b"^" + start) if len(start) < len(word) else (word,)


def counted(words: Iterable[tuple[bytes, ...]]) -> set[bytes]:
    """Features of distinct words, and those that two and that three words share once more under names of their own."""
    counts = Counter(f for own in words for f in own)
    return {k + f for f, n in counts.items() for k in (b"", b"2", b"3")[:n]}


def document_features(text: str | None) -> set[bytes]:
    words = {plain(t) for t in set((text or "").encode().split())}
    return counted(features(w) for w in words if w)


class Rows(NamedTuple):
    """A sample as a sparse matrix of ones: entry i is feature[i] of row[i]."""

    row: np.ndarray
    feature: np.ndarray
    n: int

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Rows:
        return cls(np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate([np.empty(0, np.int64), *docs]).astype(np.int64), len(docs))

    def share(self, n_features: int) -> np.ndarray:
        return np.bincount(self.feature, minlength=n_features) / max(1, self.n)

    def score(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, w[self.feature], minlength=self.n) + b


def _terms(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    soft = lambda z: float(np.logaddexp(0, z).mean())
    return prior * soft(-zp), soft(zu) - prior * soft(zp)


def risk(p: Rows, u: Rows, w: np.ndarray, b: float, prior: float) -> tuple[float, float]:
    """The two terms: prior * R_p(+), and R_u(-) - prior * R_p(-), which the estimator holds at 0 or more."""
    return _terms(p.score(w, b), u.score(w, b), prior)


def gradient(p: Rows, u: Rows, w: np.ndarray, b: float, prior: float, share: np.ndarray | None = None) -> tuple[np.ndarray, float, bool]:
    """By w and b, and whether the second term is clipped: of the risk, or, where that is so, of less the second term, to get it back.

    share: how many of p have each feature, over their number, where that is known.
    """

    def clean(x: Rows, z: np.ndarray) -> tuple[np.ndarray, float]:  # of R(-)
        each = 1 / (1 + np.exp(-np.clip(z, -30, 30))) / x.n
        return np.bincount(x.feature, each[x.row], minlength=len(w)), float(each.sum())

    zp, zu = p.score(w, b), u.score(w, b)
    (ng, ngb), (ug, ugb) = clean(p, zp), clean(u, zu)
    if _terms(zp, zu, prior)[1] >= 0:
        # R_p(+) and R_p(-) differ by the scores alone: prior * (ng - share) + ug - prior * ng
        share = p.share(len(w)) if share is None else share
        return ug - prior * share, ugb - prior, False
    return prior * ng - ug, prior * ngb - ugb, True


def fit(p: Rows, u: Rows, n_features: int, prior: float, l1: float = L1, steps: int = STEPS, rate: float = RATE) -> tuple[np.ndarray, float, int]:
    """Weights and bias, the means of the last third of the steps, and the number of clipped steps, which go back and forth."""
    w, b, clipped = np.zeros(n_features), -1.0, 0
    sum_w, sum_b, counted_, share = np.zeros(n_features), 0.0, 0, p.share(n_features)
    first, second, fb, sb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for step in range(1, steps + 1):
        g, gb, below = gradient(p, u, w, b, prior, share)
        clipped += below
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        fb, sb = 0.9 * fb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        scale = rate / (np.sqrt(second / c2) + 1e-6)
        w = w - scale * first / c1
        w = np.sign(w) * np.maximum(0, np.abs(w) - scale * l1)
        b -= rate * (fb / c1) / (np.sqrt(sb / c2) + 1e-6)
        if 3 * step > 2 * steps:
            sum_w, sum_b, counted_ = sum_w + w, sum_b + b, counted_ + 1
    return sum_w / max(1, counted_), float(sum_b / max(1, counted_)), clipped


def estimated_prior(p: list[np.ndarray], u: list[np.ndarray], n_features: int) -> float:
    """The share of positives among u: each half is scored by a classifier of the other.

    Above any score there are at least prior times as many of u as of p, so the least ratio over scores that
    a fifth of p exceed bounds it, and comes near where a score tells the two apart.  A ratio of few is as likely
    too small as too large: a standard error is added.  A classifier for the prior that was found may tell them apart better:
    the least of a few rounds counts.
    """
    best, prior = 0.9, FIRST_PRIOR
    for _ in range(PRIOR_ROUNDS):
        x, y = [], []
        for k in (0, 1):
            w, b, _ = fit(Rows.of(p[k::2]), Rows.of(u[k::2]), n_features, prior, steps=STEPS // 3)
            x.append(Rows.of(p[1 - k :: 2]).score(w, b))
            y.append(Rows.of(u[1 - k :: 2]).score(w, b))
        x, y = np.sort(np.concatenate(x)), np.sort(np.concatenate(y))
        bounds = x[: max(1, int(0.8 * len(x)))]
        of_x, of_y = len(x) - np.searchsorted(x, bounds), len(y) - np.searchsorted(y, bounds)
        ratio = (of_y / len(y)) / (of_x / len(x)) * (1 + np.sqrt(1 / np.maximum(of_y, 1) + 1 / of_x))
        best = min(best, max(float(ratio.min()), 1e-3))
        if best == prior:
            break
        prior = best
    return best


def learn(p: list[np.ndarray], u: list[np.ndarray], vocabulary: list[bytes], prior: float | None = None) -> Model:
    """The classifier; one that calls nothing toxic if there are too few examples to halve, or no feature of two of them."""
    if len(p) < 2 or len(u) < 2 or not vocabulary:
        return Model(-10.0, {}, prior or FIRST_PRIOR)
    if prior is None:
        prior = estimated_prior(p, u, len(vocabulary))
    w, b, clipped = fit(Rows.of(p), Rows.of(u), len(vocabulary), prior)
    return Model(b, {vocabulary[i]: float(w[i]) for i in np.nonzero(w)[0]}, prior, clipped)


def train(
    docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, most_features: int = MOST_FEATURES, seed: int = SEED
) -> Model:
    """A model from documents labelled toxic and documents without a label, at most so many of each, in the order of a seeded hash.

    Where every document has a label, labels are hidden: the unlabelled are drawn from all.  Features are those of
    two positive documents or more, the most frequent ones.  Labels and documents without an id don't count; of several
    labels the worst does; documents that share an id are examples each.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("id"), labels["toxic"].cast("int").alias("toxic")).where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    ids = docs.select(docs["doc_id"].cast("long").alias("id")).where("id is not null").distinct()
    first = lambda rows, k, n: rows.orderBy(F.xxhash64("id", F.lit(seed + k)), "id").limit(n).select("id", F.lit(1 - k).alias("part")).collect()
    chosen = first(known.where("toxic = 1").join(ids, "id", "left_semi"), 0, most_positive)
    if not chosen:
        return learn([], [], [])
    chosen += first(ids.join(known, "id", "left_anti"), 1, most_unlabelled) or first(ids, 1, most_unlabelled)
    spark = docs.sparkSession
    picked = F.broadcast(spark.createDataFrame(chosen, "id long, part int"))  # two bounded samples of ids
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text")).join(picked, "id").select("part", "id", "text")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                seen.update(document_features(text.as_py()))
                if len(seen) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["feature", "n"])
                    seen = Counter()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["feature", "n"])

    frequent = texts.where("part = 1").mapInArrow(counts, "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n")).where("n >= 2")
    vocabulary = sorted(bytes(r.feature) for r in frequent.orderBy(F.col("n").desc(), "feature").limit(most_features).select("feature").collect())

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {f: i for i, f in enumerate(vocabulary)}
        for batch in batches:
            own = [sorted(at[f] for f in document_features(t.as_py()) if f in at) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("id"), pa.array(own, pa.list_(pa.int32()))], names=["part", "id", "own"])

    taken = texts.mapInArrow(numbers, "part int, id long, own array<int>").toArrow()
    rows = sorted(zip(taken["part"].to_pylist(), taken["id"].to_pylist(), (np.array(x.as_py(), np.int64) for x in taken["own"])), key=lambda r: (r[0], r[1], r[2].tolist()))
    rng = np.random.default_rng(seed)
    part = lambda k: (lambda own: [own[i] for i in rng.permutation(len(own))])([x for p, _, x in rows if p == k])
    return learn(part(1), part(0), vocabulary)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, toxic_score (probability), is_toxic (0.5 or more): a row for each of docs.

    A text that is null, empty or without a word has the score of the bias alone.  Repeated rows are scored
    each; a null doc_id stays null; an empty table has an empty result; columns beside doc_id and text have
    no part.  Long texts are scored by all their words.
    """
    bias, weights = model.bias, model.weights

    def run(texts: pa.Array) -> pa.Array:
        base = {f for k in weights for f in (k, k[1:] if k[:1] in b"23" else k)}

        def known(token: bytes) -> tuple[bytes, tuple[bytes, ...]] | None:
            word = plain(token)
            own = tuple(f for f in features(word) if f in base) if word else ()
            return (word, own) if own else None

        heavy = Known(known, 200_000)
        out = []
        for t in texts.cast(pa.binary()):
            own: dict[bytes, tuple[bytes, ...]] = {}  # words that weigh something, once each
            for token in set((t.as_py() or b"").split()):
                if found := heavy[token]:
                    own[found[0]] = found[1]
            out.append(bias + sum(sorted(weights.get(f, 0.0) for f in counted(own.values()))))
        return pa.array(1 / (1 + np.exp(-np.clip(np.array(out, float), -30, 30))))

    score = F.arrow_udf(run, "double")(docs["text"].cast("string"))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), score.alias("toxic_score")).withColumn("is_toxic", F.col("toxic_score") >= 0.5)


def op2_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
