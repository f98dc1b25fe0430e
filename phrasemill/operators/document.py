"""Document kernels: a plan run on whole documents, batch by batch, without a shuffle.

Documents don't depend on each other, and a document's tokens are many times its text, so the ranking,
which iterates, and what depends on an order (clustering, boosts, greedy choices) run where the document is
read.  The word graphs of a batch are ranked together as one block-diagonal matrix.
"""

from __future__ import annotations

import gc
import json
import re
import time
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stopwords import LISTS, StopWords, language_code
from ..plans.config import Plan, TextRankConfig
from .spread import spread


class Token(NamedTuple):
    text: str
    lemma: str
    pos: str
    start: int
    end: int
    sentence_idx: int
    is_stopword: bool


class Chunk(NamedTuple):
    start: int
    end: int  # exclusive


class Phrase(NamedTuple):
    text: str
    lemma: str
    score: float
    count: int
    offsets: list[tuple[int, int]]


class Result(NamedTuple):
    phrases: list[Phrase]
    iterations: int
    converged: bool
    error: tuple[str, str, str] | None = None  # code, stage, message
    debug: dict[str, Any] | None = None


# ---- tokens


def tokenizer(extra: Sequence[str] = (), min_length: int = 1) -> Callable[[str | None, str | None], list[Token]]:
    """A function (text, language) to tokens, that remembers words."""
    ends, item = T.py_patterns()
    stops = {code: StopWords(code).add(extra).words for code in LISTS}
    words: dict[str, tuple[str, str, str] | None] = {}

    def known(word: str) -> tuple[str, str, str] | None:
        """Lemma, tag and lower case of a word; None for what isn't one."""
        if len(words) > 200_000:
            words.clear()
        found = (T.py_lemma(word), T.py_tag(word), word.lower()) if len(word) >= min_length and any(map(str.isalnum, word)) else None
        if len(word) <= 64:  # what is longer would hardly be met again
            words[word] = found
        return found

    def run(text: str | None, language: str | None = "en") -> list[Token]:
        marked = (text or "").replace(T.MARK, " ")
        for pattern, to in ends:
            marked = pattern.sub(to, marked)
        stop, out, at, sentence = stops[language_code(language)], [], 0, 0
        add, get, make = out.append, words.get, tuple.__new__
        for piece in marked.split(T.MARK):
            if piece.strip(" \t\n\x0b\x0c\r"):  # a no-break space isn't blank, in the tables' sentences either
                for m in item.finditer(piece):
                    word = m[0]
                    if (found := get(word)) or (word not in words and (found := known(word))):
                        begin = at + m.start()
                        add(make(Token, (word, found[0], found[1], begin, begin + len(word), sentence, found[2] in stop)))
                sentence += 1
            at += len(piece)
        return out

    return run


def key_of(t: Token, cfg: TextRankConfig) -> str:
    return f"{t.lemma}|{t.pos}" if cfg.use_pos_in_nodes else t.lemma


def is_kept(t: Token, cfg: TextRankConfig) -> bool:
    return not t.is_stopword and t.pos in (cfg.include_pos or T.CONTENT_TAGS)


# ---- graphs: numbered nodes and directed weighted edges


class Graph(NamedTuple):
    keys: list[str]
    src: np.ndarray
    dst: np.ndarray
    w: np.ndarray

    @classmethod
    def of(cls, keys: list[str], pairs: dict[tuple[int, int], float]) -> Graph:
        if not pairs:
            return cls(keys, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        ends = np.array(list(pairs), np.int64)
        w = np.array(list(pairs.values()), float)
        return cls(keys, np.r_[ends[:, 0], ends[:, 1]], np.r_[ends[:, 1], ends[:, 0]], np.r_[w, w])

    @classmethod
    def directed(cls, rows: Iterable[tuple[str, str, float]]) -> Graph:
        """From (source, target, weight): nodes as they come, the weights of one direction added up."""
        ids: dict[str, int] = {}
        sums: dict[tuple[int, int], float] = {}
        for a, b, w in rows:
            e = ids.setdefault(a, len(ids)), ids.setdefault(b, len(ids))
            sums[e] = sums.get(e, 0.0) + w
        ends = np.array(list(sums), np.int64).reshape(-1, 2)
        return cls(list(ids), ends[:, 0], ends[:, 1], np.array(list(sums.values()), float))

    def node(self, key: str) -> int | None:
        return self.keys.index(key) if key in self.keys else None

    def neighbours(self, key: str) -> list[tuple[str, float]]:
        at = self.src == self.node(key)
        return [(self.keys[j], float(w)) for j, w in sorted(zip(self.dst[at].tolist(), self.w[at].tolist()))]

    def degree(self, key: str) -> int:
        return int((self.src == self.node(key)).sum())

    def total_weight(self, key: str) -> float:
        return float(self.w[self.src == self.node(key)].sum())


def word_graph(tokens: list[Token], window: int, cross: bool, binary: bool, cfg: TextRankConfig, only: Iterable[int] | None = None) -> tuple[Graph, list[int], list[str]]:
    """The graph, each node's first position and each node's lemma; of the tokens at the places only, if that is given."""
    ids: dict[str, int] = {}
    first, lemmas, nodes, sentences = [], [], [], []
    include, with_pos = frozenset(cfg.include_pos or T.CONTENT_TAGS), cfg.use_pos_in_nodes
    some = None if only is None else frozenset(only)
    for i, (_, lemma, pos, _, _, sentence, stop) in enumerate(tokens):
        if stop or pos not in include if some is None else i not in some:
            continue
        k = f"{lemma}|{pos}" if with_pos else lemma
        if (n := ids.get(k)) is None:
            n = ids[k] = len(ids)
            first.append(i)
            lemmas.append(lemma)
        nodes.append(n)
        sentences.append(sentence)
    at, of, n = np.array(nodes, np.int64), np.array(sentences, np.int64), max(1, len(ids))
    found = []
    for d in range(1, min(window, len(at))):
        a, b = at[:-d], at[d:]
        ok = a != b if cross else (a != b) & (of[:-d] == of[d:])
        a, b = a[ok], b[ok]
        found.append(np.minimum(a, b) * n + np.maximum(a, b))
    edges, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64),) * 2
    a, b = np.divmod(edges, n)
    w = np.ones(len(edges)) if binary else count.astype(float)
    return Graph(list(ids), np.r_[a, b], np.r_[b, a], np.r_[w, w]), first, lemmas


def normalised(weights: np.ndarray) -> np.ndarray:
    total = weights.sum()
    return weights / total if total > 0 else np.full(len(weights), 1 / max(1, len(weights)))


def pagerank(graphs: list[Graph], teleports: list[np.ndarray | None], cfg: TextRankConfig, weighted: bool = True, traces: list[list[float]] | None = None) -> list[tuple[np.ndarray, int, float, bool]]:
    """(scores, iterations, last change, converged) of each graph.

    Sparse graphs are iterated together as one block-diagonal matrix, each until it stands still; one that has an edge
    for every few pairs is a matrix of its own.  traces gets each graph's changes, iteration by iteration.
    """
    if traces is not None:
        traces[:] = [[] for _ in graphs]
    out: list = [None] * len(graphs)
    sparse = []
    for i, g in enumerate(graphs):
        if len(g.keys) <= MOST_DENSE and 8 * len(g.src) > len(g.keys) ** 2 > 0:
            out[i] = _dense_rank(g, teleports[i], cfg, weighted, None if traces is None else traces[i])
        else:
            sparse.append(i)
    for i, found in zip(sparse, _sparse_ranks([graphs[i] for i in sparse], [teleports[i] for i in sparse], cfg, weighted, None if traces is None else [traces[i] for i in sparse])):
        out[i] = found
    return out


#: nodes of a graph that may be ranked as a matrix
MOST_DENSE = 512


def _dense_rank(g: Graph, teleport: np.ndarray | None, cfg: TextRankConfig, weighted: bool, trace: list[float] | None) -> tuple[np.ndarray, int, float, bool]:
    n, d = len(g.keys), cfg.damping
    share = np.zeros((n, n))
    share[g.src, g.dst] = g.w if weighted else g.w > 0
    out = share.sum(1)
    idle = out <= 0
    share /= np.where(idle, 1.0, out)[:, None]
    p = np.full(n, 1 / n) if teleport is None else teleport
    score, steps, change = np.full(n, 1 / n), 0, np.inf
    while steps < cfg.max_iterations and change > cfg.convergence_threshold:
        new = (1 - d + d * score[idle].sum()) * p + d * (score @ share)
        change, score, steps = float(np.abs(new - score).sum()), new, steps + 1
        if trace is not None:
            trace.append(change)
    total = score.sum()
    return (score / total if total > 0 else score), steps, change, bool(change <= cfg.convergence_threshold)


def _sparse_ranks(graphs: list[Graph], teleports: list[np.ndarray | None], cfg: TextRankConfig, weighted: bool, traces: list[list[float]] | None) -> list[tuple[np.ndarray, int, float, bool]]:
    size = np.array([len(g.keys) for g in graphs], np.int64)
    begin = np.cumsum(size) - size
    src = np.concatenate([g.src + b for g, b in zip(graphs, begin)]) if graphs else np.empty(0, np.int64)
    dst = np.concatenate([g.dst + b for g, b in zip(graphs, begin)]) if graphs else np.empty(0, np.int64)
    w = np.concatenate([g.w for g in graphs]) if graphs else np.empty(0)
    if not weighted:
        w = (w > 0).astype(float)
    p = np.concatenate([1 / np.full(len(g.keys), max(1, len(g.keys)), float) if t is None else t for g, t in zip(graphs, teleports)]) if graphs else np.empty(0)
    score, steps, change = block_ranks(size, src, dst, w, p, cfg, traces)
    found = []
    for i in range(len(graphs)):
        own = score[begin[i] : begin[i] + size[i]]
        total = own.sum()
        found.append((own / total if total > 0 else own, int(steps[i]), float(change[i]), bool(change[i] <= cfg.convergence_threshold)))
    return found


def block_ranks(size: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, p: np.ndarray | None, cfg: TextRankConfig, traces: list[list[float]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores before they are normalised, iterations, last change) of graphs of size nodes each, numbered one graph behind the other; p: teleport, None for a uniform one."""
    k, n = len(size), int(size.sum())
    doc = np.repeat(np.arange(k), size)
    out = np.bincount(src, w, n)
    share = w / np.where(out > 0, out, 1)[src]
    idle = out <= 0
    score = 1.0 / np.maximum(1, size)[doc]
    p = score if p is None else p
    d, change, steps = cfg.damping, np.where(size > 0, np.inf, 0.0), np.zeros(k, np.int64)
    on = size > 0
    while on.any():
        lost = np.bincount(doc, score * idle, k)
        new = (1 - d) * p + d * lost[doc] * p + d * np.bincount(dst, score[src] * share, n)
        delta = np.bincount(doc, np.abs(new - score), k)
        score = np.where(on[doc], new, score)
        change, steps = np.where(on, delta, change), steps + on
        for i in np.nonzero(on)[0] if traces is not None else ():
            traces[i].append(float(delta[i]))
        on = on & (steps < cfg.max_iterations) & (change > cfg.convergence_threshold)
    return score, steps, change


# ---- chunks and phrases


_KINDS = {"ADJ": "a", "NOUN": "n", "PROPN": "n", "DET": "d"}
#: upper case for a sentence's first token, which nothing before it runs into
_CHUNKS = {False: re.compile("[Aa]a*n+|[Nn]n*"), True: re.compile("[Dd]a*n+|[Aa]a*n+|[Nn]n*")}


def noun_chunks(tokens: list[Token], least: int, most: int, determiners: bool = False, splits: list | None = None) -> list[Chunk]:
    """Adjectives and then nouns; splits gets what isn't a chunk, and why."""
    if splits is None:
        kinds, before = [], None
        for t in tokens:
            kind = "s" if t.is_stopword else _KINDS.get(t.pos, "o")
            kinds.append(kind if t.sentence_idx == before else kind.upper())
            before = t.sentence_idx
        spans = (m.span() for m in _CHUNKS[determiners].finditer("".join(kinds)))
        return [Chunk(max(i, k - most), k) for i, k in spans if min(k - i, most) >= least]
    out, i, n = [], 0, len(tokens)
    while i < n:
        t = tokens[i]
        if t.is_stopword:
            if splits is not None:
                splits.append((i, i + 1, t.text, "stopword_boundary"))
            i += 1
            continue
        end = i
        while end < n and tokens[end].sentence_idx == t.sentence_idx:
            end += 1
        j = i
        fits = lambda k, tags: k < end and not tokens[k].is_stopword and tokens[k].pos in tags  # noqa: B023, E731
        if determiners and fits(j, ("DET",)):
            j += 1
        while fits(j, ("ADJ",)):
            j += 1
        k = j
        while fits(k, ("NOUN", "PROPN")):
            k += 1
        if k == j:
            if splits is not None:
                splits.append((i, i + 1, t.text, "pattern_mismatch"))
            i += 1
            continue
        if k - i > most:
            if splits is not None:
                splits.append((i, k, " ".join(x.text for x in tokens[i:k]), "max_length_exceeded"))
            i = k - most
        if k - i >= least:
            out.append(Chunk(i, k))
        elif splits is not None:
            splits.append((i, k, " ".join(x.text for x in tokens[i:k]), "min_length_not_met"))
        i = k
    return out


def aggregate(scores: Sequence[float], how: str) -> float:
    if not len(scores):
        return 0.0
    if how == "sum":
        return float(sum(scores))
    if how == "mean":
        return float(sum(scores) / len(scores))
    if how == "max":
        return float(max(scores))
    return float((sum(s * s for s in scores) / len(scores)) ** 0.5)


class Scored(NamedTuple):
    chunk: Chunk
    start_char: int
    end_char: int
    text: str
    lemma: str
    score: float


def resolve_overlaps_greedy(chunks: list[Scored]) -> tuple[list[Scored], list[tuple[Scored, Scored]]]:
    """The best chunks that don't overlap, in the order of the text, and (dropped, what it overlaps: the best of several)."""
    starts, ends, at = [], [], []  # of those that are kept, in the order of the text: what overlaps a chunk is found by search
    kept: list[Scored] = []
    dropped = []
    for c in sorted(chunks, key=lambda c: -c.score):
        i, j = bisect_right(ends, c.start_char), bisect_left(starts, c.end_char)
        if i < j:
            dropped.append((c, kept[min(at[i:j])]))
        else:
            starts.insert(j, c.start_char)
            ends.insert(j, c.end_char)
            at.insert(j, len(kept))
            kept.append(c)
    return sorted(kept, key=lambda c: c.start_char), dropped


def resolve_overlaps(chunks: list[Scored]) -> list[Scored]:
    """From left to right, a chunk that overlaps the last one replaces it if its score is higher."""
    out: list[Scored] = []
    end = 0
    for c in sorted(chunks, key=lambda c: (c.start_char, -c.score)):
        if c.start_char >= end:
            out.append(c)
            end = c.end_char
        elif c.score > (out[-1].score if out else 0.0):
            out[-1:] = [c]
            end = c.end_char
    return out


def order_key(p: Phrase):
    start, end = p.offsets[0] if p.offsets else (1 << 60, 1 << 60)
    return -round(p.score, 10), start, end - start, p.lemma


def _group_name(text: str) -> str:
    low = text.lower()
    return low if low.replace(" ", "").isalnum() else T.py_scrub(text)


def grouped(chunks: list[Scored], cfg: TextRankConfig) -> list[Phrase]:
    groups: dict[str, list[Scored]] = {}
    by_lemma = cfg.phrase_grouping == "lemma"
    for c in chunks:
        name = c.lemma if by_lemma else _group_name(c.text)
        if (own := groups.get(name)) is None:
            groups[name] = [c]
        else:
            own.append(c)
    out = []
    for own in groups.values():
        if len(own) == 1:
            (c,) = own
            out.append(Phrase(c.text, c.lemma, aggregate([c.score], cfg.score_aggregation) if by_lemma else c.score, 1, [tuple(c.chunk)]))
            continue
        offsets = sorted((c.chunk.start, c.chunk.end) for c in own)
        if by_lemma:
            counts = Counter(c.text for c in own)
            text = min(counts, key=lambda x: (-counts[x], x))
            out.append(Phrase(text, own[0].lemma, aggregate([c.score for c in own], cfg.score_aggregation), len(own), offsets))
        else:
            best = max(own, key=lambda c: (round(c.score, 10), c.chunk.start))
            out.append(Phrase(best.text, best.lemma, max(c.score for c in own), len(own), offsets))
    return out


def score_chunks(tokens: list[Token], chunks: list[Chunk], scores: dict[str, float], cfg: TextRankConfig) -> list[Scored]:
    out = []
    how, with_pos, get = cfg.score_aggregation, cfg.use_pos_in_nodes, scores.get
    for c in chunks:
        own = tokens[c.start : c.end]
        found = [s for s in [get(f"{t.lemma}|{t.pos}" if with_pos else t.lemma) for t in own] if s is not None]
        if len(own) == 1:
            (t,) = own
            out.append(Scored(c, t.start, t.end, t.text, t.lemma, aggregate(found, how)))
        else:
            out.append(Scored(c, own[0].start, own[-1].end, " ".join([t.text for t in own]), " ".join([t.lemma for t in own]), aggregate(found, how)))
    return out


# ---- topics


class Candidate(NamedTuple):
    chunk: Chunk
    text: str
    lemma: str
    terms: frozenset[str]


def phrase_candidates(tokens: list[Token], cfg: TextRankConfig, most: int) -> list[Candidate]:
    out = []
    for start, end in noun_chunks(tokens, cfg.min_phrase_length, cfg.max_phrase_length)[:most]:
        while start < end and not is_kept(tokens[start], cfg):
            start += 1
        if start < end:
            own = tokens[start:end]
            out.append(Candidate(Chunk(start, end), " ".join(t.text for t in own), " ".join(t.lemma for t in own), frozenset(t.text for t in own if not t.is_stopword)))
    return out


def jaccard_distances(sets: list[frozenset[str]]) -> np.ndarray:
    """1 - common / union; pairs meet by a term they share."""
    ids: dict[str, int] = {}
    rows = np.array([i for i, s in enumerate(sets) for _ in s], np.int64)
    terms = np.array([ids.setdefault(t, len(ids)) for s in sets for t in s], np.int64)
    order = np.argsort(terms, kind="stable")
    rows, terms = rows[order], terms[order]
    m, found = len(sets), []
    for d in range(1, int(np.bincount(terms, minlength=1).max(initial=0))):
        same = terms[:-d] == terms[d:]
        found.append(rows[:-d][same] * m + rows[d:][same])
    common = np.bincount(np.concatenate(found), minlength=m * m).reshape(m, m).astype(float) if found else np.zeros((m, m))
    common += common.T
    n = np.array([len(s) for s in sets], float)
    np.fill_diagonal(common, n)
    union = n[:, None] + n[None, :] - common
    return np.where(union > 0, 1 - common / np.where(union > 0, union, 1), 0.0)


def hac(dist: np.ndarray, threshold: float, linkage: str = "average") -> list[list[int]]:
    """Clusters by least member: the closest pair, the first of several, is merged while it is near enough."""
    n = len(dist)
    clusters: list[list[int] | None] = [[i] for i in range(n)]
    if n < 2:
        return [c for c in clusters if c]
    cutoff = min(max(0.99 - threshold, 0.0), 1.0)
    total, count = dist.astype(float).copy(), np.ones(n)
    upper = np.where(np.triu(np.ones((n, n), bool), 1), total, np.inf)
    for _ in range(n - 1):
        i, j = divmod(int(upper.argmin()), n)
        if not upper[i, j] <= cutoff:
            break
        if linkage == "average":
            total[i] += total[j]
            total[:, i] = total[i]
        else:
            total[i] = (np.minimum if linkage == "single" else np.maximum)(total[i], total[j])
            total[:, i] = total[i]
        count[i] += count[j]
        clusters[i] += clusters[j]
        clusters[j] = None
        upper[j], upper[:, j] = np.inf, np.inf
        near = total[i] / (count[i] * count) if linkage == "average" else total[i]
        alive = np.array([c is not None for c in clusters])
        right, left = alive & (np.arange(n) > i), alive & (np.arange(n) < i)
        upper[i, right], upper[left, i] = near[right], near[left]
    return [c for c in clusters if c]


def gaps(cands: list[Candidate]) -> np.ndarray:
    start, end = np.array([c.chunk.start for c in cands]), np.array([c.chunk.end for c in cands])
    raw = np.abs(start[:, None] - start[None, :])
    length = np.where(start[:, None] < start[None, :], (end - start)[:, None] - 1, np.where(start[:, None] > start[None, :], (end - start)[None, :] - 1, 0))
    return np.maximum(1, raw - np.maximum(0, length))


def topic_graph(cands: list[Candidate], clusters: list[list[int]], edge_weight: float) -> Graph:
    near = 1.0 / gaps(cands)
    of = np.empty(len(cands), np.int64)
    for c, members in enumerate(clusters):
        of[members] = c
    k = len(clusters)
    w = np.bincount((of[:, None] * k + of[None, :]).ravel(), near.ravel(), k * k).reshape(k, k) * edge_weight
    np.fill_diagonal(w, 0)
    src, dst = np.nonzero(w > 0)
    return Graph([str(i) for i in range(len(clusters))], src, dst, w[src, dst])


def without_intra(w: np.ndarray, clusters: list[list[int]]) -> np.ndarray:
    """Weights between candidates without those within a topic."""
    w = w.copy()
    for members in clusters:
        w[np.ix_(members, members)] = 0
    return w


def boosted(w: np.ndarray, cands: list[Candidate], clusters: list[list[int]], alpha: float) -> np.ndarray:
    """The first of each topic gains what leads to its others, times alpha * exp(1 / (1 + its place)); topics in order."""
    w = w.copy()
    for members in clusters:
        if len(members) < 2:
            continue
        first = min(members, key=lambda i: cands[i].chunk.start)
        others = [i for i in members if i != first]
        more = alpha * np.exp(1.0 / (1.0 + cands[first].chunk.start)) * w[others].sum(0)
        more[members] = 0
        w[:, first] += more
    return w


def candidate_graph(cands: list[Candidate], clusters: list[list[int]] | None, transforms: Sequence[Any]) -> Graph:
    """All pairs by 1 / gap, through transforms in order.

    A number stands for the removal of edges within topics and, above 0, a boost by it; a function takes the weights, the
    candidates and their clusters and returns weights.
    """
    w = 1.0 / gaps(cands)
    np.fill_diagonal(w, 0)
    for t in transforms:
        if callable(t):
            w = t(w, cands, clusters)
        elif clusters is not None:
            w = without_intra(w, clusters)
            w = boosted(w, cands, clusters, t) if t > 0 else w
    src, dst = np.nonzero(w > 0)
    return Graph([str(i) for i in range(len(cands))], src, dst, w[src, dst])


def cluster_sets(sets: Sequence[Iterable], threshold: float, linkage: str = "average") -> list[list[int]]:
    """Clusters of any sets, of numbers say, by their Jaccard distances."""
    return hac(jaccard_distances([frozenset(x) for x in sets]), threshold, linkage)


def topic_phrases(cands: list[Candidate], clusters: list[list[int]], scores: np.ndarray) -> list[Phrase]:
    out = []
    for c, members in enumerate(clusters):
        best = cands[min(members, key=lambda i: cands[i].chunk.start)]
        out.append(Phrase(best.text, best.lemma, float(scores[c]), len(members), sorted(tuple(cands[i].chunk) for i in members)))
    return out


def multipartite_phrases(cands: list[Candidate], scores: np.ndarray) -> list[Phrase]:
    groups: dict[str, list[int]] = {}
    for i, c in enumerate(cands):
        groups.setdefault(c.lemma, []).append(i)
    out = []
    for own in groups.values():
        best = max(own, key=lambda i: (round(float(scores[i]), 12), i))
        out.append(Phrase(cands[best].text, cands[best].lemma, float(scores[best]), len(own), sorted(tuple(cands[i].chunk) for i in own)))
    return out


# ---- sentences


class SentenceSpan(NamedTuple):
    index: int
    start: int
    end: int  # tokens, exclusive
    lemmas: frozenset[str]


def sentence_spans(tokens: list[Token]) -> list[SentenceSpan]:
    out, i = [], 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and tokens[j].sentence_idx == tokens[i].sentence_idx:
            j += 1
        out.append(SentenceSpan(tokens[i].sentence_idx, i, j, frozenset(t.lemma for t in tokens[i:j] if not t.is_stopword)))
        i = j
    return out


def sentence_graph(spans: list[SentenceSpan], least: float) -> Graph:
    """Jaccard similarity above ``least``; sentences meet by the lemmas they share."""
    least = min(max(least, 0.0), 1.0)
    has: dict[str, list[int]] = {}
    common: Counter = Counter()
    for i, s in enumerate(spans):
        for lemma in s.lemmas:
            before = has.setdefault(lemma, [])
            common.update((j, i) for j in before)
            before.append(i)
    pairs = {}
    for (i, j), n in common.items():
        w = n / (len(spans[i].lemmas) + len(spans[j].lemmas) - n)
        if w > least:
            pairs[i, j] = w
    empty = [i for i, s in enumerate(spans) if not s.lemmas]
    if least < 1.0:
        pairs.update({(i, j): 1.0 for k, i in enumerate(empty) for j in empty[k + 1 :]})
    return Graph.of([str(s.index) for s in spans], dict(sorted(pairs.items())))


def sentence_phrases(tokens: list[Token], spans: list[SentenceSpan], scores: np.ndarray) -> list[Phrase]:
    return [Phrase(" ".join(t.text for t in tokens[s.start : s.end]), "", float(x), 1, [(tokens[s.start].start, tokens[s.end - 1].end)]) for s, x in zip(spans, scores)]


# ---- summaries


class Selected(NamedTuple):
    sentence_idx: int
    start_token: int
    end_token: int
    relevance: float
    mmr_score: float  # lambda * relevance
    selection_score: float  # what it was chosen by
    order: int


def _unit(weights: dict[str, float]) -> dict[str, float]:
    size = sum(w * w for w in weights.values()) ** 0.5
    return {k: w / size for k, w in weights.items()} if size > 0 else {}


def _cosine(a: dict[str, float], b: dict[str, float]) -> float:
    return sum(w * b[k] for k, w in a.items() if k in b)


def summary(
    tokens: list[Token], phrases: list[Phrase], n: int = 3, lam: float = 0.7, least: int = 5, most: int = 100, by_score: bool = True
) -> tuple[list[Selected], float, float]:
    """Sentences by maximal marginal relevance in the order of the text, then relevance and diversity of the choice."""
    lam = min(max(lam, 0.0), 1.0)
    spans = [s for s in sentence_spans(tokens) if least <= s.end - s.start <= most]
    if not spans:
        return [], 0.0, 0.0
    query = _unit({p.lemma: p.score if by_score else 1.0 for p in phrases})
    words = [(p, p.lemma.lower().split()) for p in phrases]
    vectors = []
    for s in spans:
        own = [t.lemma.lower() for t in tokens[s.start : s.end]]
        at: dict[str, list[int]] = {}
        for i, x in enumerate(own):
            at.setdefault(x, []).append(i)
        weights: dict[str, float] = {}
        for p, ws in words:
            if not ws or any(own[i : i + len(ws)] == ws for i in at.get(ws[0], ())):
                weights[p.lemma] = weights.get(p.lemma, 0.0) + (p.score if by_score else 1.0)
        vectors.append(_unit(weights))
    relevance = [_cosine(v, query) for v in vectors]
    chosen: list[tuple[int, float]] = []
    closest = [0.0] * len(spans)
    while len(chosen) < min(n, len(spans)):
        taken = {i for i, _ in chosen}
        score, best = max(((lam * relevance[i] - (1 - lam) * closest[i], -i) for i in range(len(spans)) if i not in taken))
        i = -best
        for k in range(len(spans)):
            sim = _cosine(vectors[k], vectors[i])
            closest[k] = sim if not chosen else max(closest[k], sim)
        chosen.append((i, score))
    out = sorted(Selected(spans[i].index, spans[i].start, spans[i].end, relevance[i], lam * relevance[i], s, k) for k, (i, s) in enumerate(chosen))
    pairs = [_cosine(vectors[a], vectors[b]) for k, (a, _) in enumerate(chosen) for b, _ in chosen[k + 1 :]]
    return out, sum(s.relevance for s in out), 1.0 - sum(pairs) / len(pairs) if pairs else 1.0


# ---- a plan on documents


class _Prepared(NamedTuple):
    tokens: list[Token]
    graph: Graph
    teleport: np.ndarray | None
    parts: Any
    error: tuple[str, str, str] | None = None


class Watch:
    """Is told when stages begin and end; this one does nothing."""

    def start(self, stage: str) -> None: ...

    def end(self, stage: str, **metrics: Any) -> None: ...

    def tell(self, what: str, value: Any) -> None: ...


QUIET = Watch()


def prepare(tokens: list[Token], plan: Plan, watch: Watch = QUIET) -> _Prepared:
    cfg, own = plan.config, plan.stages
    none = Graph.of([], {})
    stage = "preprocess"

    def begin(name: str) -> None:
        nonlocal stage
        stage = name
        watch.start(name)

    def failed(code: str, message: str) -> _Prepared:
        return _Prepared(tokens, none, None, None, (code, stage, message))

    try:
        begin("preprocess")
        if own.preprocess:
            tokens = own.preprocess(tokens)
        watch.end("preprocess")
        watch.tell("tokens", tokens)
        if cfg.max_tokens is not None and len(tokens) > cfg.max_tokens:
            return failed("limit_exceeded", f"{len(tokens)} tokens exceed max_tokens {cfg.max_tokens}")
        begin("candidates")
        of_sentences = plan.candidates == "sentences" or plan.graph == "sentences"
        of_phrases = not of_sentences and (plan.candidates == "phrases" or plan.graph in ("topics", "candidates"))
        chosen = own.candidates(tokens, plan) if own.candidates else sentence_spans(tokens) if of_sentences else phrase_candidates(tokens, cfg, plan.max_phrases) if of_phrases else None
        watch.end("candidates")
        watch.tell("candidates", chosen)
        p, parts, first, lemmas = None, chosen, None, None
        begin("graph")
        if own.graph:
            graph = own.graph(tokens, chosen, plan)
            parts = (chosen, None) if of_phrases else chosen if of_sentences else ([], list(graph.keys))
            lemmas = [k.rpartition("|")[0] or k for k in graph.keys]
        elif of_sentences:
            graph = sentence_graph(chosen, plan.min_similarity)
        elif of_phrases:
            clusters = None
            if chosen and own.cluster:
                clusters = own.cluster(chosen, plan)
            elif chosen and plan.cluster_threshold is not None:
                clusters = hac(jaccard_distances([c.terms for c in chosen]), plan.cluster_threshold, plan.linkage)
            if plan.graph == "topics":
                clusters = clusters if clusters is not None else [[i] for i in range(len(chosen))]
                graph = topic_graph(chosen, clusters, plan.edge_weight) if chosen else none
            else:
                graph = candidate_graph(chosen, clusters, plan.chain) if chosen else none
            parts = (chosen, clusters)
        else:
            binary = plan.binary if plan.binary is not None else not cfg.use_edge_weights
            graph, first, lemmas = word_graph(tokens, plan.window or cfg.window_size, plan.cross_sentence, binary, cfg, chosen)
            parts = (first, lemmas)
        watch.end("graph", nodes=len(graph.keys), edges=len(graph.src))
        if own.transforms:
            begin("graph_transform")
            for t in own.transforms:
                graph = t(graph, tokens, plan)
            watch.end("graph_transform", nodes=len(graph.keys), edges=len(graph.src))
        watch.tell("graph", graph)
        begin("teleport")
        if own.teleport:
            p = own.teleport(graph, tokens, plan)
        elif plan.teleport == "position" and first is not None:
            p = normalised(1.0 / (np.array(first, float) + 1)) if first else np.empty(0)
        elif plan.teleport == "focus" and plan.focus_terms and lemmas is not None:
            terms = frozenset(plan.focus_terms)
            p = normalised(np.array([plan.bias_weight if x in terms else 1.0 for x in lemmas]))
        elif plan.teleport == "topics" and plan.topic_weights and lemmas is not None:
            known = dict(plan.topic_weights)
            p = normalised(np.array([known.get(x, plan.topic_min_weight) for x in lemmas], float))
        watch.end("teleport")
        stage = "graph"
        for what, most, size in (("max_nodes", cfg.max_nodes, len(graph.keys)), ("max_edges", cfg.max_edges, len(graph.src))):
            if most is not None and size > most:
                return failed("limit_exceeded", f"{size} exceeds {what} {most}")
        return _Prepared(tokens, graph, p, parts)
    except Exception as e:
        if not own.custom:
            raise
        return failed("stage_failed", f"{type(e).__name__}: {e}")  # a stage of the caller's: the document's error, not the batch's


def finish(plan: Plan, prepared: _Prepared, scores: np.ndarray, iterations: int, change: float, converged: bool, trace: list[float] | None = None, watch: Watch = QUIET) -> Result:
    cfg, debug, tokens, own = plan.config, None, prepared.tokens, plan.stages
    if prepared.error:
        return Result([], 0, False, prepared.error)
    level, splits, dropped = cfg.debug_level, [], []
    watch.start("phrases")
    if own.phrases:
        try:
            phrases, order = own.phrases(tokens, prepared.graph, scores, plan), order_key
        except Exception as e:  # noqa: BLE001 - the caller's
            return Result([], 0, False, ("stage_failed", "phrases", f"{type(e).__name__}: {e}"))
    elif isinstance(prepared.parts, list):
        phrases = sentence_phrases(tokens, prepared.parts, scores)
        order = lambda p: (-round(p.score, 10), p.offsets[0][0])
    elif plan.graph == "topics":
        cands, clusters = prepared.parts
        phrases, order = topic_phrases(cands, clusters or [], scores) if cands else [], order_key
    elif plan.graph == "candidates":
        phrases, order = multipartite_phrases(prepared.parts[0], scores), order_key
    else:
        known = dict(zip(prepared.graph.keys, scores.tolist()))
        chunks = score_chunks(tokens, noun_chunks(tokens, cfg.min_phrase_length, cfg.max_phrase_length, splits=splits if level == "full" else None), known, cfg)
        if level == "full":
            dropped += [(c.text, c.lemma, c.score, "zero_score") for c in chunks if c.score <= 0]
        phrases, order = grouped([c for c in chunks if c.score > 0], cfg), order_key
    phrases = sorted(phrases, key=order)
    if level == "full":
        dropped += [(p.text, p.lemma, p.score, "below_top_n") for p in (phrases[cfg.top_n :] if cfg.top_n else [])]
    if cfg.top_n:
        phrases = phrases[: cfg.top_n]
    if plan.sort_by_position and isinstance(prepared.parts, list):
        phrases = sorted(phrases, key=lambda p: p.offsets[0][0])
    watch.end("phrases")
    watch.tell("phrases", phrases)
    if level != "none":
        g = prepared.graph
        debug = {"graph_stats": {"num_nodes": len(g.keys), "num_edges": len(g.src), "avg_degree": len(g.src) / max(1, len(g.keys)), "is_transformed": bool(plan.chain or own.transforms)}}
        debug["convergence_summary"] = {"iterations": iterations, "final_delta": change if np.isfinite(change) else 0.0, "converged": converged}
        if level in ("top_nodes", "full"):
            best = sorted(zip(g.keys, scores.tolist()), key=lambda x: (-x[1], x[0]))[: cfg.debug_top_k]
            debug["node_scores"] = [{"key": k, "score": s} for k, s in best]
        if level == "full":
            debug["residuals"] = trace or []
            debug["phrase_diagnostics"] = [{"start": a, "end": b, "text": t, "reason": r} for a, b, t, r in splits]
            debug["dropped_candidates"] = [{"text": t, "lemma": x, "score": s, "reason": r} for t, x, s, r in dropped]
            if isinstance(prepared.parts, tuple) and plan.graph in ("topics", "candidates") and prepared.parts[1]:
                debug["cluster_memberships"] = prepared.parts[1]
                debug["cluster_details"] = [[{"index": i, "text": prepared.parts[0][i].text, "lemma": prepared.parts[0][i].lemma} for i in c] for c in prepared.parts[1]]
    return Result(phrases, iterations, converged, None, debug)


def run_documents(docs: list[list[Token]], plan: Plan, timings: dict[str, float] | None = None, plans: Sequence[Plan] | None = None, watch: Watch = QUIET) -> list[Result]:
    """Results in the order of docs; plans, one for each, where documents bring their own focus terms or topic weights."""
    clock = [time.perf_counter()]

    def lap(stage: str) -> None:
        clock.append(time.perf_counter())
        if timings is not None:
            timings[stage] = timings.get(stage, 0.0) + 1000 * (clock[-1] - clock[-2])

    plans = plans or [plan] * len(docs)
    ready = [prepare(t, p, watch) for t, p in zip(docs, plans)]
    lap("graph")
    traces: list[list[float]] | None = [] if plan.config.debug_level == "full" else None
    watch.start("rank")
    graphs, teleports = [r.graph for r in ready], [r.teleport for r in ready]
    if rank := plan.stages.rank:
        ranks = []
        for i, (g, p) in enumerate(zip(graphs, teleports)):
            try:
                ranks.append(rank(g, p, plan.config))
            except Exception as e:  # noqa: BLE001 - the caller's
                ranks.append((np.zeros(len(g.keys)), 0, 0.0, False))
                ready[i] = ready[i]._replace(error=ready[i].error or ("stage_failed", "rank", f"{type(e).__name__}: {e}"))
    else:
        ranks = pagerank(graphs, teleports, plan.config, traces=traces)
    if ranks:
        watch.end("rank", iterations=ranks[0][1], residual=ranks[0][2], converged=ranks[0][3])
        watch.tell("rank", ranks[0])
    lap("rank")
    out = [finish(p, r, *k, trace=traces[i] if traces else None, watch=watch) for i, (p, r, k) in enumerate(zip(plans, ready, ranks))]
    lap("phrases")
    return out


PHRASES = "doc_id long, rank int, text string, lemma string, score double, count int, offsets array<struct<start: int, end: int>>, iterations int, converged boolean"
RESULTS = f"doc_id long, phrases array<struct<rank: int, text: string, lemma: string, score: double, count: int, offsets: array<struct<start: int, end: int>>>>, converged boolean, iterations int, error struct<code: string, stage: string, message: string>, debug string"
TOKEN_FIELDS = "array<struct<text: string, lemma: string, pos: string, start: int, end: int, sentence_idx: int, token_idx: int, is_stopword: boolean>>"
PHRASE_TYPE = pa.struct(
    [("rank", pa.int32()), ("text", pa.string()), ("lemma", pa.string()), ("score", pa.float64()), ("count", pa.int32()), ("offsets", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
)


def from_structs(rows: list[dict] | None) -> list[Token]:
    """Tokens of an array column, by sentence and place; token_idx is counted anew, and a missing flag is false."""
    rows = [r for r in rows or [] if r]
    rows.sort(key=lambda r: (r["sentence_idx"] or 0, r["token_idx"] or 0))
    return [Token(r["text"] or "", r["lemma"] or "", T.py_tag_name(r["pos"]), r["start"] or 0, r["end"] or 0, r["sentence_idx"] or 0, bool(r["is_stopword"])) for r in rows]


def _documents(plan: Plan, batches: Iterator[pa.RecordBatch], size: int = 128) -> Iterator[tuple[list, list[list[Token]], list[Plan] | None]]:
    """(ids, documents' tokens, their plans), a few at once; documents come as items of their text or as token structs."""
    from . import batches as B

    cut = B.Cutter(plan.config.stopwords)
    extra = {w.lower() for w in plan.config.stopwords}
    gc.disable()  # tokens are many small objects without a cycle among them
    try:
        for batch in batches:
            gc.collect(1)
            structs = "tokens" in batch.schema.names
            for part in (batch.slice(i, size) for i in range(0, batch.num_rows, size)) if structs else B.few((batch,), size):
                ids = part.column("doc_id").to_pylist()
                if structs:
                    docs = [from_structs(r) for r in part.column("tokens").to_pylist()]
                    if extra:
                        docs = [[t._replace(is_stopword=t.is_stopword or t.text.lower() in extra) for t in d] for d in docs]
                else:
                    docs = B.documents(cut(part))
                plans = None
                for name, of in (("focus_terms", lambda x: tuple(t.lower() for t in x if t is not None)), ("topic_weights", lambda x: tuple(sorted((k, v) for k, v in x if v is not None)))):
                    if name in part.schema.names:
                        plans = [p if x is None else p.with_(**{name: of(x)}) for p, x in zip(plans or [plan] * len(ids), part.column(name).to_pylist())]
                yield ids, docs, plans
    finally:
        gc.enable()


def _input(docs: DataFrame, plan: Plan) -> DataFrame:
    """What the kernels read; focus_terms (array) and topic_weights (map) of docs are a document's own, where they aren't null."""
    own = []
    if plan.teleport == "focus" and "focus_terms" in docs.columns:
        own.append(docs["focus_terms"].cast("array<string>").alias("focus_terms"))
    if plan.teleport == "topics" and "topic_weights" in docs.columns:
        own.append(docs["topic_weights"].cast("map<string, double>").alias("topic_weights"))
    doc_id = docs["doc_id"].cast("long").alias("doc_id")
    if "tokens" in docs.columns:
        return spread(docs.select(doc_id, docs["tokens"].cast(TOKEN_FIELDS).alias("tokens"), *own))
    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(plan.config.language)
    from .batches import items

    return items(docs.select(doc_id, docs["text"].cast("string").alias("text"), lang.alias("lang"), *own))


def _offsets(p: Phrase) -> list[dict]:
    return [{"start": a, "end": b} for a, b in p.offsets]


def extract(docs: DataFrame, plan: Plan) -> DataFrame:
    """PHRASES, one row for each phrase of docs(doc_id, text, lang?) or docs(doc_id, tokens)."""
    names = [x.split()[0] for x in PHRASES.split(", ") if not x.startswith("end")]
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32(), PHRASE_TYPE.field("offsets").type, pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens, plans in _documents(plan, batches):
            rows = [(i, k, p.text, p.lemma, p.score, p.count, _offsets(p), r.iterations, r.converged) for i, r in zip(ids, run_documents(tokens, plan, plans=plans)) for k, p in enumerate(r.phrases, 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return _input(docs, plan).mapInArrow(run, PHRASES)


def extract_results(docs: DataFrame, plan: Plan) -> DataFrame:
    """RESULTS, one row for each document: its phrases, convergence, an error instead, and debug data as JSON."""
    error = pa.struct([("code", pa.string()), ("stage", pa.string()), ("message", pa.string())])
    types = [pa.int64(), pa.list_(PHRASE_TYPE), pa.bool_(), pa.int32(), error, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens, plans in _documents(plan, batches):
            rows = []
            for i, r in zip(ids, run_documents(tokens, plan, plans=plans)):
                found = [{"rank": k, **p._asdict(), "offsets": _offsets(p)} for k, p in enumerate(r.phrases, 1)]
                rows.append((i, found, r.converged, r.iterations, dict(zip(("code", "stage", "message"), r.error)) if r.error else None, json.dumps(r.debug) if r.debug else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "phrases", "converged", "iterations", "error", "debug"])

    return _input(docs, plan).mapInArrow(run, RESULTS)


def formatted(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, value: each document's result as the plan's format stage gives it, in JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens, plans in _documents(plan, batches):
            values = [json.dumps(plan.stages.format(r) if plan.stages.format else r._asdict(), ensure_ascii=False) for r in run_documents(tokens, plan, plans=plans)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.string())], names=["doc_id", "value"])

    return _input(docs, plan).mapInArrow(run, "doc_id long, value string")


def node_scores(docs: DataFrame, plan: Plan, weighted: bool = True) -> DataFrame:
    """doc_id, key, score, iterations, converged, of each node of the documents' graphs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens, plans in _documents(plan, batches):
            ready = [prepare(t, p) for t, p in zip(tokens, plans or [plan] * len(tokens))]
            rows = [
                (i, k, s, steps, done)
                for i, r, (scores, steps, _, done) in zip(ids, ready, pagerank([r.graph for r in ready], [r.teleport for r in ready], plan.config, weighted))
                for k, s in zip(r.graph.keys, scores.tolist())
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.bool_()))], names=["doc_id", "key", "score", "iterations", "converged"])

    return _input(docs, plan).mapInArrow(run, "doc_id long, key string, score double, iterations int, converged boolean")


def clusters(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, cand, cluster, lemma: the topic of each phrase candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens, _ in _documents(plan, batches):
            rows = []
            for i, t in zip(ids, tokens):
                cands = phrase_candidates(t, plan.config, plan.max_phrases)
                for c, members in enumerate(hac(jaccard_distances([x.terms for x in cands]), 0.25 if plan.cluster_threshold is None else plan.cluster_threshold, plan.linkage) if cands else []):
                    rows += [(i, m, c, cands[m].lemma) for m in members]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["doc_id", "cand", "cluster", "lemma"])

    return _input(docs, plan).mapInArrow(run, "doc_id long, cand int, cluster int, lemma string")


def summarize(docs: DataFrame, plan: Plan, n: int = 3, lam: float = 0.7, least: int = 5, most: int = 100) -> DataFrame:
    """doc_id, sentence_idx, text, relevance, mmr_score, selection_score, relevance_score, diversity_score: each document's chosen sentences."""
    names = ["doc_id", "sentence_idx", "text", "relevance", "mmr_score", "selection_score", "relevance_score", "diversity_score"]
    types = [pa.int64(), pa.int32(), pa.string(), *[pa.float64()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens, plans in _documents(plan, batches):
            rows = []
            for i, t, r in zip(ids, tokens, run_documents(tokens, plan, plans=plans)):
                chosen, relevance, diversity = summary(t, r.phrases, n, lam, least, most)
                rows += [(i, s.sentence_idx, " ".join(x.text for x in t[s.start_token : s.end_token]), s.relevance, s.mmr_score, s.selection_score, relevance, diversity) for s in chosen]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return _input(docs, plan).mapInArrow(run, "doc_id long, sentence_idx int, text string, relevance double, mmr_score double, selection_score double, relevance_score double, diversity_score double")
