"""Extractor classes: one document at a time in the driver's Python, or a corpus as a DataFrame."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from ..errors import ConvergenceFailure, EmptyInput, NoCandidates, PipelineRuntimeError
from ..operators import document as D
from .config import Plan, TextRankConfig, plan_for


@dataclass(frozen=True)
class Phrase:
    text: str
    lemma: str
    score: float
    count: int
    offsets: list[tuple[int, int]]
    rank: int


@dataclass(frozen=True)
class GraphStats:
    num_nodes: int
    num_edges: int
    avg_degree: float = 0.0
    is_transformed: bool = False


@dataclass(frozen=True)
class ConvergenceSummary:
    iterations: int
    final_delta: float
    converged: bool


@dataclass(frozen=True)
class PhraseSplitEvent:
    start: int
    end: int
    text: str
    reason: str


@dataclass(frozen=True)
class DroppedCandidate:
    text: str
    lemma: str
    score: float
    reason: str


@dataclass(frozen=True)
class ClusterMember:
    index: int
    text: str
    lemma: str


@dataclass(frozen=True)
class ClusterDetail:
    members: list[ClusterMember]


@dataclass(frozen=True)
class DebugPayload:
    graph_stats: GraphStats | None = None
    convergence_summary: ConvergenceSummary | None = None
    node_scores: list[tuple[str, float]] = field(default_factory=list)
    phrase_diagnostics: list[PhraseSplitEvent] = field(default_factory=list)
    dropped_candidates: list[DroppedCandidate] = field(default_factory=list)
    cluster_memberships: list[list[int]] = field(default_factory=list)
    cluster_details: list[ClusterDetail] = field(default_factory=list)
    stage_timings: list[tuple[str, float]] = field(default_factory=list)
    residuals: list[float] = field(default_factory=list)

    @classmethod
    def of(cls, x: dict[str, Any] | None, timings: dict[str, float]) -> DebugPayload | None:
        if not x:
            return None
        return cls(
            GraphStats(**x["graph_stats"]),
            ConvergenceSummary(**x["convergence_summary"]),
            [(n["key"], n["score"]) for n in x.get("node_scores", [])],
            [PhraseSplitEvent(**e) for e in x.get("phrase_diagnostics", [])],
            [DroppedCandidate(**e) for e in x.get("dropped_candidates", [])],
            x.get("cluster_memberships", []),
            [ClusterDetail([ClusterMember(**m) for m in c]) for c in x.get("cluster_details", [])],
            list(timings.items()),
            x.get("residuals", []),
        )


@dataclass(frozen=True)
class TextRankResult:
    phrases: list[Phrase]
    converged: bool
    iterations: int
    debug: DebugPayload | None = None

    def as_tuples(self) -> list[tuple[str, float]]:
        return [(p.text, p.score) for p in self.phrases]

    def __len__(self) -> int:
        return len(self.phrases)

    def __getitem__(self, i: int) -> Phrase:
        return self.phrases[i]


@dataclass(frozen=True)
class StageReport:
    """What a stage took, and what it made, where that applies."""

    duration_us: int
    nodes: int | None = None
    edges: int | None = None
    iterations: int | None = None
    converged: bool | None = None
    residual: float | None = None

    @property
    def duration_ms(self) -> float:
        return self.duration_us / 1000


class PipelineObserver:
    """Is told what happens to a document; a subclass says what it wants to know.

    Stages: preprocess, candidates, graph, graph_transform, teleport, rank, phrases.
    """

    def on_stage_start(self, stage: str) -> None: ...

    def on_stage_end(self, stage: str, report: StageReport) -> None: ...

    def on_tokens(self, tokens: list[D.Token]) -> None: ...

    def on_candidates(self, candidates: Any) -> None: ...

    def on_graph(self, graph: D.Graph) -> None: ...

    def on_rank(self, rank: tuple) -> None: ...

    def on_phrases(self, phrases: list[D.Phrase]) -> None: ...


class StageTimingObserver(PipelineObserver):
    def __init__(self) -> None:
        self.reports: list[tuple[str, StageReport]] = []

    def on_stage_end(self, stage: str, report: StageReport) -> None:
        self.reports.append((stage, report))

    @property
    def total_duration_ms(self) -> float:
        return sum(r.duration_ms for _, r in self.reports)


class StageClock:
    """Microseconds since it was made."""

    def __init__(self) -> None:
        self.began = time.perf_counter()

    def elapsed_us(self) -> int:
        return int(1e6 * (time.perf_counter() - self.began))


class _Watching(D.Watch):
    def __init__(self, observers: list[PipelineObserver]):
        self.observers, self.clocks = observers, {}

    def start(self, stage: str) -> None:
        self.clocks[stage] = StageClock()
        for o in self.observers:
            o.on_stage_start(stage)

    def end(self, stage: str, **metrics: Any) -> None:
        report = StageReport(self.clocks[stage].elapsed_us(), **metrics)
        for o in self.observers:
            o.on_stage_end(stage, report)

    def tell(self, what: str, value: Any) -> None:
        for o in self.observers:
            getattr(o, f"on_{what}")(value)


class _Extractor:
    variant = "textrank"

    def __init__(self, config: TextRankConfig | None = None, top_n: int | None = None, language: str | None = None, observers: Iterable[PipelineObserver] = ()):
        changes = {k: v for k, v in (("top_n", top_n), ("language", language)) if v is not None}
        self.config = (config or TextRankConfig()).with_(**changes)
        self.settings: dict[str, Any] = {}
        self.observers = list(observers)

    def plan(self) -> Plan:
        return plan_for(self.variant, self.config, **self.settings)

    def _set(self, **settings: Any) -> Any:
        self.settings |= settings
        return self

    def extract_tokens(self, tokens: list[D.Token], strict: bool = False) -> TextRankResult:
        """strict: without a token, without a candidate and without convergence there is an error instead of a result."""
        timings: dict[str, float] = {}
        r = D.run_documents([tokens], self.plan(), timings, watch=_Watching(self.observers) if self.observers else D.QUIET)[0]
        if r.error:
            raise PipelineRuntimeError(*r.error)
        if strict and not tokens:
            raise EmptyInput("the text has no token")
        if strict and not r.iterations:
            raise NoCandidates("no token or phrase of the text is a candidate")
        if strict and not r.converged:
            raise ConvergenceFailure(r.iterations, r.debug["convergence_summary"]["final_delta"] if r.debug else float("nan"))
        return TextRankResult([Phrase(**p._asdict(), rank=i) for i, p in enumerate(r.phrases, 1)], r.converged, r.iterations, DebugPayload.of(r.debug, timings))

    def extract_keywords(self, text: str) -> TextRankResult:
        return self.extract_tokens(D.tokenizer(self.config.stopwords)(text, self.config.language))

    def transform(self, docs: DataFrame) -> DataFrame:
        """Phrases of docs(doc_id, text, lang?) or docs(doc_id, tokens): operators.document.PHRASES."""
        return D.extract(docs, self.plan())

    def results(self, docs: DataFrame) -> DataFrame:
        """A row for each document, also for those without a phrase or with an error: operators.document.RESULTS."""
        return D.extract_results(docs, self.plan())


class BaseTextRank(_Extractor):
    pass


class PositionRank(_Extractor):
    variant = "position_rank"


class SingleRank(_Extractor):
    variant = "single_rank"


class BiasedTextRank(_Extractor):
    variant = "biased_textrank"

    def __init__(self, focus_terms: Iterable[str] = (), bias_weight: float = 5.0, config=None, top_n=None, language=None, observers=()):
        super().__init__(config, top_n, language, observers)
        self.settings["bias_weight"] = float(bias_weight)
        self.set_focus(focus_terms)

    def set_focus(self, focus_terms: Iterable[str]) -> BiasedTextRank:
        self.settings["focus_terms"] = tuple(t.lower() for t in focus_terms)
        return self

    change_focus = with_focus = set_focus

    def with_bias_weight(self, bias_weight: float) -> BiasedTextRank:
        return self._set(bias_weight=float(bias_weight))

    def extract_keywords(self, text: str, focus_terms: Iterable[str] | None = None) -> TextRankResult:
        """Terms given here stay."""
        if focus_terms is not None:
            self.set_focus(focus_terms)
        return super().extract_keywords(text)


class TopicalPageRank(_Extractor):
    variant = "topical_pagerank"

    def __init__(self, topic_weights: dict[str, float] | None = None, min_weight: float = 0.0, config=None, top_n=None, language=None, observers=()):
        super().__init__(config, top_n, language, observers)
        self.settings["topic_min_weight"] = float(min_weight)
        self.set_topic_weights(topic_weights or {})

    def set_topic_weights(self, topic_weights: dict[str, float]) -> TopicalPageRank:
        self.settings["topic_weights"] = tuple(sorted(topic_weights.items()))
        return self

    with_topic_weights = set_topic_weights

    def with_min_weight(self, min_weight: float) -> TopicalPageRank:
        return self._set(topic_min_weight=float(min_weight))

    def extract_keywords(self, text: str, topic_weights: dict[str, float] | None = None) -> TextRankResult:
        """Weights given here stay."""
        if topic_weights is not None:
            self.set_topic_weights(topic_weights)
        return super().extract_keywords(text)


class TopicRank(_Extractor):
    variant = "topic_rank"

    def __init__(self, similarity_threshold: float = 0.25, edge_weight: float = 1.0, max_phrases: int = 200, linkage: str = "average", config=None, top_n=None, language=None, observers=()):
        super().__init__(config, top_n, language, observers)
        self.settings |= {"cluster_threshold": min(max(similarity_threshold, 0.0), 1.0), "edge_weight": max(0.0, edge_weight), "max_phrases": max_phrases, "linkage": linkage}

    def with_similarity_threshold(self, x: float) -> TopicRank:
        return self._set(cluster_threshold=min(max(x, 0.0), 1.0))

    def with_edge_weight(self, x: float) -> TopicRank:
        return self._set(edge_weight=max(0.0, x))

    def with_max_phrases(self, n: int) -> TopicRank:
        return self._set(max_phrases=n)


class MultipartiteRank(_Extractor):
    variant = "multipartite_rank"

    def __init__(self, similarity_threshold: float = 0.26, alpha: float = 1.1, max_phrases: int = 200, config=None, top_n=None, language=None, observers=()):
        super().__init__(config, top_n, language, observers)
        self.settings |= {"cluster_threshold": min(max(similarity_threshold, 0.0), 1.0), "alpha": max(0.0, alpha), "max_phrases": max_phrases}

    def with_similarity_threshold(self, x: float) -> MultipartiteRank:
        return self._set(cluster_threshold=min(max(x, 0.0), 1.0))

    def with_alpha(self, x: float) -> MultipartiteRank:
        return self._set(alpha=max(0.0, x))

    def with_max_phrases(self, n: int) -> MultipartiteRank:
        return self._set(max_phrases=n)


class SentenceRank(_Extractor):
    variant = "sentence_rank"

    def __init__(self, sort_by_position: bool = False, min_similarity: float = 0.0, config=None, top_n=None, language=None, observers=()):
        super().__init__(config, top_n, language, observers)
        self.settings |= {"sort_by_position": sort_by_position, "min_similarity": min_similarity}

    def extract_sentences(self, text: str) -> TextRankResult:
        return self.extract_keywords(text)


def extract_keywords(text: str, top_n: int = 10, language: str = "en") -> list[Phrase]:
    return BaseTextRank(top_n=top_n, language=language).extract_keywords(text).phrases


def _keyphrases(extractor: _Extractor, tokens: list[D.Token]) -> list[Phrase]:
    return extractor.extract_tokens(tokens).phrases


def extract_keyphrases(tokens: list[D.Token], config: TextRankConfig | None = None) -> list[Phrase]:
    return _keyphrases(BaseTextRank(config), tokens)


def extract_keyphrases_position(tokens: list[D.Token], config: TextRankConfig | None = None) -> list[Phrase]:
    return _keyphrases(PositionRank(config), tokens)


def extract_keyphrases_biased(tokens: list[D.Token], focus_terms: Iterable[str], bias_weight: float = 5.0, config: TextRankConfig | None = None) -> list[Phrase]:
    return _keyphrases(BiasedTextRank(focus_terms, bias_weight, config), tokens)


def extract_keyphrases_singlerank(tokens: list[D.Token], config: TextRankConfig | None = None) -> list[Phrase]:
    return _keyphrases(SingleRank(config), tokens)


def extract_keyphrases_topical(tokens: list[D.Token], topic_weights: dict[str, float], config: TextRankConfig | None = None) -> list[Phrase]:
    return _keyphrases(TopicalPageRank(topic_weights, config=config), tokens)


def extract_keyphrases_topic(tokens: list[D.Token], config: TextRankConfig | None = None) -> list[Phrase]:
    return _keyphrases(TopicRank(config=config), tokens)


def extract_keyphrases_multipartite(tokens: list[D.Token], config: TextRankConfig | None = None) -> list[Phrase]:
    return _keyphrases(MultipartiteRank(config=config), tokens)
