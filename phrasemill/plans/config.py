"""Settings of an extraction, and the plan that a variant or a specification stands for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from ..errors import InvalidConfig

GROUPINGS = {"scrubbed_text": "scrubbed_text", "scrubbed": "scrubbed_text", "lemma": "lemma"}
AGGREGATES = {"sum": "sum", "mean": "mean", "average": "mean", "avg": "mean", "max": "max", "maximum": "max", "rms": "rms", "root_mean_square": "rms"}
DEBUG_LEVELS = ("none", "stats", "top_nodes", "full")


@dataclass(frozen=True)
class TextRankConfig:
    damping: float = 0.85
    max_iterations: int = 100
    convergence_threshold: float = 1e-6
    window_size: int = 3
    top_n: int = 10  # 0: all
    min_phrase_length: int = 1
    max_phrase_length: int = 4
    score_aggregation: str = "sum"
    language: str = "en"
    use_edge_weights: bool = True
    include_pos: tuple[str, ...] = ("NOUN", "ADJ", "PROPN", "VERB")
    stopwords: tuple[str, ...] = ()
    use_pos_in_nodes: bool = True
    phrase_grouping: str = "scrubbed_text"
    determinism: str = "default"
    debug_level: str = "none"
    debug_top_k: int = 50
    max_nodes: int | None = None
    max_edges: int | None = None
    max_tokens: int | None = None

    def validate(self) -> TextRankConfig:
        checks = (
            (0.0 <= self.damping <= 1.0, "damping must be between 0 and 1"),
            (self.max_iterations > 0, "max_iterations must be greater than 0"),
            (self.convergence_threshold > 0, "convergence_threshold must be positive"),
            (self.window_size >= 2, "window_size must be at least 2"),
            (self.min_phrase_length > 0, "min_phrase_length must be greater than 0"),
            (self.max_phrase_length >= self.min_phrase_length, "max_phrase_length must not be less than min_phrase_length"),
            (self.score_aggregation in AGGREGATES, "unknown score_aggregation"),
            (self.debug_level in DEBUG_LEVELS, "unknown debug_level"),
        )
        for ok, message in checks:
            if not ok:
                raise InvalidConfig(message)
        return self

    def with_(self, **changes) -> TextRankConfig:
        """A copy with some fields changed, validated."""
        return replace(self, **changes).validate()

    def __getattr__(self, name: str) -> Callable[[Any], TextRankConfig]:
        """with_damping(0.9) and so on, for each field."""
        if name[:5] == "with_" and name[5:] in type(self).__dataclass_fields__:
            return lambda value: self.with_(**{name[5:]: value})
        raise AttributeError(name)


def grouping_of(name: str | None) -> str:
    """An unknown name means by lemma, no name the default."""
    return "scrubbed_text" if name is None else GROUPINGS.get(name.lower(), "lemma")


def aggregate_of(name: str | None, strict: bool = False) -> str:
    found = AGGREGATES.get((name or "sum").lower())
    if found is None and strict:
        raise ValueError(f"unknown score_aggregation: {name}")
    return found or "sum"


def debug_level_of(name: str | None) -> str:
    low = (name or "none").lower()
    return low if low in DEBUG_LEVELS else "none"


@dataclass(frozen=True)
class Stages:
    """Functions that stand for a plan's own stages, each of one document; what is None is as the plan says.

    An error in one is that document's error (stage_failed), with the stage's name.
    """

    preprocess: Callable[[list], list] | None = None  # tokens to tokens
    candidates: Callable[[list, Plan], Any] | None = None  # tokens to places of tokens, or to phrase or sentence candidates
    cluster: Callable[[list, Plan], list[list[int]]] | None = None  # phrase candidates to clusters of their numbers
    graph: Callable[[list, Any, Plan], Any] | None = None  # tokens and candidates to a Graph
    transforms: tuple[Callable[[Any, list, Plan], Any], ...] = ()  # a Graph to a Graph, in order
    teleport: Callable[[Any, list, Plan], Any] | None = None  # Graph to a weight for each node, normalised
    rank: Callable[[Any, Any, TextRankConfig], tuple] | None = None  # Graph and teleport to (scores, iterations, change, converged)
    phrases: Callable[[list, Any, Any, Plan], list] | None = None  # tokens, Graph and scores to phrases
    format: Callable[[Any], Any] | None = None  # a Result to what is returned

    @property
    def custom(self) -> bool:
        return self != NO_STAGES


NO_STAGES = Stages()


@dataclass(frozen=True)
class Plan:
    """What is done with each document; the kernels in operators.document run it."""

    name: str = "textrank"
    candidates: str = "words"  # words, phrases, sentences
    graph: str = "cooccurrence"  # cooccurrence, topics, candidates, sentences
    window: int | None = None  # None: the configuration's
    cross_sentence: bool = False
    binary: bool | None = None  # None: as use_edge_weights says
    min_similarity: float = 0.0
    remove_intra: bool = False
    alpha: float = 0.0
    transforms: tuple[Any, ...] = ()  # of a candidate graph, in order; see operators.document.candidate_graph
    edge_weight: float = 1.0
    cluster_threshold: float | None = None
    linkage: str = "average"
    max_phrases: int = 200
    teleport: str = "uniform"  # uniform, position, focus, topics
    focus_terms: tuple[str, ...] = ()
    bias_weight: float = 5.0
    topic_weights: tuple[tuple[str, float], ...] = ()
    topic_min_weight: float = 0.0
    sort_by_position: bool = False
    config: TextRankConfig = field(default_factory=TextRankConfig)
    stages: Stages = NO_STAGES

    def with_(self, **changes) -> Plan:
        return replace(self, **changes)

    @property
    def chain(self) -> tuple[Any, ...]:
        """The transforms; remove_intra and alpha stand for one of their own."""
        return self.transforms or ((self.alpha,) if self.remove_intra or self.alpha > 0 else ())


VARIANTS = {
    "textrank": {},
    "position_rank": {"teleport": "position"},
    "biased_textrank": {"teleport": "focus"},
    "single_rank": {"cross_sentence": True, "binary": False},
    "topical_pagerank": {"cross_sentence": True, "teleport": "topics"},
    "topic_rank": {"candidates": "phrases", "graph": "topics", "cluster_threshold": 0.25},
    "multipartite_rank": {"candidates": "phrases", "graph": "candidates", "cluster_threshold": 0.26, "remove_intra": True, "alpha": 1.1},
    "sentence_rank": {"candidates": "sentences", "graph": "sentences"},
}
VARIANT_ALIASES = {
    "text_rank": "textrank", "base": "textrank", "base_textrank": "textrank", "position": "position_rank", "positionrank": "position_rank", "biased": "biased_textrank",
    "biasedtextrank": "biased_textrank", "biased_text_rank": "biased_textrank", "single": "single_rank", "singlerank": "single_rank", "topical": "topical_pagerank", "topicalpagerank": "topical_pagerank",
    "tpr": "topical_pagerank", "singletpr": "topical_pagerank", "single_tpr": "topical_pagerank", "topic": "topic_rank", "topicrank": "topic_rank", "multipartite": "multipartite_rank",
    "multipartiterank": "multipartite_rank", "mpr": "multipartite_rank", "sentence": "sentence_rank", "sentencerank": "sentence_rank",
}


def variant_of(name: str | None) -> str:
    """A variant by any of its names; textrank for one that is unknown."""
    low = (name or "textrank").lower().replace("-", "_")
    return low if low in VARIANTS else VARIANT_ALIASES.get(low, "textrank")


def plan_for(variant: str = "textrank", config: TextRankConfig | None = None, **settings) -> Plan:
    name = variant_of(variant)
    return Plan(name=name, config=config or TextRankConfig(), **{**VARIANTS[name], **settings})
