"""Pipelines put together step by step, with hooks of DataFrame to DataFrame before and behind the kernel."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame

from ..operators import document as D
from .config import Plan, TextRankConfig, plan_for
from .spec import plan_of

Hook = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Pipeline:
    plan: Plan
    before: tuple[Hook, ...] = ()
    after: tuple[Hook, ...] = ()

    def run(self, docs: DataFrame) -> DataFrame:
        """operators.document.PHRASES of docs, whose hooks have seen both."""
        return reduce(lambda df, f: f(df), self.after, D.extract(reduce(lambda df, f: f(df), self.before, docs), self.plan))

    def run_documents(self, docs: list[list[D.Token]]) -> list[Any]:
        """Results, through the plan's format stage if it has one."""
        found = D.run_documents(docs, self.plan)
        return list(map(self.plan.stages.format, found)) if self.plan.stages.format else found

    def formatted(self, docs: DataFrame) -> DataFrame:
        """doc_id, value: what the format stage makes of each document's result, as JSON."""
        return D.formatted(reduce(lambda df, f: f(df), self.before, docs), self.plan)


@dataclass
class PipelineBuilder:
    """PipelineBuilder("topic_rank").clustering(0.3).config(top_n=5).build(); the base variant where nothing is said."""

    variant: str = "textrank"
    _plan: Plan | None = None
    _before: list[Hook] = field(default_factory=list)
    _after: list[Hook] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._plan = self._plan or plan_for(self.variant)

    @classmethod
    def from_spec(cls, spec: str | dict, config: TextRankConfig | None = None, **terms) -> PipelineBuilder:
        return cls(_plan=plan_of(spec, config, **terms))

    def _with(self, **changes) -> PipelineBuilder:
        self._plan = self._plan.with_(**changes)
        return self

    def preprocess(self, hook: Hook) -> PipelineBuilder:
        self._before.append(hook)
        return self

    def candidates(self, kind: str, max_phrases: int = 200) -> PipelineBuilder:
        return self._with(candidates=kind, max_phrases=max_phrases)

    def graph(self, kind: str, window: int | None = None, cross_sentence: bool = False, binary: bool | None = None, min_similarity: float = 0.0, edge_weight: float = 1.0) -> PipelineBuilder:
        return self._with(graph=kind, window=window, cross_sentence=cross_sentence, binary=binary, min_similarity=min_similarity, edge_weight=edge_weight)

    def transform(self, remove_intra: bool = True, alpha: float = 0.0) -> PipelineBuilder:
        return self._with(remove_intra=remove_intra, alpha=alpha)

    def clustering(self, threshold: float, linkage: str = "average") -> PipelineBuilder:
        return self._with(cluster_threshold=threshold, linkage=linkage)

    def teleport(self, kind: str, focus_terms: Iterable[str] = (), bias_weight: float = 5.0, topic_weights: dict[str, float] | None = None, min_weight: float = 0.0) -> PipelineBuilder:
        return self._with(teleport=kind, focus_terms=tuple(focus_terms), bias_weight=bias_weight, topic_weights=tuple(sorted((topic_weights or {}).items())), topic_min_weight=min_weight)

    def stage(self, **functions) -> PipelineBuilder:
        """Functions in place of stages: stage(candidates=..., rank=...); see plans.config.Stages."""
        return self._with(stages=replace(self._plan.stages, **functions))

    def transforms(self, *chain) -> PipelineBuilder:
        """Transforms of a candidate graph in order: numbers and functions, as operators.document.candidate_graph takes them."""
        return self._with(transforms=tuple(chain))

    def config(self, **changes) -> PipelineBuilder:
        return self._with(config=self._plan.config.with_(**changes))

    def postprocess(self, hook: Hook) -> PipelineBuilder:
        self._after.append(hook)
        return self

    def build(self) -> Pipeline:
        self._plan.config.validate()
        return Pipeline(self._plan, tuple(self._before), tuple(self._after))
