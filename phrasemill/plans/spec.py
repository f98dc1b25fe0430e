"""The pipeline specification: presets, modules, merging, validation, and the plan that comes of it."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from typing import Any

from .. import __version__
from .config import VARIANT_ALIASES, VARIANTS, Plan, TextRankConfig, aggregate_of, grouping_of

MODULES: dict[str, dict[str, tuple[str, ...]]] = {
    "preprocess": {"default": ()},
    "candidates": {"word_nodes": (), "phrase_candidates": (), "sentence_candidates": ()},
    "graph": {"cooccurrence_window": ("window_size", "cross_sentence", "edge_weighting"), "topic_graph": (), "candidate_graph": (), "sentence_graph": ("min_similarity",)},
    "graph_transforms": {"remove_intra_cluster_edges": (), "alpha_boost": ()},
    "teleport": {"uniform": (), "position": ("shape",), "focus_terms": (), "topic_weights": ()},
    "clustering": {"hac": ("threshold",)},
    "rank": {"standard_pagerank": ("damping", "max_iterations", "convergence_threshold"), "personalized_pagerank": ("damping", "max_iterations", "convergence_threshold")},
    "phrases": {"chunk_phrases": ("min_phrase_length", "max_phrase_length", "score_aggregation", "phrase_grouping"), "sentence_phrases": ()},
    "format": {"standard_json": (), "standard_json_with_debug": ("debug_key",), "sentence_json": ("sort_by_position",)},
}
TYPE_ALIASES = {"pagerank": "standard_pagerank"}
RUNTIME = ("max_tokens", "max_nodes", "max_edges", "max_threads", "single_thread", "max_debug_top_k", "deterministic")
EXPOSE = ("node_scores", "graph_stats", "pagerank", "clusters", "stage_timings", "phrase_diagnostics")
TOP = ("v", "preset", "modules", "runtime", "expose", "strict")

PRESETS: dict[str, dict[str, Any]] = {
    "textrank": {},
    "position_rank": {"teleport": {"type": "position"}},
    "biased_textrank": {"teleport": {"type": "focus_terms"}},
    "single_rank": {"graph": {"type": "cooccurrence_window", "cross_sentence": True}},
    "topical_pagerank": {"graph": {"type": "cooccurrence_window", "cross_sentence": True}, "teleport": {"type": "topic_weights"}},
    "topic_rank": {"candidates": {"type": "phrase_candidates"}, "graph": {"type": "topic_graph"}, "clustering": {"type": "hac", "threshold": 0.25}},
    "multipartite_rank": {
        "candidates": {"type": "phrase_candidates"},
        "graph": {"type": "candidate_graph"},
        "clustering": {"type": "hac"},
        "graph_transforms": [{"type": "remove_intra_cluster_edges"}, {"type": "alpha_boost"}],
    },
    "sentence_rank": {
        "candidates": {"type": "sentence_candidates"},
        "graph": {"type": "sentence_graph"},
        "phrases": {"type": "sentence_phrases"},
        "format": {"type": "sentence_json"},
    },
}
ERROR_CODES = (
    "missing_stage invalid_combo module_unavailable limit_exceeded unknown_field invalid_value incompatible_modules validation_failed stage_failed convergence_failed"
).split()


class SpecError(ValueError):
    """What is wrong with a specification: code, path (a JSON pointer), message, hint."""

    def __init__(self, code: str, path: str, message: str, hint: str | None = None):
        super().__init__(f"[{code}] {path}: {message}")
        self.code, self.path, self.message, self.hint = code, path, message, hint

    def as_dict(self) -> dict[str, str]:
        out = {"code": self.code, "path": self.path, "message": self.message}
        return out | {"hint": self.hint} if self.hint else out


@dataclass(frozen=True)
class Diagnostic:
    severity: str  # error or warning
    code: str
    path: str
    message: str
    hint: str | None = None

    def as_dict(self) -> dict[str, str]:
        return {k: v for k, v in asdict(self).items() if v is not None}


@dataclass
class Spec:
    modules: dict[str, Any] = field(default_factory=dict)
    preset: str | None = None
    runtime: dict[str, Any] = field(default_factory=dict)
    expose: dict[str, Any] = field(default_factory=dict)
    strict: bool = False
    v: int = 1
    unknown: dict[str, list[str]] = field(default_factory=dict)  # path of the object: names


def preset_modules(name: str) -> dict[str, Any]:
    low = name.lower()
    key = low if low in PRESETS else VARIANT_ALIASES.get(low)
    if key is None:
        raise SpecError("invalid_value", "/preset", f"unknown preset name: '{name}'", f"valid presets: {', '.join(PRESETS)}")
    return copy.deepcopy(PRESETS[key])


def _module(slot: str, given: Any, path: str) -> dict[str, Any]:
    if isinstance(given, str):
        given = {"type": given}
    if not isinstance(given, dict) or not isinstance(given.get("type"), str):
        raise SpecError("invalid_value", path, "a module is an object with a type")
    kind = TYPE_ALIASES.get(given["type"], given["type"])
    if kind not in MODULES[slot]:
        raise SpecError("invalid_value", path, f"unknown type '{given['type']}'", f"one of {', '.join(MODULES[slot])}")
    return {**given, "type": kind}


def parse(given: str | dict | Spec) -> Spec:
    """A specification from a preset's name, JSON or a dictionary."""
    if isinstance(given, Spec):
        return given
    if isinstance(given, str):
        if not given.lstrip().startswith(("{", '"')):
            return Spec(preset=given)
        given = json.loads(given)
        if isinstance(given, str):
            return Spec(preset=given)
    if not isinstance(given, dict):
        raise SpecError("invalid_value", "", "a specification is a preset's name or an object")
    unknown: dict[str, list[str]] = {}

    def known(at: str, own: dict, names: Iterable[str]) -> None:
        if rest := [k for k in own if k not in names]:
            unknown[at] = rest

    known("", given, TOP)
    modules, runtime, expose = (given.get(k) or {} for k in ("modules", "runtime", "expose"))
    for name, x in (("modules", modules), ("runtime", runtime), ("expose", expose)):
        if not isinstance(x, dict):
            raise SpecError("invalid_value", f"/{name}", f"{name} is an object")
    known("/modules", modules, MODULES)
    known("/runtime", runtime, RUNTIME)
    known("/expose", expose, EXPOSE)
    own: dict[str, Any] = {}
    for slot, x in modules.items():
        if slot not in MODULES or x is None:
            continue
        own[slot] = [_module(slot, y, f"/modules/{slot}/{i}") for i, y in enumerate(x)] if slot == "graph_transforms" else _module(slot, x, f"/modules/{slot}")
        for y in own[slot] if isinstance(own[slot], list) else [own[slot]]:
            known(f"/modules/{slot}", y, ("type", *MODULES[slot][y["type"]]))
    return Spec(own, given.get("preset"), dict(runtime), dict(expose), bool(given.get("strict", False)), given.get("v", 1), unknown)


def merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """over's modules on base's: parameters of one type are merged, another type or a list of transforms replaces."""
    out = copy.deepcopy(base)
    for slot, x in over.items():
        if isinstance(x, list):
            if x:
                out[slot] = x
        elif slot in out and out[slot]["type"] == x["type"]:
            out[slot] = {**out[slot], **{k: v for k, v in x.items() if v is not None}}
        else:
            out[slot] = x
    return out


def resolve(given: str | dict | Spec) -> Spec:
    spec = parse(given)
    base = preset_modules(spec.preset) if spec.preset else {}
    return Spec(merge(base, spec.modules), spec.preset, spec.runtime, spec.expose, spec.strict, spec.v, spec.unknown)


Rule = Callable[[Spec], list[Diagnostic]]


def _kind(spec: Spec, slot: str) -> str | None:
    return (spec.modules.get(slot) or {}).get("type")


def rank_teleport(spec: Spec) -> list[Diagnostic]:
    if _kind(spec, "rank") == "personalized_pagerank" and not spec.modules.get("teleport"):
        return [Diagnostic("error", "missing_stage", "/modules/teleport", "personalized_pagerank needs a teleport module", "add position, focus_terms, topic_weights or uniform")]
    return []


def topic_graph_deps(spec: Spec) -> list[Diagnostic]:
    kind, out = _kind(spec, "graph"), []
    if kind in ("topic_graph", "candidate_graph"):
        if not spec.modules.get("clustering"):
            out.append(Diagnostic("error", "missing_stage", "/modules/clustering", f"{kind} needs a clustering module", "add hac"))
        if _kind(spec, "candidates") != "phrase_candidates":
            out.append(Diagnostic("error", "invalid_combo", "/modules/candidates", f"{kind} needs phrase_candidates", "set candidates to phrase_candidates"))
    return out


def graph_transform_deps(spec: Spec) -> list[Diagnostic]:
    if any(t["type"] == "remove_intra_cluster_edges" for t in spec.modules.get("graph_transforms", [])) and not spec.modules.get("clustering"):
        return [Diagnostic("error", "missing_stage", "/modules/clustering", "remove_intra_cluster_edges needs a clustering module", "add hac")]
    return []


def runtime_limits(spec: Spec) -> list[Diagnostic]:
    names = ("max_tokens", "max_nodes", "max_edges", "max_threads")
    return [Diagnostic("error", "limit_exceeded", f"/runtime/{n}", f"{n} must be more than 0", f"leave {n} out for no limit") for n in names if spec.runtime.get(n) == 0]


def unknown_fields(spec: Spec) -> list[Diagnostic]:
    severity = "error" if spec.strict else "warning"
    return [Diagnostic(severity, "unknown_field", f"{at}/{n}", f'unknown field "{n}"', "check its spelling or leave it out") for at, names in spec.unknown.items() for n in names]


RULES: tuple[Rule, ...] = (rank_teleport, topic_graph_deps, graph_transform_deps, runtime_limits, unknown_fields)


def diagnose(spec: Spec, rules: Iterable[Rule] = RULES) -> list[Diagnostic]:
    return [d for rule in rules for d in rule(spec)]


def validate_pipeline_spec(given: str | dict) -> dict[str, Any]:
    """{"valid": ..., "diagnostics": [...]}; warnings don't make a specification invalid."""
    try:
        found = diagnose(resolve(given))
    except SpecError as e:
        found = [Diagnostic("error", e.code, e.path, e.message, e.hint)]
    return {"valid": all(d.severity != "error" for d in found), "diagnostics": [d.as_dict() for d in found]}


def debug_level(expose: dict[str, Any]) -> str:
    pagerank = expose.get("pagerank")
    if expose.get("phrase_diagnostics") or expose.get("clusters") or isinstance(pagerank, dict) and pagerank.get("residuals"):
        return "full"
    if expose.get("node_scores"):
        return "top_nodes"
    return "stats" if any(expose.get(k) for k in ("graph_stats", "pagerank", "stage_timings")) else "none"


def plan_of(given: str | dict | Spec, config: TextRankConfig | None = None, focus_terms=(), bias_weight=5.0, topic_weights=None, topic_min_weight=0.0) -> Plan:
    """The plan of a valid specification; SpecError for the first thing that is wrong with it."""
    spec = resolve(given)
    for d in diagnose(spec):
        if d.severity == "error":
            raise SpecError(d.code, d.path, d.message, d.hint)
    m, cfg = spec.modules, config or TextRankConfig()
    rank, phrases, graph, run = (m.get(k) or {} for k in ("rank", "phrases", "graph", "clustering"))
    changes = {k: rank[k] for k in ("damping", "max_iterations", "convergence_threshold") if rank.get(k) is not None}
    changes |= {k: phrases[k] for k in ("min_phrase_length", "max_phrase_length") if phrases.get(k) is not None}
    if phrases.get("score_aggregation"):
        changes["score_aggregation"] = aggregate_of(phrases["score_aggregation"])
    if phrases.get("phrase_grouping"):
        changes["phrase_grouping"] = grouping_of(phrases["phrase_grouping"])
    if graph.get("window_size") is not None:
        changes["window_size"] = graph["window_size"]
    changes |= {k: spec.runtime[k] for k in ("max_tokens", "max_nodes", "max_edges") if spec.runtime.get(k) is not None}
    if spec.runtime.get("deterministic"):
        changes["determinism"] = "deterministic"
    if (level := debug_level(spec.expose)) != "none":
        wanted = (spec.expose.get("node_scores") or {}) if isinstance(spec.expose.get("node_scores"), dict) else {}
        top = wanted.get("top_k") or cfg.debug_top_k
        changes |= {"debug_level": level, "debug_top_k": min(top, spec.runtime.get("max_debug_top_k") or top)}
    cfg = cfg.with_(**changes)
    kind, teleport = graph.get("type", "cooccurrence_window"), _kind(spec, "teleport") or "uniform"
    if teleport == "focus_terms" and not focus_terms:
        raise SpecError("invalid_value", "/modules/teleport", "focus_terms needs focus terms")
    if teleport == "topic_weights" and not topic_weights:
        raise SpecError("invalid_value", "/modules/teleport", "topic_weights needs topic weights")
    transforms = [t["type"] for t in m.get("graph_transforms", [])]
    default = 0.26 if kind == "candidate_graph" else 0.25
    clusters = (run.get("threshold") if run.get("threshold") is not None else default) if run or kind in ("topic_graph", "candidate_graph") else None
    return Plan(
        name=spec.preset or "custom",
        candidates={"phrase_candidates": "phrases", "sentence_candidates": "sentences"}.get(_kind(spec, "candidates") or "", "words"),
        graph={"topic_graph": "topics", "candidate_graph": "candidates", "sentence_graph": "sentences"}.get(kind, "cooccurrence"),
        cross_sentence=bool(graph.get("cross_sentence")),
        binary={"binary": True, "count": False}.get(graph.get("edge_weighting") or ""),
        min_similarity=graph.get("min_similarity") or 0.0,
        remove_intra=bool(transforms),
        alpha=1.1 if "alpha_boost" in transforms else 0.0,
        transforms=tuple(1.1 if t == "alpha_boost" else 0.0 for t in transforms),
        cluster_threshold=clusters,
        teleport={"position": "position", "focus_terms": "focus", "topic_weights": "topics"}.get(teleport, "uniform"),
        focus_terms=tuple(focus_terms),
        bias_weight=bias_weight,
        topic_weights=tuple(sorted((topic_weights or {}).items())),
        topic_min_weight=topic_min_weight,
        sort_by_position=bool((m.get("format") or {}).get("sort_by_position")),
        config=cfg,
    )


def debug_key(given: str | dict | Spec) -> str:
    return (resolve(given).modules.get("format") or {}).get("debug_key") or "debug"


def capabilities() -> dict[str, Any]:
    return {"version": __version__, "pipeline_spec_versions": [1], "presets": list(PRESETS), "modules": {slot: list(types) for slot, types in MODULES.items()}}


assert set(PRESETS) == set(VARIANTS)
