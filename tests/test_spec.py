"""Specifications: presets, merging, validation, plans."""

import pytest

from phrasemill.plans import spec as S
from phrasemill.plans.config import VARIANTS, TextRankConfig, aggregate_of, grouping_of, plan_for, variant_of


@pytest.mark.parametrize("name", list(S.PRESETS))
def test_presets_are_the_variants(name):
    plan = S.plan_of(name, focus_terms=("a",), topic_weights={"a": 1.0})
    for k, v in VARIANTS[name].items():
        if not (name == "single_rank" and k == "binary"):
            assert getattr(plan, k) == v, k


@pytest.mark.parametrize(
    "given,code",
    [
        ({"modules": {"rank": "personalized_pagerank"}}, "missing_stage"),
        ({"modules": {"candidates": "phrase_candidates", "graph": "topic_graph"}}, "missing_stage"),
        ({"modules": {"graph": "topic_graph", "clustering": "hac"}}, "invalid_combo"),
        ({"modules": {"graph_transforms": ["remove_intra_cluster_edges"]}}, "missing_stage"),
        ({"runtime": {"max_nodes": 0}}, "limit_exceeded"),
        ({"strict": True, "surprise": 1}, "unknown_field"),
        ({"preset": "nonsense"}, "invalid_value"),
        ({"modules": {"graph": "nonsense"}}, "invalid_value"),
    ],
)
def test_what_is_wrong(given, code):
    out = S.validate_pipeline_spec(given)
    assert not out["valid"] and code in {d["code"] for d in out["diagnostics"]}


def test_unknown_fields_warn():
    out = S.validate_pipeline_spec({"preset": "textrank", "modules": {"rank": {"type": "pagerank", "dampening": 1}}})
    assert out["valid"] and [(d["severity"], d["path"]) for d in out["diagnostics"]] == [("warning", "/modules/rank/dampening")]


def test_merging():
    base = S.preset_modules("topic_rank")
    merged = S.merge(base, {"clustering": {"type": "hac", "threshold": 0.5}, "graph_transforms": []})
    assert merged["clustering"]["threshold"] == 0.5 and "graph_transforms" not in merged
    plan = S.plan_of({"preset": "topic_rank", "modules": {"clustering": {"type": "hac", "threshold": 0.5}, "rank": {"type": "standard_pagerank", "damping": 0.5}}, "runtime": {"max_tokens": 9}})
    assert (plan.cluster_threshold, plan.config.damping, plan.config.max_tokens) == (0.5, 0.5, 9)


@pytest.mark.parametrize("given", ["biased_textrank", "topical_pagerank"])
def test_teleports_need_their_terms(given):
    with pytest.raises(S.SpecError):
        S.plan_of(given)


def test_names():
    assert variant_of("TopicRank") == "topic_rank" and variant_of("??") == "textrank"
    assert grouping_of("??") == "lemma" and grouping_of(None) == "scrubbed_text"
    assert aggregate_of("??") == "sum" and aggregate_of("avg") == "mean"
    with pytest.raises(ValueError):
        aggregate_of("??", strict=True)
    assert S.capabilities()["pipeline_spec_versions"] == [1] and set(S.capabilities()["presets"]) == set(VARIANTS)


@pytest.mark.parametrize("bad", [{"damping": 1.5}, {"window_size": 1}, {"max_iterations": 0}, {"convergence_threshold": 0.0}, {"min_phrase_length": 0}, {"max_phrase_length": 0}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        TextRankConfig().with_(**bad)
    assert plan_for("textrank").config == TextRankConfig().validate()
