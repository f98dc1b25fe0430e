"""Pre-tokenised documents as JSON: one, an array, or lines; and the same as columns.

A document: {"tokens": [...], "config": {...}?, "variant": ...?, "pipeline": ...?}.  What is wrong with one
document is said in its own result and stops no other.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PipelineRuntimeError
from ..functions import text as T
from ..operators import document as D
from ..plans import spec as S
from ..plans.config import Plan, TextRankConfig, aggregate_of, debug_level_of, grouping_of, plan_for

NEEDED = ("text", "lemma", "pos", "start", "end", "sentence_idx", "token_idx")


def config_of(given: dict[str, Any] | None, compat: bool = False) -> TextRankConfig:
    """compat: a config object without phrase_grouping groups by lemma."""
    given = given or {}
    plain = {k: given[k] for k in ("damping", "max_iterations", "convergence_threshold", "window_size", "top_n", "min_phrase_length", "max_phrase_length", "language", "use_edge_weights", "use_pos_in_nodes", "debug_top_k") if given.get(k) is not None}
    if given.get("include_pos"):
        plain["include_pos"] = tuple(T.py_tag_name(x) for x in given["include_pos"])
    grouping = "lemma" if compat and given and not given.get("phrase_grouping") else grouping_of(given.get("phrase_grouping"))
    return TextRankConfig(
        **plain,
        stopwords=tuple(given.get("stopwords") or ()),
        score_aggregation=aggregate_of(given.get("score_aggregation")),
        phrase_grouping=grouping,
        determinism=given.get("determinism") or "default",
        debug_level=debug_level_of(given.get("debug_level")),
    ).validate()


def plan_of(doc: dict[str, Any], compat: bool = False) -> Plan:
    given = doc.get("config") or {}
    cfg = config_of(given, compat)
    focus, weights = tuple(given.get("focus_terms") or ()), given.get("topic_weights") or {}
    if doc.get("pipeline") is not None:
        return S.plan_of(doc["pipeline"], cfg, focus, given.get("bias_weight", 5.0), weights, given.get("topic_min_weight", 0.0))
    plan = plan_for(doc.get("variant"), cfg, focus_terms=tuple(x.lower() for x in focus), bias_weight=given.get("bias_weight", 5.0), topic_weights=tuple(sorted(weights.items())), topic_min_weight=given.get("topic_min_weight", 0.0))
    if plan.name == "topic_rank":
        plan = plan.with_(cluster_threshold=min(max(given.get("topic_similarity_threshold", 0.25), 0.0), 1.0), edge_weight=max(0.0, given.get("topic_edge_weight", 1.0)))
    if plan.name == "multipartite_rank":
        plan = plan.with_(cluster_threshold=min(max(given.get("multipartite_similarity_threshold", 0.26), 0.0), 1.0), alpha=max(0.0, given.get("multipartite_alpha", 1.1)))
    return plan


def tokens_of(doc: dict[str, Any], cfg: TextRankConfig) -> list[D.Token]:
    rows = doc.get("tokens") or []
    for r in rows:
        if missing := [k for k in NEEDED if k not in r]:
            raise ValueError(f"missing field `{missing[0]}`")
    tokens = D.from_structs([{"is_stopword": False, **r} for r in rows])
    if not cfg.stopwords:
        return tokens
    from ..functions.stopwords import StopWords

    stop = StopWords.with_additional(cfg.language, cfg.stopwords)
    return [t._replace(is_stopword=t.is_stopword or t.text in stop) for t in tokens]


#: what an input can be wrong by; RecursionError for brackets that are nested too deeply
WRONG = (ValueError, TypeError, KeyError, AttributeError, RecursionError)


def _error(e: Exception) -> dict[str, Any]:
    if isinstance(e, S.SpecError):
        return {"error": {**e.as_dict(), "stage": "validate"}, "error_message": str(e)}
    return {"error": str(e)}


def process(doc: Any, compat: bool = False) -> dict[str, Any]:
    """The result of one parsed document; raises what is wrong with it."""
    if not isinstance(doc, dict):
        raise ValueError("a document is an object")
    if doc.get("capabilities"):
        return S.capabilities()
    if doc.get("validate_only"):
        if doc.get("pipeline") is None:
            raise ValueError("validate_only needs a pipeline")
        return S.validate_pipeline_spec(doc["pipeline"])
    plan = plan_of(doc, compat)
    timings: dict[str, float] = {}
    result = D.run_documents([tokens_of(doc, plan.config)], plan, timings)[0]
    if result.error:
        code, stage, message = result.error
        return {"error": PipelineRuntimeError(code, stage, message).as_dict(), "error_message": message}
    out: dict[str, Any] = {
        "phrases": [{"text": p.text, "lemma": p.lemma, "score": p.score, "count": p.count, "rank": i} for i, p in enumerate(result.phrases, 1)],
        "converged": result.converged,
        "iterations": result.iterations,
    }
    debug, key = result.debug, "debug"
    if doc.get("pipeline") is not None:
        key = S.debug_key(doc["pipeline"])
        if S.resolve(doc["pipeline"]).expose.get("stage_timings"):
            debug = {**(debug or {}), "stage_timings": [[k, v] for k, v in timings.items()]}
    return out | {key: debug} if debug else out


def extract_from_json(json_input: str, compat: bool = False) -> str:
    """ValueError for input that isn't a document."""
    return json.dumps(process(json.loads(json_input), compat), ensure_ascii=False)


def _threads(num_threads: int | None) -> None:
    if num_threads is not None and num_threads < 1:
        raise ValueError("num_threads must be at least 1")


def _safe(doc: Any, compat: bool = False) -> dict[str, Any]:
    try:
        return process(doc, compat)
    except WRONG as e:
        return _error(e)


def extract_batch_from_json(json_input: str, num_threads: int | None = None, compat: bool = False) -> str:
    """A JSON array of documents to one of results, in order."""
    _threads(num_threads)
    docs = json.loads(json_input)
    if not isinstance(docs, list):
        raise ValueError("a batch is an array")
    return json.dumps([_safe(d, compat) for d in docs], ensure_ascii=False)


def _line(line: str, compat: bool = False) -> str:
    try:
        return json.dumps(_safe(json.loads(line), compat), ensure_ascii=False)
    except WRONG as e:
        return json.dumps({"error": str(e)}, ensure_ascii=False)


def extract_jsonl_from_json(jsonl: str, num_threads: int | None = None, compat: bool = False) -> str:
    """A result line for each line that isn't blank."""
    _threads(num_threads)
    return "\n".join(_line(x.strip(), compat) for x in jsonl.splitlines() if x.strip())


class BatchIter:
    """Results one by one, each made when it is asked for."""

    def __init__(self, docs: list[Any], compat: bool = False):
        self._docs, self._at, self._compat = docs, 0, compat

    def __iter__(self) -> BatchIter:
        return self

    def __next__(self) -> str:
        if self._at >= len(self._docs):
            raise StopIteration
        self._at += 1
        return json.dumps(_safe(self._docs[self._at - 1], self._compat), ensure_ascii=False)

    def __len__(self) -> int:
        return len(self._docs)

    @property
    def remaining(self) -> int:
        return len(self._docs) - self._at


def extract_batch_iter(json_input: str, num_threads: int | None = None, compat: bool = False) -> BatchIter:
    _threads(num_threads)
    docs = json.loads(json_input)
    if not isinstance(docs, list):
        raise ValueError("a batch is an array")
    return BatchIter(docs, compat)


def process_lines(lines: DataFrame, compat: bool = False) -> DataFrame:
    """lines(value) with ``result``: a result for each line that isn't blank.  A narrow map, batch or streaming."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_line(v.strip(), compat) for v in values], pa.string())], names=["value", "result"])

    return lines.select(F.col("value").cast("string").alias("value")).where(F.trim("value") != "").mapInArrow(run, "value string, result string")


def read_jsonl(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    return process_lines(spark.read.text(path), compat)


def token_documents(lines: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """doc_id, tokens, error: lines(doc_id, value) parsed by from_json; a line that isn't a document has an error."""
    parsed = lines.withColumn("doc", F.from_json("value", f"tokens {D.TOKEN_FIELDS}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("doc").isNull() | F.col("doc._corrupt_record").isNotNull()
    return parsed.select(F.col(id_column).cast("long").alias("doc_id"), F.col("doc.tokens").alias("tokens"), F.when(bad, F.lit("invalid JSON")).alias("error"))


def to_json(results: DataFrame) -> DataFrame:
    """doc_id, json: operators.document.extract_results() as the JSON interface writes it (no offsets)."""
    phrases = F.transform("phrases", lambda p: F.struct(p["text"].alias("text"), p["lemma"].alias("lemma"), p["score"].alias("score"), p["count"].alias("count"), p["rank"].alias("rank")))
    ok = F.to_json(F.struct(phrases.alias("phrases"), "converged", "iterations"))
    return results.select("doc_id", F.when(F.col("error").isNull(), ok).otherwise(F.to_json(F.struct("error"))).alias("json"))
