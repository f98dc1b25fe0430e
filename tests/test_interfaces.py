"""Classes, JSON, streams, topic weights and the entry module."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from phrasemill.operators import document as D
from phrasemill.operators.spread import MOST_SPREAD, spread
from phrasemill.plans import api
from phrasemill.plans.builder import PipelineBuilder
from phrasemill.plans.config import TextRankConfig, plan_for
from phrasemill.sources import json_docs as J
from phrasemill.sources.topic_weights import weights_from_topics
from phrasemill.streaming import streams
from tests.fixtures import RICH, TR3

REPO = Path(__file__).resolve().parents[1]
TEXT = (
    "Machine learning is a subset of artificial intelligence. Machine learning algorithms build models from training data. "
    "Deep learning uses neural networks with many layers.\n\nNeural networks are inspired by biological neural networks. Natural language processing uses machine learning models."
)


def as_json(toks, **more):
    return {"tokens": [{**t._asdict(), "token_idx": i} for i, t in enumerate(toks)], **more}


@pytest.mark.parametrize("cls", [api.BaseTextRank, api.PositionRank, api.SingleRank, api.BiasedTextRank, api.TopicalPageRank, api.TopicRank, api.MultipartiteRank, api.SentenceRank])
def test_classes(cls):
    r = cls(top_n=5).extract_keywords(TEXT)
    assert r.converged and 0 < len(r) <= 5 and [p.rank for p in r.phrases] == list(range(1, len(r) + 1))
    assert r.as_tuples()[0] == (r[0].text, r[0].score)
    assert [p.score for p in r.phrases] == sorted((p.score for p in r.phrases), reverse=True)
    assert cls(top_n=5).extract_keywords(TEXT) == r


def test_settings_that_stay():
    b = api.BiasedTextRank(["neural"], 10.0)
    first = b.extract_keywords(TEXT)
    assert b.extract_keywords(TEXT, focus_terms=["language"]) != first and b.settings["focus_terms"] == ("language",)
    t = api.TopicalPageRank({"machine": 1.0})
    t.extract_keywords(TEXT, topic_weights={"neural": 1.0})
    assert t.settings["topic_weights"] == (("neural", 1.0),)
    assert any("machine" in p.text.lower() for p in api.extract_keywords(TEXT, 5))


def test_debug_and_limits():
    full = api.BaseTextRank(TextRankConfig(debug_level="full", debug_top_k=3)).extract_tokens(TR3).debug
    assert full.graph_stats.num_nodes > 0 and len(full.node_scores) == 3 and full.convergence_summary.converged and full.stage_timings
    with pytest.raises(ValueError):
        api.BaseTextRank(TextRankConfig(max_tokens=3)).extract_tokens(TR3)
    for limit in ({"max_nodes": 2}, {"max_edges": 2}):
        assert D.run_documents([TR3], plan_for("textrank", TextRankConfig(**limit)))[0].error


def test_json_documents():
    one = json.loads(J.extract_from_json(json.dumps(as_json(TR3, config={"top_n": 2}))))
    assert [p["text"] for p in one["phrases"]] == ["Machine learning models", "Machine learning"] and "offsets" not in one["phrases"][0]
    spec = json.loads(J.extract_from_json(json.dumps(as_json(RICH, pipeline="topic_rank"))))
    assert spec["phrases"][0]["lemma"] == "neural network"
    batch = json.loads(J.extract_batch_from_json(json.dumps([as_json(TR3), {"tokens": [{}]}, as_json(TR3, pipeline="nonsense"), {"capabilities": True}]), 2))
    assert "phrases" in batch[0] and "error" in batch[1] and batch[2]["error"]["code"] == "invalid_value" and "presets" in batch[3]
    lines = J.extract_jsonl_from_json("\n".join([json.dumps(as_json(TR3)), "", "  ", "{broken"])).splitlines()
    assert len(lines) == 2 and "error" in json.loads(lines[1])
    it = J.extract_batch_iter(json.dumps([as_json(TR3)] * 3))
    assert len(it) == 3 and it.remaining == 3 and json.loads(next(it)) == batch[0] and it.remaining == 2 and len(list(it)) == 2
    assert json.loads(J.extract_from_json(json.dumps({"tokens": [], "validate_only": True, "pipeline": "textrank"})))["valid"]
    limited = json.loads(J.extract_from_json(json.dumps(as_json(TR3, pipeline={"preset": "textrank", "runtime": {"max_tokens": 2}}))))
    assert limited["error"]["code"] == "limit_exceeded"
    shown = json.loads(J.extract_from_json(json.dumps(as_json(TR3, pipeline={"expose": {"node_scores": {"top_k": 2}, "stage_timings": True}, "modules": {"format": {"type": "standard_json_with_debug", "debug_key": "d"}}}))))
    assert len(shown["d"]["node_scores"]) == 2 and shown["d"]["stage_timings"]
    for f in (J.extract_batch_from_json, J.extract_jsonl_from_json, J.extract_batch_iter):
        with pytest.raises(ValueError):
            f("[]", 0)
    with pytest.raises(ValueError):
        J.extract_from_json("{")


def test_tables_give_what_the_classes_give(spark):
    docs = spark.createDataFrame([(1, TEXT, "en"), (2, "", "en"), (3, None, None)], "doc_id long, text string, lang string")
    own = api.PositionRank()
    found = own.transform(docs).orderBy("doc_id", "rank").collect()
    assert [(r.text, r.score) for r in found] == own.extract_keywords(TEXT).as_tuples()
    results = {r.doc_id: r for r in own.results(docs).collect()}
    assert set(results) == {1, 2, 3} and results[2].phrases == [] and results[3].converged
    tokens = spark.createDataFrame([(7, [{**t._asdict(), "token_idx": i} for i, t in enumerate(TR3)])], f"doc_id long, tokens {D.TOKEN_FIELDS}")
    assert [r.text for r in D.extract(tokens, plan_for("textrank")).orderBy("rank").collect()][:2] == ["Machine learning models", "Machine learning"]


def test_builder(spark):
    docs = spark.createDataFrame([(1, TEXT, "en"), (2, "skip me please", "en")], "doc_id long, text string, lang string")
    built = PipelineBuilder("topic_rank").clustering(0.25).config(top_n=3).preprocess(lambda df: df.where("doc_id = 1")).postprocess(lambda df: df.select("doc_id", "text", "score")).build()
    expected = api.TopicRank(top_n=3).extract_keywords(TEXT).as_tuples()
    assert [(r.text, r.score) for r in built.run(docs).orderBy(F.desc("score")).collect()] == expected
    own = PipelineBuilder().graph("cooccurrence", cross_sentence=True, binary=False).build()
    assert own.run_documents([TR3]) == D.run_documents([TR3], plan_for("single_rank"))
    assert PipelineBuilder.from_spec("multipartite_rank").build().plan.alpha == 1.1
    assert PipelineBuilder().teleport("focus", ["neural"], 10.0).build().run_documents([TR3]) == D.run_documents([TR3], plan_for("biased_textrank", focus_terms=("neural",), bias_weight=10.0))
    with pytest.raises(ValueError):
        PipelineBuilder().config(damping=2.0)


def test_small_tables_are_dealt_out_and_large_ones_are_not(spark, monkeypatch):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    assert "Exchange" in spread(docs)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr("phrasemill.operators.spread.MOST_SPREAD", 1)
    assert MOST_SPREAD > 1 and "Exchange" not in spread(docs)._jdf.queryExecution().executedPlan().toString()


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, TEXT, "en"), (2, TEXT[:120], "en")], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "in"))
    plan = plan_for("textrank")
    q = streams.start(streams.keyphrases(streams.read_documents(spark, str(tmp_path / "in")), plan), "memory", str(tmp_path / "c1"), name="phrases_stream")
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.doc_id, r.rank, r.text, r.score) for r in df.collect())
    assert key(spark.table("phrases_stream")) == key(D.extract(docs, plan))
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.jsonl").write_text(json.dumps(as_json(TR3)) + "\n\n{broken\n")
    q = streams.start(streams.json_results(streams.read_lines(spark, str(tmp_path / "lines"))), "memory", str(tmp_path / "c2"), name="json_stream")
    q.processAllAvailable()
    q.stop()
    out = [json.loads(r.result) for r in spark.table("json_stream").collect()]
    assert sorted("error" in x for x in out) == [False, True]


def test_topic_weights(spark):
    topics = spark.createDataFrame([(1, 0, 0.6), (1, 1, 0.4)], "doc_id long, topic int, p double")
    terms = spark.createDataFrame([(0, "data", 0.2), (1, "data", 0.5)], "topic int, word string, p double")
    weight = lambda how: weights_from_topics(topics, terms, how).first().weight
    assert weight("max") == pytest.approx(0.2) and weight("mean") == pytest.approx(0.16)
    with pytest.raises(ValueError):
        weight("sum")


def test_the_rest_stands_without_the_pipeline_operators(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {str(REPO)!r})\n"
        "import importlib.util as u; real = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n.startswith(('phrasemill.llm', 'corpus_pipeline')) else real(n, *a)\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries())\n"
        "assert names and not any(n.startswith('op') for n in names) and 'pipeline' not in names, names\n"
        "assert set(e.oracle_sql()) <= names\n"
        "assert not any(m.startswith('phrasemill.llm') for m in sys.modules)\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_document_results_of_long_documents(spark, tmp_path):
    from phrasemill.plans.queries import QUERIES

    long = " ".join(f"Harbour{i % 50} boats carry grain{i % 70} to the mill." for i in range(1000))  # 7,000 words
    spark.createDataFrame([(1, TEXT, "en"), (2, long, "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["document_results"](spark, str(tmp_path)).collect()
    assert len(found) == 2 and all(r.error is None and r.phrases for r in found)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    limited = {r.doc_id: r for r in D.extract_results(docs, plan_for("textrank", TextRankConfig(max_tokens=5000))).collect()}
    assert limited[1].error is None and limited[2].error.code == "limit_exceeded" and not limited[2].phrases


def test_lda_learns_from_all_documents(spark, tmp_path):
    from phrasemill.plans.queries import QUERIES
    from phrasemill.sources.topic_weights import fit_lda, topic_weights_from_lda

    groups = (("boat", "harbour", "sail", "tide"), ("mill", "grain", "flour", "stone"))
    rows = [(i, w, False) for i in range(40) for w in groups[i % 2] * 3]
    model, vectors, vocabulary = fit_lda(spark.createDataFrame(rows, "doc_id long, lemma string, is_stopword boolean"), k=2)
    assert model.getSubsamplingRate() == 1.0 and model.getMaxIter() == 10
    best = {}
    for r in topic_weights_from_lda(model, vectors, vocabulary, 8).collect():
        best.setdefault(r.doc_id, []).append((r.weight, r.lemma))
    assert all({w for _, w in sorted(b)[-4:]} == set(groups[i % 2]) for i, b in best.items()) and len(best) == 40

    docs = [(i, " ".join(f"Word{chr(97 + i % 20)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60)), "en") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["lda_topic_weights"](spark, str(tmp_path)).groupBy("doc_id").count().collect()
    assert len(found) == 40 and all(r["count"] > 5 * 20 for r in found)  # 10 topics of 50 words


def test_the_rest_stands_without_llm(tmp_path):
    """A copy without the llm folders and the pipeline: the entry module imports and keeps its other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "phrasemill", tmp_path / "phrasemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tokens' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**__import__("os").environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) >= 62
