import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from phrasemill.llm import mixing, packing, quality_rules, secrets, simhash, tokens

from .data import OTHER, PROSE, documents, hard
from .test_mixing import brute as mix
from .test_quality_rules import brute as statistics
from .test_quality_rules import verdict
from .test_simhash import brute as groups
from .test_simhash import brute_print, corpus


def staged(spark, docs):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stage(spark, docs, "")
    return out


def brute(rows):
    """The pipeline over (doc_id, text, source), no doc_id twice, in plain Python."""
    rows = [r for r in rows if verdict(statistics(r[1])) == ""]
    labels = dict((i, g) for i, g, _ in groups([r[:2] for r in rows], simhash.TOTAL))
    rows = [(i, secrets.redacted(t), s) for i, t, s in rows if labels[i] == i or brute_print(t) is None]
    texts = {i: t for i, t, _ in rows}
    out = []
    for *_, i, first, end in mix(rows, mixing.TARGETS, mixing.BLOCK_TOKENS, mixing.SHARD_TOKENS):
        words = re.findall(mixing.PIECE, texts[i])
        out.append((i, texts[i] if end - first == len(words) else "".join(words[first:end])))
    rows = []
    for i, text in out:
        ids, start = tokens.encoding(tokens.VOCABULARY).encode_ordinary(text), 0
        for piece, log in enumerate(packing.binary_lengths(len(ids))):
            rows.append((i, piece, log, start, 1 << log, tuple(ids[start : start + (1 << log)])))
            start += 1 << log
    return sorted(rows)


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "secret scans", "mixing sources to target weights", "packing"]
    the = "the of and to in is it that "
    docs = documents(spark, [(i, the * 3 + t) for i, t in corpus()] + [(9001, "BUY!! NOW!! CHEAP!!"), (9002, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"\n' + PROSE + OTHER)])
    out = staged(spark, docs)
    ids = {n: Counter(r.doc_id for r in df.select("doc_id").collect()) for n, df in out.items()}
    good = {r.doc_id for r in quality_rules.verdicts(docs).where("is_kept").collect()}
    assert set(ids["quality rules"]) == good and 9001 not in good and 9002 in good
    single = {r.doc_id for r in simhash.groups(out["quality rules"]).where("is_kept").collect()}
    assert set(ids["SimHash near-dedup"]) == set(ids["secret scans"]) == single
    (text,) = [r.text for r in out["secret scans"].where("doc_id = 9002").collect()]
    assert "24be64439e3e" not in text and secrets.MASK in text
    for name in list(out)[:-1]:
        assert out[name].columns == docs.columns


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(30):
        words = [f"w{rng.randrange(3000)}x{i}" if k % 3 else rng.choice(["the", "of", "and"]) for k in range(2600)]
        rows.append((10 * i, " ".join(words), f"src{i % 3}" if i % 7 else None))
        if i % 4 == 0:
            words[5:9] = ["another", "few", "words", "here"]
            rows.append((10 * i + 1, " ".join(words), "src1"))
    rows[3] = (rows[3][0], rows[3][1] + '\napi_key = "a8F3kd93LmQ0zz7"\n', rows[3][2])
    rows += [(901, "BUY!! NOW!! CHEAP!!", "src0"), (902, None, "src0"), (903, "", "src1"), (904, "a | b | c | d", None)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    expected = brute(rows)
    assert found.columns == packing.packed(documents(spark, rows)).columns and expected
    assert sorted((r.doc_id, r.piece, r.bucket, r.start, r.n_tokens, tuple(r.tokens)) for r in found.collect()) == expected


def test_every_stage_stands_hard_rows(spark):
    """Nulls, empty and very long texts, ties, repeated rows and further columns of any name, each with a defined result."""
    docs = hard(spark)
    given = [(r.doc_id, r.text) for r in docs.collect()]
    out = {name: stage(spark, docs, "") for name, stage in corpus_pipeline.STAGES}
    ids = lambda name: Counter(r.doc_id for r in out[name].select("doc_id").collect())
    assert ids("quality rules") == Counter(i for i, t in given if verdict(statistics(t)) == "")
    blank = Counter(i for i, t in given if brute_print(t) is None)
    assert ids("SimHash near-dedup") == blank + Counter({g for i, g, _ in groups(given, simhash.TOTAL) if i not in blank})
    assert ids("secret scans") == Counter(i for i, _ in given)
    changed = [r.text for r in out["secret scans"].where("doc_id = 10").collect()]
    assert changed == [dict(given)[10].replace("Zx81kQp0vTr5mLw", secrets.MASK)]
    plain = [(i, t, s) for i, t, s in ((r.doc_id, r.text, r.source) for r in docs.collect())]
    words = Counter()
    for r in out["mixing sources to target weights"].collect():
        words[r.source] += len(r.text.split())
    have = Counter()
    for _, t, s in plain:
        have[s] += len((t or "").split())
    assert words and all(words[s] <= have[s] for s in words)
    n = Counter()
    for r in out["packing"].select("doc_id", "n_tokens").collect():
        n[r.doc_id] += r.n_tokens
    expected = Counter()
    for i, t in given:
        expected[i] += len(tokens.encoding(tokens.VOCABULARY).encode_ordinary(t or ""))
    assert n == +expected
    for name, stage in corpus_pipeline.STAGES:
        if name != "packing":
            assert out[name].columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0, name


def test_near_dedup_search_does_not_walk_unrelated_rows(monkeypatch):
    """The second stage's search over batches: 5,000 unrelated fingerprints that share a block, and 50 pairs among them."""
    rng = np.random.default_rng(8)
    v = rng.integers(0, 2**63, (5000, 2))
    v[:, 0] &= (1 << 49) - 1  # the first block of 15 bits is 0
    v = np.concatenate([v, v[:50] ^ np.array([0, 7])])
    keyed = pa.Table.from_batches(simhash._keys(simhash.scheme(simhash.TOTAL, len(v)))(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in v.T], names=["hi", "lo"])])))
    shard = keyed.filter(pc.equal(keyed["shard"], 0)).combine_chunks().to_batches(max_chunksize=1000)
    walked, grow = [], simhash.BKForest.__init__
    monkeypatch.setattr(simhash.BKForest, "__init__", lambda self, values, *a: walked.append(len(values)) or grow(self, values, *a))
    found = pa.Table.from_batches(simhash._search(simhash.TOTAL)(iter(shard))).to_pylist()
    assert {frozenset([(r["a_hi"], r["a_lo"]), (r["b_hi"], r["b_lo"])]) for r in found} == {frozenset(map(tuple, (v[i].tolist(), v[5000 + i].tolist()))) for i in range(50)}
    assert sum(walked) == 100
