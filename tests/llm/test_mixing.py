import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phrasemill.llm import mixing

from .data import documents, empty, hard, rows


def apportioned(blocks, weights, seats):
    """Seats one by one to the highest quotient that still has a block."""
    got = Counter()
    for _ in range(seats):
        open_ = [s for s in blocks if got[s] < blocks[s]]
        if not open_:
            break
        got[max(sorted(open_), key=lambda s: weights.get(s, 1.0) / (2 * got[s] + 1))] += 1
    return got


def brute(docs, weights, block, shard_tokens, fraction=mixing.FRACTION, seed=mixing.SEED):
    """mix() of (doc_id, text, source), no doc_id twice, in plain Python: (shard, source, first_block, last_block, doc_id, first_word, end_word)."""
    md5 = lambda *x: hashlib.md5("|".join(map(str, (seed, *x))).encode()).hexdigest()
    n_words = {i: len(re.findall(mixing.PIECE, t or "")) for i, t, _ in docs}
    shards = max(1, math.ceil(sum(n_words.values()) / shard_tokens))
    streams = defaultdict(list)
    for i, _, s in docs:
        order = md5("" if i is None else i)
        streams[s] += [(int(order[:8], 16) % shards, order, i, w) for w in range(n_words[i])]
    blocks, shard_of = {}, {}
    for s, words in streams.items():
        words.sort(key=lambda x: (x[0], x[1], x[3]))
        for b in range(-(-len(words) // block)):
            shard_of[s, b] = words[min((b + 1) * block, len(words)) - 1][0]
            blocks[s] = b + 1
    key = lambda s: "" if s is None else "=" + s
    seats = max(1, math.floor(fraction * sum(blocks.values()) + 0.5)) if fraction else 0
    quota = apportioned({key(s): n for s, n in blocks.items()}, {"=" + k: w for k, w in weights.items()}, seats)
    out = []
    for s, words in streams.items():
        q, chosen = quota[key(s)], set()
        for shard in {shard_of[s, b] for b in range(blocks[s])}:
            own = [b for b in range(blocks[s]) if shard_of[s, b] == shard]
            share = [(2 * b * q + blocks[s]) // (2 * blocks[s]) for b in (own[0], own[-1] + 1)]
            chosen |= set(sorted(own, key=lambda b: (md5(shard, key(s), b), b))[: share[1] - share[0]])
        run = None
        for at, (_, _, i, w) in enumerate(words):
            b = at // block
            if run and (run[4], run[0]) == (i, shard_of[s, b]) and run[6] == w and b in chosen:
                run[3], run[6] = b, w + 1
                continue
            if run:
                out.append(tuple(run))
            run = [shard_of[s, b], s, b, b, i, w, w + 1] if b in chosen else None
        if run:
            out.append(tuple(run))
    return out


def corpus(spark, n=300):
    return documents(spark, [(i, " ".join(f"w{i}_{j}" for j in range(5 + i * 7 % 60)), f"src{i % 4}" if i % 9 else None) for i in range(n)])


@pytest.mark.parametrize("most_sorted", [1, 40, 10_000])
@pytest.mark.parametrize("fraction", [0.0, 0.3, 0.6, 1.0])
def test_quotas(spark, fraction, most_sorted):
    """Seats one by one, however narrow the search has to get; equal weights tie at every quotient."""
    weights = {"a": 2.0, "b": 2.0, "c": 1.5, "d": 0.1, "e": 0.0}
    blocks = {"a": 90, "b": 40, "c": 200, "d": 33, "e": 50, "f": 1, "g": 0}
    totals = spark.createDataFrame([("=" + s, s, n) for s, n in blocks.items()], "source_key string, source string, n_blocks long")
    found = {r.source_key: r.quota for r in mixing.quotas(totals, weights, fraction, most_sorted).collect()}
    able = {s: n for s, n in blocks.items() if weights.get(s, 1.0) > 0}
    expected = apportioned(able, weights, math.floor(fraction * sum(blocks.values()) + 0.5))
    assert {s: found.get("=" + s, 0) for s in blocks} == {s: expected[s] for s in blocks}


@pytest.mark.parametrize("shard_tokens,fraction", [(3000, 0.6), (700, 0.35), (1 << 22, 0.6), (400, 1.0)])
def test_against_brute_force_and_sql(spark, tmp_path, shard_tokens, fraction):
    docs, weights = corpus(spark), {"src0": 2.0, "src1": 1.5, "src2": 0.5}
    found = rows(mixing.mix(docs, weights, 50, shard_tokens, fraction))
    plain = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert found == sorted(brute(plain, weights, 50, shard_tokens, fraction), key=repr)
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    sql = db.execute(mixing.oracle(weights, 50, shard_tokens, fraction)).fetchall()
    assert sorted(sql, key=repr) == found


def test_parts_fill_the_chosen_blocks(spark):
    docs = corpus(spark)
    out = mixing.mix(docs, block_tokens=50, shard_tokens=3000).collect()
    taken = Counter()
    for r in out:
        assert 0 <= r.first_word < r.end_word
        taken[r.shard, r.source] += r.end_word - r.first_word
    assert len([n for n in taken.values() if n % 50]) <= 5  # whole blocks, but for the last one of each source
    assert rows(mixing.mix(docs, block_tokens=50, shard_tokens=3000)) == sorted((tuple(r) for r in out), key=repr)  # seeded
    assert rows(mixing.mix(docs, block_tokens=50, shard_tokens=3000, seed=18)) != sorted((tuple(r) for r in out), key=repr)


def test_shares_come_near_the_weights(spark):
    docs = documents(spark, [(i, "a b c d e f g h i j " * 5, f"src{i % 3}") for i in range(600)])
    out = mixing.mix(docs, {"src0": 2.0, "src1": 1.0, "src2": 1.0}, block_tokens=100, shard_tokens=1 << 20, fraction=0.5)
    taken = {r[0]: r[1] for r in out.groupBy("source").agg({"end_word": "sum"}).collect()}
    words = {r[0]: r[1] for r in out.selectExpr("source", "end_word - first_word AS n").groupBy("source").sum("n").collect()}
    assert set(taken) == {"src0", "src1", "src2"}
    assert words["src0"] / sum(words.values()) == pytest.approx(0.5, abs=0.02)


def test_stage_cuts_texts_as_mix_says(spark):
    docs = corpus(spark, 120)
    texts = {r.doc_id: r for r in docs.collect()}
    parts = mixing.mix(docs, block_tokens=50, shard_tokens=3000).collect()
    expected = sorted((r.doc_id, " ".join(texts[r.doc_id].text.split()[r.first_word : r.end_word]), r.source) for r in parts if r.source is not None)
    out = mixing.mixed(docs, block_tokens=50, shard_tokens=3000)
    assert out.columns == docs.columns
    found = sorted((r.doc_id, r.text.strip(), r.source) for r in out.where("source IS NOT NULL").collect())
    assert found == expected
    assert out.where("n_chars <> length(text)").count() == 0


def test_hard_rows(spark):
    docs = hard(spark)
    out = mixing.mix(docs, block_tokens=10, shard_tokens=1000)
    n = out.count()
    assert n and out.where("doc_id IN (4, 5, 6)").count() == 0
    stage = mixing.mixed(docs, block_tokens=10, shard_tokens=1000)
    assert stage.columns == docs.columns and stage.count() == n
    assert stage.where("`a.b` IS NULL OR `row` <> 'extra6'").count() == 0
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0
    assert mixing.mix(documents(spark, [(1, None), (2, "")])).count() == 0


def test_rare_heavy_source_over_many_shards(spark):
    """A heavy source with less than a block in each shard, or less than one block in all, is offered whole."""
    docs = documents(spark, [(i, f"w{i} " * 20, "rare" if i % 30 == 0 else "common") for i in range(1800)] + [(5000 + i, "x y z", "tiny") for i in range(6)])
    weights = {"rare": 50.0, "tiny": 50.0}
    out = mixing.mix(docs, weights, block_tokens=50, shard_tokens=1200, fraction=0.6).collect()
    assert len({r.shard for r in out}) > 25
    got = Counter()
    for r in out:
        got[r.source] += r.end_word - r.first_word
    assert got["rare"] == 1200 and got["tiny"] == 18
    words = [(r.doc_id, w) for r in out for w in range(r.first_word, r.end_word)]
    assert len(words) == len(set(words))  # no word is taken twice
    stage = mixing.mixed(docs, weights, block_tokens=50, shard_tokens=1200, fraction=0.6)
    assert sum(len(r.text.split()) for r in stage.where("source = 'rare'").collect()) == 1200
    few = documents(spark, [(i, f"w{i} " * 400, "rare" if i < 2 else "common") for i in range(30)])
    assert {r.source for r in mixing.mix(few, {"rare": 100.0}, shard_tokens=10_000).collect()} >= {"rare"}


def test_all_blocks_are_all_words(spark):
    docs = corpus(spark)
    have, got = Counter(), Counter()
    for r in docs.collect():
        have[r.source] += len(r.text.split())
    for r in mixing.mix(docs, block_tokens=50, shard_tokens=700, fraction=1.0).collect():
        got[r.source] += r.end_word - r.first_word
    assert got == have


def test_rows_alike_in_id_and_text(spark):
    """Their order is that of all their columns, nested maps among them, so the parts are the same each time."""
    docs = documents(spark, [(1, "a b c d e f g h " * 5)] * 6).withColumn("n", F.lit(None)).withColumn("extra", F.struct(F.create_map(F.lit("k"), F.rand(3)).alias("m")))
    docs = docs.select("doc_id", "text", "source", "extra")
    cut = lambda d: sorted((r.extra.m["k"], r.text) for r in mixing.mixed(d, block_tokens=30, fraction=0.5).collect())
    kept = spark.createDataFrame(docs.collect(), docs.schema)
    assert cut(kept) == cut(kept.repartition(3)) and cut(kept)


def test_words_are_counted_without_being_cut(spark, capsys):
    texts = [None, "", "a", " a", "a ", " \x0b\x0c", "a\x1cb\x85c d", "naïve 日本語\r\n🎉", "x" * 70_000, "word\t" * 5000]
    expected = [len(re.findall(mixing.PIECE, t or "")) for t in texts]
    assert mixing.word_counts(pa.array(texts)).tolist() == expected
    assert mixing.word_counts(pa.array(texts).slice(2, 5)).tolist() == expected[2:7] and mixing.word_counts(pa.array([], pa.string())).tolist() == []
    docs = documents(spark, list(enumerate(texts)))
    counted = mixing._streams(docs, [], 1, 1)
    assert {r.id: r.n for r in counted.collect()} == {i: n for i, n in enumerate(expected) if n}
    counted.explain()
    assert "regexp_extract_all" not in capsys.readouterr().out
