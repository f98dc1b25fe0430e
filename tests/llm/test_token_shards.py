import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phrasemill.llm import token_shards as S
from phrasemill.llm import tokens

from .data import LONG, documents, empty, hard


@given(st.integers(0, 3000), st.integers(0, 2**32), st.integers(1, 6))
@settings(max_examples=50, deadline=None)
def test_slots_are_a_permutation(n, seed, rounds):
    slots = S.permuted(np.arange(n), n, seed, rounds)
    assert sorted(slots.tolist()) == list(range(n))
    assert (S.permuted(np.arange(n)[::-1], n, seed, rounds)[::-1] == slots).all()


def test_seeds_give_other_orders():
    assert (S.permuted(np.arange(1000), 1000, 1) != S.permuted(np.arange(1000), 1000, 2)).mean() > 0.9


def sequences(texts, seq_len):
    out = []
    for text in texts:
        ids = tokens.encoding(tokens.VOCABULARY).encode_ordinary(text or "")
        out += [tuple(ids[i : i + seq_len] + [tokens.END] * (seq_len - len(ids[i : i + seq_len]))) for i in range(0, len(ids), seq_len)]
    return out


TEXTS = [f"Document {i} says {'a harbour town ' * (i % 9)}and ends." for i in range(60)] + [LONG[:5000], None, ""]


def stored(texts, path, rows):
    """A file of small row groups, so that tasks may be cut in many ways."""
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), path, row_group_size=rows)


def test_shards_hold_every_sequence(spark, tmp_path):
    stored(TEXTS, tmp_path / "documents.parquet", 100)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    made = S.training_order(docs, seq_len=16, shard_rows=32).collect()
    n = len(made)
    assert [r.slot for r in made] == list(range(n))
    assert all(r.shard == r.slot // 32 and r.byte_offset == r.slot % 32 * 32 for r in made)
    # the slot of each sequence: numbered in the order of the file, then permuted
    expected = sequences(TEXTS, 16)
    slots = S.permuted(np.arange(n), n)
    by_slot = {r.slot: tuple(np.frombuffer(r.tokens, "<u2").tolist()) for r in made}
    assert [by_slot[s] for s in slots.tolist()] == expected
    folder = str(tmp_path / "shards")
    written = S.write_shards(docs, folder, seq_len=16, shard_rows=32).collect()
    assert all(r.is_new for r in written) and sum(r.n_rows for r in written) == n
    read = [tuple(x.tolist()) for x in S.read_from(folder, 0)]
    assert read == [by_slot[s] for s in range(n)]
    assert [tuple(x.tolist()) for x in S.read_from("file:" + folder, 45)] == read[45:]  # resumed
    whole = S.shards(docs, seq_len=16, shard_rows=32).collect()
    assert [(r.shard, r.first_slot, r.n_rows, r.stride) for r in whole] == [(i, 32 * i, min(32, n - 32 * i), 32) for i in range(-(-n // 32))]
    assert [bytes(r.data) for r in whole] == [open(r.path, "rb").read() for r in written]
    assert [x for r in whole for x in zip(r.doc_ids, r.seqs, r.n_tokens)] == [(r.doc_id, r.seq, r.n_tokens) for r in made]


def test_slots_are_the_same_under_any_split(spark, tmp_path):
    stored(TEXTS * 4, tmp_path / "documents.parquet", 10)
    found, folder, before = [], str(tmp_path / "shards"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "2k", "700b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
            found.append((docs.rdd.getNumPartitions(), S.training_order(docs, seq_len=16, shard_rows=32).collect()))
            new = {r.path: r.is_new for r in S.write_shards(docs, folder, seq_len=16, shard_rows=32).collect()}
            # a broken run is taken up under another split; a file of the right length with other bytes is replaced
            assert all(new.values()) if size == "128m" else [p for p, x in new.items() if x] == [bad]
            bad = sorted(new)[1]
            open(bad, "r+b").write(b"\0" * 64)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({n for n, _ in found}) > 1
    assert found[0][1] == found[1][1] == found[2][1]


def test_a_shorter_corpus_in_the_same_folder(spark, tmp_path):
    folder = str(tmp_path / "shards")
    for texts in (TEXTS, TEXTS[:20]):
        S.write_shards(documents(spark, list(enumerate(texts))), folder, seq_len=16, shard_rows=32).collect()
        assert sorted(tuple(x.tolist()) for x in S.read_from(folder, 0)) == sorted(sequences(texts, 16))


def test_tables_that_are_not_files(spark):
    docs = documents(spark, list(enumerate(TEXTS)))
    order = lambda d: S.training_order(d, seq_len=16).collect()
    assert order(docs) == order(docs.repartition(5)) == order(docs.withColumn("_metadata", F.lit(1)))


def test_hard_rows(spark):
    docs = hard(spark)
    made = S.training_order(docs, seq_len=64, shard_rows=100).toPandas()
    expected = sequences([r.text for r in docs.collect()], 64)
    assert sorted(tuple(np.frombuffer(t, "<u2").tolist()) for t in made.tokens) == sorted(expected)
    assert not set(made.doc_id.dropna()) & {4.0, 5.0} and made.doc_id.isna().any()
    assert S.training_order(empty(spark)).count() == 0
    assert S.training_order(documents(spark, [(1, None), (2, "")])).count() == 0
    assert S.training_order(documents(spark, [(1, "one")])).count() == 1
    assert sum(r.n_rows for r in S.shards(docs, seq_len=64, shard_rows=100).collect()) == len(made) and S.shards(empty(spark)).count() == 0
