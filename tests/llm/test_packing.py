import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from phrasemill.llm import packing, tokens

from .data import LONG, documents, empty, hard


@given(st.integers(0, 200_000), st.integers(0, 14))
def test_lengths_are_powers_that_add_up(n, max_log):
    logs = packing.binary_lengths(n, max_log)
    assert sum(1 << x for x in logs) == n
    assert logs == sorted(logs, reverse=True) and all(x <= max_log for x in logs)
    assert all(logs.count(x) <= 1 for x in range(max_log))


def test_pieces_are_the_document(spark):
    texts = {1: "One harbour, two boats.", 2: "a", 3: LONG, 4: "  two  spaces\n\nand lines ", 5: "naïve 日本語 🎉"}
    out = packing.packed(documents(spark, list(texts.items()))).toPandas().sort_values(["doc_id", "piece"])
    encoding = tokens.encoding(tokens.VOCABULARY)
    assert (out.n_tokens == 2**out.bucket).all() and (out.tokens.map(len) == out.n_tokens).all()
    for doc_id, own in out.groupby("doc_id"):
        ids = np.concatenate(own.tokens.to_list()).tolist()
        assert ids == encoding.encode_ordinary(texts[doc_id])
        assert encoding.decode(ids) == texts[doc_id]
        assert own.start.to_list() == [0, *own.n_tokens.cumsum().to_list()[:-1]]


def test_hard_rows(spark):
    out = packing.packed(hard(spark)).groupBy("doc_id").count().collect()
    found = {r[0]: r[1] for r in out}
    one = packing.packed(documents(spark, [(2, hard(spark).where("doc_id = 2").first().text)])).count()
    assert found[2] == one and found[1] == 2 * one  # a repeated row is packed again
    assert not {4, 5} & set(found) and None in found
    assert packing.packed(empty(spark)).count() == 0


def test_batches_hold_pieces_of_one_length(spark):
    docs = documents(spark, [(i, f"harbour {i} and the boats " * (1 + i % 40)) for i in range(300)] + [(999, LONG)]).repartition(3)
    out = packing.packed(docs, max_log=8, batch_tokens=1024).toPandas()
    short = 0
    for _, own in out.groupby("batch"):
        assert own.bucket.nunique() == 1
        assert own.n_tokens.sum() <= 1024
        short += own.n_tokens.sum() < 1024
    assert short <= 3 * 9  # the last one of each task and bucket
    report = {r.bucket: (r.sequences, r.tokens, r.batches) for r in packing.bucket_report(packing.packed(docs, max_log=8, batch_tokens=1024)).collect()}
    assert all(t == n << b and out[out.bucket == b].batch.nunique() == k for b, (n, t, k) in report.items())
    one = packing.packed(documents(spark, [(1, LONG)]), batch_tokens=1).toPandas()
    assert one.batch.nunique() == len(one)
