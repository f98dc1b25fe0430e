import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pytest

from phrasemill.llm import suffix_dedup as S

from .data import LONG, documents, empty, hard, rows


def brute(docs, k, within=False):
    """Spans of k-word windows that another distinct document (or another place) has, from a plain array of all suffixes sorted by their first k words."""
    docs = sorted(set(docs), key=repr)
    cut = {d: (d[1] or "").encode().split() for d in docs}
    suffixes = sorted(((w[i : i + k], d, i) for d, w in cut.items() for i in range(len(w) - k + 1)), key=lambda x: x[0])
    at = defaultdict(set)
    places = Counter()
    for words, d, _ in suffixes:
        at[tuple(words)].add(d)
        places[tuple(words)] += 1
    out = []
    for d, w in cut.items():
        span = None
        for i in range(len(w) - k + 1):
            own = at[tuple(w[i : i + k])]
            if len(own) < 2 and not (within and places[tuple(w[i : i + k])] > 1):
                continue
            first = min((x[0] for x in own if x[0] is not None), default=None)
            if span and i <= span[1]:
                span[1] = i + k
                span[2] = min((x for x in (span[2], first) if x is not None), default=None)
            else:
                if span:
                    out.append((d[0], span[0], span[1], span[1] - span[0], span[2]))
                span = [i, i + k, first]
        if span:
            out.append((d[0], span[0], span[1], span[1] - span[0], span[2]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,q", [(5, 3), (8, 8), (6, 1), (1, 1)])
def test_against_brute_force(spark, k, q):
    rng = random.Random(k)
    docs = [(i, " ".join(rng.choices("abcde", weights=(8, 3, 2, 1, 1), k=rng.randint(0, 40)))) for i in range(25)]
    passage = " ".join(rng.choices("uvwxyz", k=20))
    docs += [(i, f"{i} head {passage} tail {i}") for i in range(30, 34)] + [(None, f"q {passage}"), (30, "other " + passage)] + docs[:2]
    found = rows(S.repeats(documents(spark, docs), k, q))
    assert found == brute(docs, k)
    assert rows(S.repeats(documents(spark, docs), k, q, within=True)) == brute(docs, k, within=True)
    # every bucket split over tasks; and none, but all in parts of a few words
    for settings in ({"hot": 1, "sampled": 1.0}, {"step": 1}, {"hot": 20, "sampled": 1.0, "step": 15}):
        assert rows(S.repeats(documents(spark, docs), k, q, **settings)) == found
    assert rows(S.repeats(documents(spark, docs), k, q, within=True, hot=1, sampled=1.0, step=1)) == brute(docs, k, within=True)


def test_production_parameters(spark):
    rng = random.Random(5)
    word = lambda n: " ".join(rng.choices([f"v{i}" for i in range(300)], k=n))
    passage, short = word(51), word(49)
    docs = [(1, f"{word(30)} {passage} {word(10)}"), (2, f"{passage}\n{word(80)}"), (3, word(200)), (4, f"{short} x"), (5, f"{short} y"), (6, LONG), (7, LONG + " end")]
    found = rows(S.repeats(documents(spark, docs)))
    assert found == brute(docs, S.MIN_WORDS)
    assert {r[0] for r in found} == {1, 2, 6, 7}


@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=30), min_size=1, max_size=4), st.integers(1, 12), st.data())
@settings(max_examples=150, deadline=None)
def test_pointers_tell_suffixes_apart(runs, depth, data):
    """Equal just where depth words are, like the ranks of a suffix array; buckets, too, where they are."""
    q = data.draw(st.integers(1, depth))
    words = np.array([w for r in runs for w in r], np.uint64)
    room = np.array([len(r) - i for r in runs for i in range(len(r))])
    ptr = S.pointers(words, room, q, depth)
    windows = {(r, i): tuple(own[i : i + depth]) for r, own in enumerate(runs) for i in range(len(own) - depth + 1)}
    at = {(r, i): sum(map(len, runs[:r])) + i for r, i in windows}
    for a in windows:
        for b in windows:
            assert (windows[a] == windows[b]) == (ptr[at[a]] == ptr[at[b]])
    bucket = {(r, i): x for r, own in enumerate(runs) if len(own) >= depth for i, x in enumerate(S.buckets(np.array(own, np.uint64), depth, q))}
    assert bucket.keys() == windows.keys()
    assert all(bucket[a] == bucket[b] for a in windows for b in windows if windows[a] == windows[b])


def test_a_text_that_half_of_the_rows_have(spark):
    """Runs that are alike travel once for each batch; a text of one word alone is cut into runs, too."""
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(300))
    docs = [(i, text) for i in range(200)] + [(1000 + i, f"{i} " + text[:-200]) for i in range(20)] + [(2000, "the " * 700), (2001, "the " * 400 + "end")]
    assert rows(S.repeats(documents(spark, docs))) == brute(docs, S.MIN_WORDS)
    assert rows(S.repeats(documents(spark, docs), hot=1000, sampled=1.0, step=2000)) == brute(docs, S.MIN_WORDS)
    assert S._hot(documents(spark, docs).selectExpr("doc_id AS doc_key", "doc_id", "text"), 50, 8, 1000, 1.0)
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(range(200)), pa.array([text] * 200)], names=["doc_key", "doc_id", "text"])
    (out,) = S._runs(50, 8, {})(iter([batch]))
    assert out.num_rows < 60 and out.column("words").nbytes < 60 * 400


def test_hard_rows(spark):
    docs = hard(spark)
    plain = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows(S.repeats(docs, 12, 4)) == brute(plain, 12)
    assert S.repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        S.repeats(docs, 5, 6)
