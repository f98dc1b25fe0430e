import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasemill.llm import simhash as S
from phrasemill.llm.common import Known, plain

from .data import LONG, PROSE, documents, empty, hard, rows


def near(rng, n, total):
    """Random fingerprints, each with neighbours up to a few places beyond the radius."""
    base = rng.integers(0, 2**63, (n, 2)).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, (n, 2)).astype(np.uint64)
    out = [base]
    for k in range(1, total + 5):
        moved = base.copy()
        for row in moved:
            for bit in rng.choice(128, k, replace=False):
                row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        out.append(moved)
    return np.unique(np.concatenate(out), axis=0)


def connected(n, pairs):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        label[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("radius", [0, 3, 17])
def test_trees_against_all_pairs(radius):
    """All pairs of two trees, and grouped, what they connect."""
    v = near(np.random.default_rng(radius), 30, radius)
    tree = np.arange(len(v)) % 2
    forest = S.BKForest(v, tree, radius)
    q, x = np.nonzero((S._apart(v[:, None], v[None]) <= radius) & (tree[:, None] == tree[None]))
    expected = set(zip(q.tolist(), x.tolist()))
    assert {(int(a), int(b)) for q, x in forest.search(v, tree, grouped=False) for a, b in zip(q, x)} == expected
    found = [(int(a), int(b)) for q, x in [*forest.search(v, tree), forest.links] for a, b in zip(q, x)]
    assert set(found) <= expected and connected(len(v), found) == connected(len(v), expected)


def test_edges_are_distances_and_trees_branch():
    v = near(np.random.default_rng(5), 40, 9)
    forest = S.BKForest(v, np.zeros(len(v), int), 9)
    below = forest.parent >= 0
    assert below.sum() == len(v) - 1  # one root
    assert (S._apart(v[below], v[forest.parent[below]]) == forest.edge[below]).all()
    assert len(set(zip(forest.parent[below].tolist(), forest.edge[below].tolist()))) == below.sum()  # a child for each distance
    depth, at = 0, np.arange(len(v))
    while (at := forest.parent[at][forest.parent[at] >= 0]).size:
        depth += 1
    assert depth > 2 and np.bincount(forest.parent[below]).max() > 10


def test_a_family_of_copies_costs_no_pairs():
    """3,000 copies around one fingerprint: about a comparison each, not one for each pair."""
    rng = np.random.default_rng(2)
    v = np.zeros((3000, 2), np.uint64)
    for row in v:
        for bit in rng.choice(128, 8, replace=False):
            row[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
    v = np.unique(np.r_[np.zeros((1, 2), np.uint64), v], axis=0)
    shard = np.zeros(len(v), int)
    a, b = S.shard_links(shard, np.zeros(len(v), bool), v, 17)
    assert len(a) < 4 * len(v) and set(connected(len(v), zip(a.tolist(), b.tolist()))) == {0}


def test_rows_without_a_partner_grow_no_tree(monkeypatch):
    """A shard of thousands of unrelated rows and a few pairs: trees take the pairs, and links connect what all pairs do."""
    rng = np.random.default_rng(4)
    alone = rng.integers(0, 2**63, (6000, 2)).astype(np.uint64)
    v = np.unique(np.concatenate([alone, near(rng, 30, 17)]), axis=0)
    shard, visits = rng.integers(0, 2, len(v)), rng.random(len(v)) < 0.4
    grown, grow = [], S.BKForest.__init__
    monkeypatch.setattr(S.BKForest, "__init__", lambda self, values, *a: grown.append(len(values)) or grow(self, values, *a))
    a, b = S.shard_links(shard, visits, v, 17)
    q, x = np.nonzero(S._apart(v[:, None], v[None]) <= 17)
    meet = (q != x) & (shard[q] == shard[x]) & ~(visits[q] & visits[x])
    assert connected(len(v), zip(a.tolist(), b.tolist())) == connected(len(v), zip(q[meet].tolist(), x[meet].tolist()))
    assert len(set(q[meet].tolist())) > 300 and sum(grown) <= len(set(q[meet].tolist()))


@pytest.mark.parametrize("few,most,tile,side", [(0, 1 << 34, 1 << 15, 1 << 11), (0, 1 << 34, 64, 7), (1 << 10, 1 << 12, 1 << 15, 1 << 11), (1 << 40, 1 << 40, 64, 8)])
def test_partners_against_all_pairs(monkeypatch, few, most, tile, side):
    for name, value in (("FEW_PAIRS", few), ("MOST_PAIRS", most), ("TILE", tile), ("SIDE", side)):
        monkeypatch.setattr(S, name, value)
    rng = np.random.default_rng(6)
    family = np.zeros((200, 2), np.uint64)
    family[:, 1] = np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
    v = np.concatenate([near(rng, 20, 17), rng.integers(0, 2**63, (300, 2)).astype(np.uint64), np.unique(family, axis=0)])
    shard, visits = np.sort(rng.integers(0, 5, len(v))), rng.random(len(v)) < 0.5
    visits[shard == 3] = True
    order = np.lexsort((visits, shard))
    visits, v = visits[order], v[order][rng.permutation(len(v))]
    meet = (S._apart(v[:, None], v[None]) <= 17) & (shard[:, None] == shard[None]) & ~(visits[:, None] & visits[None]) & ~np.eye(len(v), dtype=bool)
    may = S.partnered(shard, visits, v, 17)
    assert may[meet.any(1)].all() and not may[shard == 3].any()
    if (few, tile) == (0, 1 << 15):
        assert (may == meet.any(1)).mean() > 0.9
    assert S.partnered(shard[:0], visits[:0], v[:0], 17).tolist() == []


@pytest.mark.parametrize("total,n", [(1, 10), (6, 10), (17, 10), (17, 10**7), (17, 10**10), (3, 10**12)])
def test_a_pair_within_the_radius_meets(total, n):
    """One of any two such fingerprints is a member of a shard that the other is in, however many there are."""
    import pyarrow as pa

    rng = np.random.default_rng(total)
    plan = S.scheme(total, n)
    assert sum(w for _, w in plan.blocks) == 128 and max(w for _, w in plan.blocks) <= 32
    for _ in range(20):
        a = rng.integers(0, 2**63, 2).astype(np.uint64)
        b = a.copy()
        for bit in rng.choice(128, total, replace=False):
            b[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        hi, lo = (pa.array(np.array([a[i], b[i]]).view(np.int64)) for i in (0, 1))
        own = pa.Table.from_batches(S._keys(plan)(iter([pa.RecordBatch.from_arrays([hi, lo], names=["hi", "lo"])]))).to_pandas()
        first = (own.hi == np.int64(a.view(np.int64)[0])) & (own.lo == np.int64(a.view(np.int64)[1]))
        x, y = own[first], own[~first]
        assert set(x[~x.visits].shard) & set(y.shard) or set(y[~y.visits].shard) & set(x.shard)


def test_blocks_widen_with_the_number_of_fingerprints():
    assert [len(S.scheme(17, n).blocks) for n in (0, 10**6, 10**7, 10**9)] == [9, 9, 6, 6]


@pytest.mark.parametrize("n", [10, 10**7])
def test_links_against_all_pairs(spark, n):
    """Shards of hundreds of members, so trees with branches, for narrow and for wider blocks."""
    rng = np.random.default_rng(3)
    v = near(rng, 25, 17)
    v[::2, 0] &= np.uint64((1 << 45) - 1)  # a hot block
    v = np.unique(v, axis=0)
    frame = spark.createDataFrame([(int(a), int(b)) for a, b in v.view(np.int64)], "hi long, lo long")
    at = {tuple(x): i for i, x in enumerate(v.view(np.int64).tolist())}
    found = [(at[r.a_hi, r.a_lo], at[r.b_hi, r.b_lo]) for r in S.fingerprint_links(frame, 17, S.scheme(17, n)).collect()]
    q, x = np.nonzero(S._apart(v[:, None], v[None]) <= 17)
    assert connected(len(v), found) == connected(len(v), zip(q.tolist(), x.tolist()))


def brute_print(text):
    words = {plain(t) for t in (text or "").encode().split()} - {b""}
    if not words:
        return None
    bits = [0] * 128
    for w in words:
        x = int.from_bytes(hashlib.md5(w).digest(), "big")
        for i in range(128):
            bits[i] += x >> (127 - i) & 1
    return sum(1 << (127 - i) for i in range(128) if 2 * bits[i] > len(words))


def brute(docs, total):
    prints = [brute_print(t) for _, t in docs]
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if prints[i] is not None and prints[j] is not None and (prints[i] ^ prints[j]).bit_count() <= total:
                label[root(i)] = root(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(root(i), []).append(i)
    out = []
    for own in groups.values():
        ids = [docs[i][0] for i in own if docs[i][0] is not None]
        out += [(docs[i][0], min(ids, default=None), len(own)) for i in own]
    return sorted(out, key=repr)


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    docs = []
    for i in range(40):
        words = rng.choices(vocabulary, k=rng.choice([5, 40, 120]))
        docs.append((10 * i, " ".join(words)))
        for k in range(i % 4):
            copy = words[:]
            for _ in range(len(copy) * k // 20):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((10 * i + k + 1, " ".join(copy)))
    return docs


def test_fingerprint():
    digests = Known(S._bits)
    for _, text in corpus()[:20]:
        assert int.from_bytes(S.fingerprint(text.encode().split(), digests), "big") == brute_print(text)
    assert S.fingerprint([b"!!"], digests) is None


def test_groups_against_brute_force(spark):
    docs = corpus()
    found = S.groups(documents(spark, docs))
    assert rows(found, "doc_id", "group_id", "group_size") == brute(docs, S.TOTAL)
    kept = found.where("is_kept").select("doc_id", "group_id").collect()
    assert all(r.doc_id == r.group_id for r in kept) and len(kept) == len({r.group_id for r in found.collect()})


def test_chains_connect(spark):
    """Copies that follow from each other are one group, however long the chain."""
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.label for r in S.components(e).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_hard_rows_and_stage(spark):
    docs = hard(spark)
    plain_rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows(S.groups(docs), "doc_id", "group_id", "group_size") == brute(plain_rows, S.TOTAL)
    out = S.deduplicated(docs)
    assert out.columns == docs.columns
    found = sorted((r.doc_id for r in out.collect()), key=repr)
    least = {(i, g) for i, g, _ in brute(plain_rows, S.TOTAL) if brute_print(dict(plain_rows)[i])}
    blank = [i for i, t in plain_rows if brute_print(t) is None]
    assert found == sorted([*{g for _, g in least}, *blank], key=repr)
    assert S.groups(empty(spark)).count() == 0 and S.deduplicated(empty(spark)).count() == 0


def test_hot_fingerprint_and_nested_maps(spark):
    """Half of the rows are one text, some of them alike in all columns; a struct holds a map."""
    docs = documents(spark, [(i % 300, PROSE) for i in range(400)] + [(1000 + i, t) for i, t in corpus()]).withColumn("s", F.struct(F.create_map(F.lit("k"), F.col("doc_id")).alias("m"), F.array(F.create_map(F.lit(1), F.lit(2))).alias("a")))
    plain_rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = S.groups(docs)
    assert rows(found, "doc_id", "group_id", "group_size") == brute(plain_rows, S.TOTAL)
    assert found.where("is_kept").count() == found.select("group_id").distinct().count()
    assert sorted(r.doc_id for r in S.deduplicated(docs).collect()) == sorted({g for _, g, _ in brute(plain_rows, S.TOTAL)})


def test_rows_without_a_word_all_stay(spark):
    docs = documents(spark, [(i, t) for i, t in enumerate([None, "", "...", None, ""])] + [(1, "")])
    assert S.deduplicated(docs).count() == 6
    long = documents(spark, [(1, LONG), (2, LONG + " word1x1")])
    assert rows(S.groups(long), "doc_id", "is_kept") == [(1, True), (2, False)]


def test_a_word_has_one_digest_however_it_is_written(monkeypatch):
    """All texts of a slice at once, their plain words told apart before digests are made; the fingerprints are the same."""
    import pyarrow as pa

    texts = [None, "", " \t", "_ -- !!", "The boats, the Boats; THE boats", "boats the", "Σας ΑΣ İI x_y naïve 日本語 🎉", " \x0b a\x0cb ", "a\x1cb\x85c d", "word " * 9 + "x" * 100_000]
    texts += [t for _, t in corpus()[:20]]
    made, md5 = [], hashlib.md5
    monkeypatch.setattr(S.hashlib, "md5", lambda w: made.append(w) or md5(w))
    halves, found = S.prints(pa.array(texts))
    monkeypatch.undo()
    assert len(made) == len(set(made)) and {b"the", b"boats"} < set(made) and b"boats," not in made
    assert [int.from_bytes(h.astype(">i8").tobytes(), "big") if x else None for h, x in zip(halves, found)] == [brute_print(t) for t in texts]
