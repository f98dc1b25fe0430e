"""SimHash near-duplicates, found with BK-trees.

A document's fingerprint has 128 bits: bit i is set where more than half of its distinct words have bit i
set in their MD5.  Two documents are near-duplicates if their fingerprints differ in at most ``TOTAL``
places; groups are what such pairs connect.

Search.  The fingerprint is cut into blocks (``scheme``); two that differ in TOTAL places differ in at most
TOTAL // blocks places of one block.  So it is enough to compare within *shards*, one for each block and value,
which a fingerprint enters as a member or as a visitor under its own value and those few places away.  The
more fingerprints there are, the wider the blocks, so that shards stay small.  Each shard has its BK-tree: children
keyed by integer Hamming distance to the parent, and a query follows only edges within the radius.  The
trees live with their shards' rows instead of being broadcast: all trees together grow with the corpus.

What lies below an edge is exactly that edge's length from the parent.  Below edges within the radius all
are linked to the parent when the tree grows, so a query that is linked to the parent needs none of them: a family
of copies costs a comparison or two for each, not one for each pair, and groups are the same.

Unrelated fingerprints are nearly all about as far from each other, so edges hardly keep a query from any of them.
Rows without a partner in their shard are therefore left out before its tree grows (``partnered``), by comparing them
row by row in arrays; that costs a small part of a tree's step, and the pairs within the radius are the same.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, by_bytes, discard, plain, row_hash, row_of, table, written

TOTAL = 17
#: members of a shard, on average, beyond which blocks get wider
MEMBERS = 256
#: a fingerprint with more than this share of the rows is hot; so there are at most as many hot ones as its inverse
HOT = 1 / 1000
#: pairs of a query and a node that are looked at together
STEP = 1 << 20
#: pairs of a shard up to which, and beyond which, its trees take all its rows; pairs that are looked at together, and members of those
FEW_PAIRS, MOST_PAIRS, TILE, SIDE = 1 << 10, 1 << 34, 1 << 15, 1 << 11

#: what plain() leaves out of words that line breaks set apart; distinct words of a text whose bits are unpacked together
NO_WORD, AT_ONCE = re.compile(r"[^\w\n]+|_+"), 1 << 16


def _bits(token: bytes) -> bytes | None:
    word = plain(token)
    return hashlib.md5(word).digest() if word else None


def fingerprint(tokens: list[bytes], digests: dict) -> bytes | None:
    """16 bytes, or None without a word."""
    words = {digests[t] for t in set(tokens)}
    words.discard(None)
    if not words:
        return None
    bits = np.unpackbits(np.frombuffer(b"".join(words), np.uint8).reshape(-1, 16), axis=1)
    return np.packbits(bits.sum(0, dtype=np.int32) * 2 > len(words)).tobytes()


def prints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """fingerprint() of each text, n x 2 int64, and whether it has one: words are cut, told apart and made plain all at once.

    Only distinct plain words have a digest made.
    """
    out, found = np.zeros((len(texts), 16), np.uint8), np.zeros(len(texts), bool)
    words = pc.ascii_split_whitespace(texts)
    doc, own = pc.list_parent_indices(words).to_numpy(), words.flatten().dictionary_encode()
    if len(own):
        tokens = pa.ListArray.from_arrays(pa.array([0, len(own.dictionary)], pa.int32()), own.dictionary.cast(pa.binary()))
        # no token has a line break; what \w matches beside the underscore is what isalnum() holds of
        plain_words = NO_WORD.sub("", pc.binary_join(tokens, b"\n")[0].as_py().decode("utf-8", "replace").lower()).encode().split(b"\n")
        number = dict.fromkeys(plain_words)
        number.update(zip(number, range(len(number))))
        digests = np.frombuffer(b"".join([hashlib.md5(w).digest() for w in number]), np.uint8).reshape(-1, 16)
        key = doc * len(number) + np.fromiter(map(number.__getitem__, plain_words), np.int64, len(plain_words))[own.indices.to_numpy()]
        key.sort()
        doc, word = np.divmod(key[np.r_[True, key[1:] != key[:-1]]], len(number))
        some = word != number.get(b"", -1)
        doc, word = doc[some], word[some]
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        for i in np.flatnonzero(np.diff(bounds)).tolist():
            begin, end = int(bounds[i]), int(bounds[i + 1])
            bits = sum(np.unpackbits(digests[word[at : min(at + AT_ONCE, end)]], axis=1).sum(0, dtype=np.int32) for at in range(begin, end, AT_ONCE))
            out[i], found[i] = np.packbits(bits * 2 > end - begin), True
    return out.view(">i8").astype(np.int64), found


def fingerprints(text: Column) -> Column:
    """struct(hi, lo), null for texts that are null or have no word.  Whole texts, however long."""

    def run(texts: pa.Array) -> pa.Array:
        halves, found = (np.concatenate(x) for x in zip(*map(prints, by_bytes(texts)))) if len(texts) else (np.zeros((0, 2), np.int64), np.zeros(0, bool))
        return pa.StructArray.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["hi", "lo"], mask=pa.array(~found))

    return F.arrow_udf(run, "hi long, lo long")(text)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints whose last axis is (hi, lo)."""
    return np.bitwise_count(a[..., 0] ^ b[..., 0]) + np.bitwise_count(a[..., 1] ^ b[..., 1])


class BKForest:
    """A BK-tree for each number in ``tree`` over its distinct values (n x 2 unsigned), all grown and searched together.

    parent is -1 for a root, edge the distance to the parent; links are (node, an ancestor within radius).
    """

    def __init__(self, values: np.ndarray, tree: np.ndarray, radius: int):
        n = len(values)
        self.values, self.radius = values, radius
        self.parent, self.edge = np.full(n, -1), np.zeros(n, np.int64)
        names, first = np.unique(tree, return_index=True)
        self.root = dict(zip(names.tolist(), first.tolist()))
        at = first[np.searchsorted(names, tree)]  # how far down each value has come
        left = np.nonzero(at != np.arange(n))[0]
        free, links = np.ones(n, bool), []
        while len(left):
            far = _apart(values[left], values[at[left]]).astype(np.int64)
            near = free[left] & (far <= radius)
            links.append((left[near], at[left[near]]))
            free[left[near]] = False  # further down all is linked to that node, too
            _, head, own = np.unique(at[left] * 129 + far, return_index=True, return_inverse=True)
            new = left[head]
            self.parent[new], self.edge[new] = at[new], far[head]
            at[left] = new[own]
            left = left[at[left] != left]
        self.links = tuple(np.concatenate(x) for x in zip(*links)) if links else (np.empty(0, np.int64),) * 2
        key = self.parent * 129 + self.edge
        self.child = np.argsort(key, kind="stable")
        self.child = self.child[self.parent[self.child] >= 0]
        self.key = key[self.child]

    def search(self, queries: np.ndarray, tree: np.ndarray, grouped: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays (index of query, index of value) of pairs within the radius, each query in its tree.

        grouped leaves out values that are linked to a value of the result: for groups they aren't needed.
        """
        names, own = np.unique(tree, return_inverse=True)
        stack = [(np.arange(len(queries)), np.array([self.root[t] for t in names.tolist()], np.int64)[own])] if len(queries) else []
        r = self.radius
        while stack:
            q, node = stack.pop()
            if len(q) > STEP:
                stack.append((q[STEP:], node[STEP:]))
                q, node = q[:STEP], node[:STEP]
            far = _apart(queries[q], self.values[node]).astype(np.int64)
            if (near := far <= r).any():
                yield q[near], node[near]
            low = np.where(near, r + 1, far - r) if grouped else np.maximum(far - r, 1)
            begin = np.searchsorted(self.key, node * 129 + low)
            count = np.maximum(np.searchsorted(self.key, node * 129 + np.minimum(far + r, 128), "right") - begin, 0)
            if total := int(count.sum()):
                at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
                stack.append((np.repeat(q, count), self.child[at]))


class Scheme(NamedTuple):
    blocks: tuple[tuple[int, int], ...]  # (first bit, width)
    members: int  # a member enters its value's shard and those so many places away
    visits: int  # and visits those so many further places away


def scheme(total: int, n: int, members: int = MEMBERS) -> Scheme:
    """The blocks for n fingerprints: the narrowest whose shards have at most ``members`` on average.

    They end at two places a block: beyond, a fingerprint would be in thousands of shards.
    """
    for apart in range(1, total + 2):
        count = max(4, total // (apart + 1) + 1)
        each, more = divmod(128, count)
        widths = [each + (i < more) for i in range(count)]
        left = total // count
        found = Scheme(tuple((sum(widths[:i]), w) for i, w in enumerate(widths)), left // 2, left % 2)
        if count == 4 or left == 2 or n * sum(len(_masks(each, k)) for k in range(left // 2 + 1)) <= members << each:
            return found
    return found


def _masks(width: int, k: int) -> np.ndarray:
    """All numbers of that width with k bits set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), k)], np.int64)


def _block(hi: np.ndarray, lo: np.ndarray, first: int, width: int) -> np.ndarray:
    u, last = np.uint64, first + width
    if last <= 64:
        value = hi >> u(64 - last)
    elif first >= 64:
        value = lo >> u(128 - last)
    else:
        value = hi << u(last - 64) | lo >> u(128 - last)
    return (value & u((1 << width) - 1)).astype(np.int64)


def _keys(plan: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = {w: [_masks(w, k) for k in range(plan.members + plan.visits + 1)] for _, w in plan.blocks}
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                hi, lo = (batch.column(c).slice(start, 2000).to_numpy() for c in ("hi", "lo"))
                parts = []
                for i, (first, width) in enumerate(plan.blocks):
                    v = _block(hi.view(np.uint64), lo.view(np.uint64), first, width)
                    for k, own in enumerate(masks[width]):
                        if (plan.members, plan.visits, k) == (0, 1, 1):  # of two values a place apart, the one with the 0 visits
                            at, m = np.nonzero(v[:, None] & own == 0)
                        else:
                            at, m = np.repeat(np.arange(len(v)), len(own)), np.tile(np.arange(len(own)), len(v))
                        parts.append(((v[at] ^ own[m]) + (i << 32), np.full(len(at), k > plan.members), at))
                key, visits, at = (np.concatenate(c) for c in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(visits), pa.array(hi[at]), pa.array(lo[at])], names=["shard", "visits", "hi", "lo"])

    return run


def partnered(shard: np.ndarray, visits: np.ndarray, values: np.ndarray, total: int) -> np.ndarray:
    """Whether a row may have a partner: false only if no member of its shard is within the radius, or, of a member, no row.

    Rows lie shard by shard, members first.  A pair is looked at by the two halves' exclusive or, whose places differ no
    more often than the fingerprints do.  Shards of few pairs go to their trees as they are, and those of too many, too.
    """
    first = np.nonzero(np.r_[True, shard[1:] != shard[:-1]])[0] if len(shard) else np.empty(0, np.int64)
    count = np.diff(np.r_[first, len(shard)])
    members = np.add.reduceat(~visits, first, dtype=np.int64) if len(shard) else first
    pairs = members * count
    some = (members > 0) & (count > 1)
    out = np.repeat(some & ((pairs < FEW_PAIRS) | (pairs > MOST_PAIRS)), count)
    folded = values[:, 0] ^ values[:, 1]
    for i in np.nonzero(some & (pairs >= FEW_PAIRS) & (pairs <= MOST_PAIRS))[0].tolist():
        low, last, end = int(first[i]), int(first[i] + members[i]), int(first[i] + count[i])
        for v0 in range(low, last, SIDE):
            v1 = min(v0 + SIDE, last)
            step = TILE // (v1 - v0)
            for q0 in range(v0, end, step):
                q1 = min(q0 + step, end)
                to = min(v1, q1)  # a pair of members is looked at once
                near = np.bitwise_count(folded[q0:q1, None] ^ folded[v0:to]) <= total
                at = np.flatnonzero(near)
                if len(at) > near.size // 8:  # a family
                    out[q0:q1] |= near.any(1)
                    out[v0:to] |= near.any(0)
                    continue
                q, v = np.divmod(at, to - v0)
                q, v = q + q0, v + v0
                q, v = q[q > v], v[q > v]
                if len(q):
                    near = _apart(values[q], values[v]) <= total
                    out[q[near]] = out[v[near]] = True
    return out


def shard_links(shard: np.ndarray, visits: np.ndarray, values: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, within the radius, that connect just what all such pairs of a member and a row of its shard connect."""
    use = np.argsort(shard * 2 + visits, kind="stable")  # shard by shard, members first
    use = use[partnered(shard[use], visits[use], values[use], total)]
    shard, visits, values = shard[use], visits[use], values[use]
    at = np.nonzero(~visits)[0]
    if not len(at):
        return at, at
    forest = BKForest(values[at], shard[at], total)
    a, b = [at[forest.links[0]]], [at[forest.links[1]]]
    for q, v in forest.search(values, shard):
        v = at[v]
        a.append(q[q != v])
        b.append(v[q != v])
    return use[np.concatenate(a)], use[np.concatenate(b)]


def _search(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[tuple] = []  # from the shard on that the last batch ended in
        names = ["a_hi", "a_lo", "b_hi", "b_lo"]

        def found(parts: list[tuple]):
            shard, visits, hi, lo = (np.concatenate(c) for c in zip(*parts))
            a, b = shard_links(shard, visits, np.stack([hi, lo], 1).view(np.uint64), total)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(np.stack([hi[a], lo[a], hi[b], lo[b]], 1), axis=0).T], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "visits", "hi", "lo"))
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if cut or left and left[-1][0][-1] != now[0][0]:
                yield from found([*left, tuple(x[:cut] for x in now)])
                left = []
            left.append(tuple(x[cut:] for x in now))
        if left:
            yield from found(left)

    return run


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, label): the least node that each node of edges(a, b) is connected with.

    Alternating large and small stars; each round is a table in the shared folder, so none depends on what
    an executor holds.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), name)
    seen = None
    while True:
        both = now.select("a", "b").union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # v < u throughout: the small star of u joins its lesser neighbours to the least one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("m").alias("m")), F.struct(F.col("v").alias("x"), F.col("m").alias("m")))).alias("e"))
            .select(F.col("e.m").alias("a"), F.col("e.x").alias("b"))
            .where("a <> b")
            .distinct()
        )
        before, now = now, written(small, name)
        discard(before)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen == state:
            break
        seen = state
    stars = now.groupBy("b").agg(F.min("a").alias("label")).select(F.col("b").alias("node"), "label")
    return stars.union(stars.select(F.col("label").alias("node"), "label").distinct())


def fingerprint_links(distinct: DataFrame, total: int, plan: Scheme) -> DataFrame:
    """(a_hi, a_lo, b_hi, b_lo): pairs within total places that connect what all such pairs of distinct(hi, lo) connect."""
    shards = (
        distinct.select("hi", "lo")
        .mapInArrow(_keys(plan), "shard long, visits boolean, hi long, lo long")
        .repartition("shard")
        .sortWithinPartitions("shard")
    )
    return shards.mapInArrow(_search(total), "a_hi long, a_lo long, b_hi long, b_lo long")


def _grouped(rows: DataFrame, total: int) -> tuple[DataFrame, DataFrame, float]:
    """From rows(uid, row_key, doc_id, hi, lo), a table that is written: the groups, the fingerprints with theirs, and hot().

    Groups: (label, group_id, group_size, kept), kept the uid of the row that stays.
    """
    first = F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "row_key", "uid")).alias("first")
    # a row for each distinct fingerprint, with a number: all that follows is of one row for each
    prints = written(
        rows.where("hi IS NOT NULL").groupBy("hi", "lo").agg(F.count("*").alias("n_rows"), first).withColumn("node", F.monotonically_increasing_id()), "fingerprints"
    )
    n, n_rows = prints.agg(F.count("*"), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    links = fingerprint_links(prints, total, scheme(total, n))
    number = lambda side: prints.select(F.col("hi").alias(f"{side}_hi"), F.col("lo").alias(f"{side}_lo"), F.col("node").alias(side))
    labels = components(links.join(number("a"), ["a_hi", "a_lo"]).join(number("b"), ["b_hi", "b_lo"]).select("a", "b"))
    labelled = prints.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups_ = written(
        labelled.groupBy("label").agg(F.sum("n_rows").alias("group_size"), F.min("first").alias("first")).select("label", F.col("first.doc_id").alias("group_id"), "group_size", F.col("first.uid").alias("kept")), "groups"
    )
    return groups_, labelled.select("hi", "lo", "n_rows", "label"), n_rows * HOT


def groups(docs: DataFrame, total: int = TOTAL) -> DataFrame:
    """One row for each row of docs: row_key, doc_id, group_id, group_size, is_kept.

    group_id is the least doc_id of the group; the row with that stays (is_kept), of several such rows the
    one whose row_key is least, and of rows alike in all columns any one.  A text that is null, empty or
    without a letter or digit has no fingerprint: such a row is a group of its own and stays.  A null
    doc_id comes last.  Whole texts count, however long.  An empty table has an empty result.  Columns beside
    doc_id and text only count towards row_key, whatever their names and types.
    """
    rows = written(
        docs.select(row_hash(docs).alias("row_key"), docs["doc_id"].cast("long").alias("doc_id"), fingerprints(docs["text"].cast("string")).alias("fp")).select(
            F.monotonically_increasing_id().alias("uid"), "row_key", "doc_id", "fp.hi", "fp.lo"
        ),
        "prints",
    )
    of_groups, of_prints, most = _grouped(rows, total)
    each = written(of_prints.join(of_groups, "label").drop("label"), "grouped")
    hot = F.broadcast(each.where(F.col("n_rows") > most))  # at most 1 / HOT rows
    found = rows.join(hot, ["hi", "lo"]).unionByName(rows.join(hot.select("hi", "lo"), ["hi", "lo"], "left_anti").join(each.where(F.col("n_rows") <= most), ["hi", "lo"]))
    alone = rows.where("hi IS NULL").select("row_key", "doc_id", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("is_kept"))
    return found.select("row_key", "doc_id", "group_id", "group_size", (F.col("uid") == F.col("kept")).alias("is_kept")).union(alone)


def deduplicated(docs: DataFrame, total: int = TOTAL) -> DataFrame:
    """docs without all but one document of each group, its columns as they are.  See groups()."""
    rows = written(
        docs.select(row_of(docs).alias("row"), row_hash(docs).alias("row_key"), docs["doc_id"].cast("long").alias("doc_id"), fingerprints(docs["text"].cast("string")).alias("fp")).select(
            F.monotonically_increasing_id().alias("uid"), "row", "row_key", "doc_id", "fp.hi", "fp.lo"
        ),
        "rows",
    )
    of_groups, _, _ = _grouped(rows.drop("row"), total)
    # a row's number is its own, so no key of this join is hot; a small table is joined as a large one is
    return rows.where("hi IS NOT NULL").join(of_groups.select(F.col("kept").alias("uid")).hint("merge"), "uid").select("row.*").union(rows.where("hi IS NULL").select("row.*"))


def op10_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).drop("row_key")


ORACLE = rf"""
WITH RECURSIVE w AS (
  SELECT DISTINCT doc_id, md5(x) AS h FROM (
    SELECT doc_id, regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]', '', 'g') AS x
    FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '{SPACES}')) AS t FROM documents))
  WHERE x <> ''),
b AS (SELECT doc_id, ('0x' || substr(h, 1, 16))::UBIGINT AS hi, ('0x' || substr(h, 17, 16))::UBIGINT AS lo FROM w),
s AS (
  SELECT doc_id, i, 2 * sum(((hi >> i) & 1::UBIGINT)::BIGINT) > count(*) AS hi, 2 * sum(((lo >> i) & 1::UBIGINT)::BIGINT) > count(*) AS lo
  FROM b, (SELECT unnest(range(64))::UBIGINT AS i) GROUP BY doc_id, i),
fp AS (
  SELECT doc_id, bit_or(CASE WHEN hi THEN ('1' || repeat('0', i::INT))::BIT::UBIGINT ELSE 0::UBIGINT END) AS hi,
         bit_or(CASE WHEN lo THEN ('1' || repeat('0', i::INT))::BIT::UBIGINT ELSE 0::UBIGINT END) AS lo
  FROM s GROUP BY doc_id),
near AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM fp a, fp b
  WHERE bit_count(xor(a.hi, b.hi)::BIT) + bit_count(xor(a.lo, b.lo)::BIT) <= {TOTAL}),
cc(id, label) AS (
  SELECT doc_id, doc_id FROM fp
  UNION
  SELECT near.b, cc.label FROM cc JOIN near ON near.a = cc.id WHERE cc.label < near.b),
g AS (SELECT d.doc_id, coalesce(min(label), d.doc_id) AS group_id FROM documents d LEFT JOIN cc ON cc.id = d.doc_id GROUP BY d.doc_id)
SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size, doc_id = group_id AS is_kept FROM g
"""
