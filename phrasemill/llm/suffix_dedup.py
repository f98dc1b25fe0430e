"""Passages that repeat across documents: a distributed suffix array by bucket-pointer refinement.

A suffix starts at each word.  Suffixes that agree in their first ``min_words`` words are brought together first: a
suffix goes to the bucket of the least q-gram hash among the q-grams of those words.  That is a function of
the words alone, and neighbouring suffixes mostly share it: they travel as one run of words, and runs alike in all
words as one row with their places, so a text that is copied often isn't sent as often.

Within a task the runs' suffixes are sorted by bucket-pointer refinement (``pointers``): q-grams give the first
buckets; each bucket that still has several suffixes is sorted by the pointers of the suffixes a bucket's
depth further on, which gives its parts pointers of their own, and those updated pointers are what the next
sorting reads, so the depth doubles.  It ends at ``min_words``, as only passages of that length matter.
Words are compared one by one throughout, as 32-bit hashes.  A bucket that has suffixes of two documents is a
repeat.  All suffixes of all documents take part.

A first bucket may be as large as a passage is frequent.  Those of ``HOT`` suffixes and more, as estimated from a
sample of the documents, are split over tasks, and a bucket that turns out to exceed ``STEP`` words goes through its
task in parts: what neither can settle, which windows another part has too, is settled by a grouped count of the
windows' 128-bit hashes.  The estimate decides where windows are compared, not which are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, Known, kept, table, written

MIN_WORDS, Q = 50, 8
NONE = np.iinfo(np.int64).max
#: words that a task sorts at once
STEP = 1 << 20
#: suffixes from which a first bucket is split; the share of documents that the estimate rests on; hot buckets at most
HOT, SAMPLED, MOST_HOT = 1_000_000, 1 / 32, 2000


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def _doubled(a: np.ndarray, length: int, join) -> np.ndarray:
    """join over a[p : p + length] for each p, from halves of equal length that may overlap at last."""
    k = 1
    while 2 * k <= length:
        a, k = join(a[:-k], a[k:]), 2 * k
    return join(a[: -(length - k)], a[length - k :]) if length > k else a


def buckets(words: np.ndarray, min_words: int, q: int) -> np.ndarray:
    """The bucket of the suffix at each word, while min_words are left."""
    return _doubled(_doubled(words, q, _pair), min_words - q + 1, np.minimum)


def pointers(words: np.ndarray, room: np.ndarray, q: int, depth: int) -> np.ndarray:
    """Bucket pointers of the suffixes at each word: equal just where the first ``depth`` words are.

    room is the number of words from there to the end of the run; only suffixes with room for depth words have
    their pointer refined to it.  A suffix alone in its bucket isn't sorted any more.
    """
    ptr = np.unique(words, return_inverse=True)[1].astype(np.int64)
    named, d, open_ = int(ptr.max(initial=-1)) + 1, 1, np.ones(len(ptr), bool)
    while d < depth:
        new = min(2 * d, q if d < q else depth)
        at = np.nonzero(open_ & (room >= new))[0]
        _, own, count = np.unique(ptr[at] * named + ptr[at + new - d], return_inverse=True, return_counts=True)
        ptr[at] = named + own
        open_[at] = count[own] > 1
        # numbers stay small enough for two of them to be one key
        named, d = named + len(count), new
        if named > 1 << 31:
            ptr = np.unique(ptr, return_inverse=True)[1].astype(np.int64)
            named = int(ptr.max(initial=-1)) + 1
    return ptr


def _texts(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[tuple[list, list, list[np.ndarray]]]:
    """(keys, ids, words) of some documents at once, those of min_words and more."""
    hashes = kept("suffix-words", lambda: Known(lambda w: xxhash.xxh3_64_intdigest(w) & 0xFFFFFFFF))
    keys, ids, docs, size = [], [], [], 0
    for batch in batches:
        for key, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
            words = (text.as_py() or b"").split()
            if len(words) < min_words:
                continue
            keys.append(key)
            ids.append(doc_id)
            docs.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
            size += len(words)
            if size > 500_000:
                yield keys, ids, docs
                keys, ids, docs, size = [], [], [], 0
    if docs:
        yield keys, ids, docs


def _placed(docs: list[np.ndarray], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words, and for each suffix with min_words its document, its place there and among all words."""
    lengths = np.array([len(d) for d in docs])
    own = lengths - min_words + 1
    doc = np.repeat(np.arange(len(docs)), own)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(own) - own, own)
    return np.concatenate(docs), doc, start, (np.cumsum(lengths) - lengths)[doc] + start


def _sizes(min_words: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, docs in _texts(batches, min_words):
            words, _, _, at = _placed(docs, min_words)
            bucket, n = np.unique(buckets(words, min_words, q)[at].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n)], names=["bucket", "n"])

    return run


def _runs(min_words: int, q: int, hot: dict[int, int]):
    """hot: into how many parts a bucket is split."""
    names = ["bucket", "is_part", "words", "places"]

    def rows(keys: list, ids: list, docs: list[np.ndarray]) -> pa.RecordBatch:
        words, doc, start, at = _placed(docs, min_words)
        bucket = buckets(words, min_words, q)[at]
        cut = np.r_[True, (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])].nonzero()[0]
        # a run that goes on and on, as in a text of one word, is cut
        long = np.diff(np.r_[cut, len(doc)])
        inner = np.arange(len(doc)) - np.repeat(cut, long)
        cut = (inner % min_words == 0).nonzero()[0]
        end = np.r_[cut[1:], len(doc)] - 1
        data = words.astype("<u4").tobytes()
        alike: dict[bytes, list[int]] = {}
        for j, (b, e) in enumerate(zip((4 * at[cut]).tolist(), (4 * (at[end] + min_words)).tolist())):
            alike.setdefault(data[b:e], []).append(j)
        places = np.stack([np.array(keys, np.int64)[doc[cut]], np.array([NONE if i is None else i for i in ids], np.int64)[doc[cut]], start[cut]], 1)
        sizes = np.array([len(x) for x in alike.values()])
        order = np.fromiter((j for x in alike.values() for j in x), np.int64, len(cut))
        offsets = (24 * np.r_[0, np.cumsum(sizes)]).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(places[order]))])
        first = order[offsets[:-1] // 24]
        own = bucket[cut[first]].view(np.int64)
        parts = np.array([hot.get(b, 0) for b in own.tolist()], np.int64) if hot else np.zeros(len(own), np.int64)
        part = _pair(own.view(np.uint64), (places[first, 0] % np.maximum(parts, 1)).astype(np.uint64) + np.uint64(1)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.where(parts > 0, part, own)), pa.array(parts > 0), pa.array(list(alike), pa.binary()), packed], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, docs in _texts(batches, min_words):
            yield rows(keys, ids, docs)

    return run


def _repeats(min_words: int, q: int, within: bool, step: int):
    """From runs sorted by bucket, the stretches of suffixes that another document (or place) has too.

    Of a part of a bucket each suffix, with its window's hash: it isn't known yet what the other parts have.
    """
    names = ["doc_key", "doc_id", "start", "last", "first_doc_id", "w1", "w2"]
    length = lambda a, unit: pc.binary_length(a).to_numpy(zero_copy_only=False).astype(np.int64) // unit

    def expanded(place: np.ndarray, begin: np.ndarray, times: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of row all its places: the places, and which of row each is of."""
        n = times[row]
        of = np.repeat(np.arange(len(row)), n)
        return place[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[row], n)], of

    def found(parts: list[pa.RecordBatch], is_part: bool) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(parts).combine_chunks()
        bucket, times = rows["bucket"].to_numpy(), length(rows["places"].combine_chunks(), 24)
        # a bucket of one run in one place has nothing to share, unless the run repeats itself
        _, own = np.unique(bucket, return_inverse=True)
        use = np.nonzero((np.bincount(own, times)[own] > 1) | within | is_part)[0]
        if not len(use):
            return None
        rows, times = rows.take(pa.array(use)), times[use]
        packed = rows["words"].combine_chunks()
        size = length(packed, 4)
        words = np.frombuffer(b"".join(packed.to_pylist()), "<u4")
        room = np.repeat(np.cumsum(size), size) - np.arange(len(words))
        at = np.nonzero(room >= min_words)[0]
        own = size - min_words + 1
        row = np.repeat(np.arange(len(size)), own)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
        place = np.frombuffer(b"".join(rows["places"].combine_chunks().to_pylist()), np.int64).reshape(-1, 3)
        begin = np.cumsum(times) - times
        if is_part:
            p, of = expanded(place, begin, times, row)
            w1, w2 = (_doubled(words.astype(np.uint64) + np.uint64(seed), min_words, _pair)[at].view(np.int64)[of] for seed in (1, 1 << 40))
            none = pa.nulls(len(p), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), *[pa.array(p[:, 2] + inner[of])] * 2, none, pa.array(w1), pa.array(w2)], names=names)
        ptr = pointers(words, room, q, min_words)
        lows, highs, ids = np.minimum.reduceat(place[:, 0], begin), np.maximum.reduceat(place[:, 0], begin), np.minimum.reduceat(place[:, 1], begin)
        order = np.argsort(ptr[at], kind="stable")
        sorted_, r = ptr[at][order], row[order]
        cut = np.r_[True, sorted_[1:] != sorted_[:-1]].nonzero()[0]
        shared = np.add.reduceat(times[r], cut) > 1 if within else np.minimum.reduceat(lows[r], cut) != np.maximum.reduceat(highs[r], cut)
        if not shared.any():
            return None
        each = np.diff(np.r_[cut, len(order)])
        is_shared, first = np.empty(len(order), bool), np.empty(len(order), np.int64)
        is_shared[order], first[order] = np.repeat(shared, each), np.repeat(np.minimum.reduceat(ids[r], cut), each)
        begins = is_shared & np.r_[True, ~is_shared[:-1] | (row[1:] != row[:-1])]
        ends = is_shared & np.r_[~is_shared[1:] | (row[1:] != row[:-1]), True]
        b, e = begins.nonzero()[0], ends.nonzero()[0]
        least = np.minimum.reduceat(np.where(is_shared, first, NONE), b)
        p, stretch = expanded(place, begin, times, row[b])
        none = pa.nulls(len(p), pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in (p[:, 0], p[:, 1], p[:, 2] + inner[b][stretch], p[:, 2] + inner[e][stretch], least[stretch])), none, none], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []  # what the last bucket is in, which may go on, is in slices of its own
        held, open_, in_parts = 0, None, False  # that bucket; whether a part of it is out already

        def settle(is_part: bool) -> Iterator[pa.RecordBatch]:
            nonlocal left, held
            if left and (out := found(left, is_part)) is not None:
                yield out
            left, held = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, is_part = batch.column("bucket").to_numpy(), batch.column("is_part").to_numpy(zero_copy_only=False)
            # at the last bucket, where parts begin and end, and behind the bucket that was open
            cuts = {0, int(np.searchsorted(bucket, bucket[-1])), int(np.searchsorted(bucket, open_, "right")) if open_ is not None else 0, *(np.nonzero(is_part[1:] != is_part[:-1])[0] + 1).tolist()}
            edges = sorted(c for c in cuts if c < batch.num_rows) + [batch.num_rows]
            for i, j in zip(edges, edges[1:]):
                now, first, last = batch.slice(i, j - i), int(bucket[i]), int(bucket[j - 1])
                if is_part[i]:
                    if (out := found([now], True)) is not None:
                        yield out
                    continue
                if left and first != open_ and (in_parts or held >= step):
                    yield from settle(in_parts)
                    in_parts = False
                elif left and held >= step:  # of the open bucket there may be more than a task sorts at once
                    at = next(k for k, b in enumerate(left) if int(b.column("bucket")[0].as_py()) == open_)
                    mine, left = left[at:], left[:at]
                    yield from settle(False)
                    left, held = mine, sum(int(length(b.column("words"), 4).sum()) for b in mine)
                    if in_parts or held >= step:
                        yield from settle(True)
                        in_parts = True
                if first != open_:
                    in_parts = False
                open_ = last
                left.append(now)
                held += int(length(now.column("words"), 4).sum())
        yield from settle(in_parts)

    return run


def _hot(docs: DataFrame, min_words: int, q: int, hot: int, sampled: float) -> dict[int, int]:
    """Into how many parts to split the buckets of an estimated hot suffixes or more, the MOST_HOT largest of them.

    Any others go through their task in parts, too (``step``): only the time that one task takes is at stake.
    """
    sizes = docs.sample(fraction=sampled, seed=1).mapInArrow(_sizes(min_words, q), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    most = sizes.where(F.col("n") >= hot * sampled).orderBy(F.col("n").desc(), "bucket").limit(MOST_HOT).collect()
    return {r.bucket: max(2, int(np.ceil(r.n / (hot * sampled)))) for r in most}


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, q: int = Q, within: bool = False, hot: int = HOT, sampled: float = SAMPLED, step: int = STEP) -> DataFrame:
    """Maximal spans of words all of whose ``min_words``-word windows, overlapping, another document has too.

    Columns: doc_id, first_word, end_word (exclusive; words are what white space separates, from 0),
    n_words, first_doc_id (the least doc_id that has one of the span's windows: where it is doc_id itself,
    the span is the passage's first occurrence).  With within, another place in the same document will do.
    A document is a distinct (doc_id, text): repeated rows are one document with one result, and two texts
    under one doc_id, or under a null one, are two documents.  Documents tie for first only under one doc_id.
    Texts that are null, empty or of fewer words than min_words have no span; very long ones have all of
    theirs; an empty table has an empty result; columns beside doc_id and text have no part.
    """
    if not 1 <= q <= min_words:
        raise ValueError("q must be from 1 to min_words")
    text, doc_id = docs["text"].cast("string"), docs["doc_id"].cast("long")
    keyed = docs.select(F.xxhash64(doc_id, F.isnull(doc_id), text).alias("doc_key"), doc_id.alias("doc_id"), text.alias("text"))
    if within:  # else a repeated row would be a second place
        keyed = keyed.dropDuplicates(["doc_key"])
    made = (
        keyed.mapInArrow(_runs(min_words, q, _hot(keyed, min_words, q, hot, sampled)), "bucket long, is_part boolean, words binary, places binary")
        .repartition("bucket")
        .sortWithinPartitions("bucket", "is_part")
        .mapInArrow(_repeats(min_words, q, within, step), "doc_key long, doc_id long, start long, last long, first_doc_id long, w1 long, w2 long")
    )
    found = written(made, "repeats")
    parts = found.where("w1 IS NOT NULL")
    is_shared = F.col("n") > 1 if within else F.col("low") != F.col("high")
    windows = parts.groupBy("w1", "w2").agg(F.min("doc_key").alias("low"), F.max("doc_key").alias("high"), F.count("*").alias("n"), F.min("doc_id").alias("first")).where(is_shared)
    settled = parts.join(windows.select("w1", "w2", "first"), ["w1", "w2"]).select("doc_key", "doc_id", "start", "last", F.col("first").alias("first_doc_id"))
    runs = found.where("w1 IS NULL").select("doc_key", "doc_id", "start", "last", "first_doc_id").union(settled)
    w = Window.partitionBy("doc_key", "doc_id").orderBy("start", "last")
    end = F.col("last") + min_words
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = lambda c: F.nullif(F.col(c), F.lit(int(NONE)))
    return (
        runs.select("*", F.when(F.col("start") <= before, 0).otherwise(1).alias("opens"))
        .select("*", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("span"))
        .groupBy("doc_key", "doc_id", "span")
        .agg(F.min("start").cast("long").alias("first_word"), F.max(end).cast("long").alias("end_word"), F.min("first_doc_id").alias("first_doc_id"))
        .select(own("doc_id").alias("doc_id"), "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), own("first_doc_id").alias("first_doc_id"))
    )


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{SPACES}'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, p, md5(array_to_string(w[p + 1 : p + {MIN_WORDS}], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(len(w) - {MIN_WORDS - 1})) AS p FROM d WHERE len(w) >= {MIN_WORDS})),
sh AS (SELECT h, min(doc_id) AS f FROM win GROUP BY h HAVING count(DISTINCT doc_id) > 1),
r AS (
  SELECT doc_id, p, f, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {MIN_WORDS} THEN 0 ELSE 1 END AS opens
  FROM win JOIN sh USING (h)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM r)
SELECT doc_id, min(p) AS first_word, max(p) + {MIN_WORDS} AS end_word, max(p) + {MIN_WORDS} - min(p) AS n_words, min(f) AS first_doc_id
FROM s GROUP BY doc_id, span
"""
