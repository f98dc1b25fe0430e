"""Packing by power-of-two decomposition.

A document of L tokens is cut into pieces whose lengths are powers of two and add up to L: as many as fit
of the longest, 2**MAX_LOG, then one for each set bit of the rest, longest first.  Pieces of one length
are a bucket, no piece has tokens of two documents, and a bucket's pieces are dealt into batches of
``batch_tokens`` tokens without padding: a task keeps a count for each bucket, so this moves nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import VOCABULARY, encoder

MAX_LOG, BATCH_TOKENS = 13, 1 << 16


def binary_lengths(n: int, max_log: int = MAX_LOG) -> list[int]:
    """Logarithms of the pieces' lengths, in the order of the text."""
    whole, rest = divmod(n, 1 << max_log)
    return [max_log] * whole + [i for i in reversed(range(max_log)) if rest >> i & 1]


def _pack(path: str, max_log: int, batch_tokens: int):
    names = ["doc_id", "piece", "bucket", "start", "n_tokens", "tokens", "batch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen = encoder(path), np.zeros(max_log + 1, np.int64)
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        each = np.maximum(1, batch_tokens >> np.arange(max_log + 1))  # pieces of a batch

        def made(rows: list[tuple], tokens: list[bytes]) -> pa.RecordBatch:
            doc_id, piece, log, start = zip(*rows)
            log = np.array(log, np.int32)
            length = np.left_shift(1, log)
            begin = np.cumsum(length) - length
            order = np.argsort(-log, kind="stable")  # bucket by bucket, the longest first
            n = np.bincount(log, minlength=max_log + 1)
            within = np.arange(len(log)) - np.repeat(np.cumsum(n[::-1]) - n[::-1], n[::-1])
            number = (seen[log[order]] + within) // each[log[order]]
            seen[:] += n
            own = length[order]
            offsets = np.r_[0, np.cumsum(own)].astype(np.int32)
            at = np.arange(offsets[-1]) + np.repeat(begin[order] - offsets[:-1], own)
            values = np.frombuffer(b"".join(tokens), "<u2").astype(np.int32)[at]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_id, pa.int64()).take(pa.array(order)),
                    pa.array(np.array(piece, np.int32)[order]),
                    pa.array(log[order]),
                    pa.array(np.array(start, np.int64)[order]),
                    pa.array(own),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                    pa.array((np.int64(task) << 40) + (log[order].astype(np.int64) << 34) + number),
                ],
                names=names,
            )

        for batch in batches:
            rows, tokens, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = ids(text.as_py() or "")
                tokens.append(own)
                held += len(own)
                at = 0
                for piece, log in enumerate(binary_lengths(len(own) // 2, max_log)):
                    rows.append((doc_id, piece, log, at))
                    at += 1 << log
                if held > 1_000_000:  # some hundreds of documents of ids, or one long one
                    yield made(rows, tokens)
                    rows, tokens, held = [], [], 0
            if rows:
                yield made(rows, tokens)

    return run


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, max_log: int = MAX_LOG, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """doc_id, piece (from 0), bucket (logarithm of the length), start (in the document's tokens), n_tokens, tokens, batch.

    A batch is pieces of one bucket, batch_tokens tokens of it (one piece at least); a task's last batch of a bucket
    may be shorter.  Which pieces share one depends on how the input is split into tasks, nothing else does.
    Texts that are null or empty have no piece; very long ones have many of the longest length.  Repeated rows
    are packed each; a null doc_id stays null; an empty table has an empty result; columns beside doc_id
    and text have no part.  A document's pieces, by ``piece``, are its tokens.
    """
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(
        _pack(vocabulary, max_log, batch_tokens), "doc_id long, piece int, bucket int, start long, n_tokens int, tokens array<int>, batch long"
    )


def op1_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def bucket_report(pieces: DataFrame) -> DataFrame:
    """Sequences, tokens and batches of each bucket."""
    return pieces.groupBy("bucket").agg(F.count("*").alias("sequences"), F.sum("n_tokens").alias("tokens"), F.countDistinct("batch").alias("batches"))
