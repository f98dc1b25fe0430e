"""Token ids in training order, as fixed-stride binary shards.

Every document is cut into sequences of ``seq_len`` token ids, which are numbered 0 .. N-1 in the order of the
input's files, their rows and their sequences: the same numbers however the files are split into tasks.
A keyed Feistel network over the least even number of bits that holds N permutes the numbers, walking its
cycle until it is below N again: that is the sequence's global slot.  Slot s is row s % shard_rows of shard
s // shard_rows; shards are range partitions of the slots, their rows in order, each of the same number of
bytes, so a reader seeks to any slot and reads on from there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .tokens import END, VOCABULARY, encoder

SEQ_LEN, SHARD_ROWS, SEED, ROUNDS = 512, 8192, 20240917, 4
#: rows of the table of runs, one for each stretch of a file that a task reads, up to which it is broadcast
MOST_BROADCAST = 200_000


def _round(x: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) & mask


def permuted(numbers: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """The slots of numbers (each below n): a bijection of range(n) that the seed chooses."""
    if n < 2:
        return np.array(numbers, np.int64)
    half = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = np.random.SeedSequence(seed).generate_state(rounds, np.uint64)
    out = np.array(numbers, np.uint64)
    left = np.arange(len(out))
    while len(left):
        x = out[left]
        a, b = x >> half, x & mask
        for key in keys:
            a, b = b, a ^ _round(b, int(key), mask)
        x = (a << half) | b
        out[left] = x
        left = left[x >= np.uint64(n)]
    return out.astype(np.int64)


def _sequences(path: str, seq_len: int):
    """Sequences with the run that they are of and their number in it: a run is rows of a file one behind the other, in one task."""
    names = ["doc_id", "seq", "n_tokens", "tokens", "file", "first_row", "number"]
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, stride = encoder(path), 2 * seq_len
        own, before, number = (None, 0), None, 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                rows = []
                for doc_id, text, file, row in zip(*(c.to_pylist() for c in batch.slice(i, 1000).columns)):
                    if (file, row - 1) != before:
                        own, number = (file, row), 0
                    before = (file, row)
                    data = ids(text or "")
                    for k in range(0, len(data), stride):
                        rows.append((doc_id, k // stride, (min(len(data), k + stride) - k) // 2, data[k : k + stride], *own, number))
                        number += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, text, file, row of docs: where each row is in the files that docs is read from.

    What isn't read from files is written first, in the order of a hash of doc_id and text; rows alike in both are alike here.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    if "_metadata" not in docs.columns:
        try:
            return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *place)
        except AnalysisException:  # not a table of files
            pass
    key = F.xxhash64("doc_id", "text")
    return written(rows.repartitionByRange(key, "doc_id").sortWithinPartitions(key, "doc_id", "text"), "ordered").select("doc_id", "text", *place)


def slot(number: Column, n: int, seed: int) -> Column:
    return F.arrow_udf(lambda x: pa.array(permuted(x.to_numpy(zero_copy_only=False), n, seed)), "long")(number)


def _ordered(docs: DataFrame, vocabulary: str, seq_len: int, shard_rows: int, seed: int) -> tuple[DataFrame, int]:
    cut = _placed(docs).mapInArrow(_sequences(vocabulary, seq_len), "doc_id long, seq int, n_tokens int, tokens binary, file string, first_row long, number long")
    made = written(cut, "sequences")  # ids are made once
    sizes = made.groupBy("file", "first_row").agg(F.count("*").alias("rows"))  # a row for each run
    n, runs = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).first()
    upto = Window.orderBy(F.length("file"), "file", "first_row").rowsBetween(Window.unboundedPreceding, 0)
    before = sizes.select("file", "first_row", (F.sum("rows").over(upto) - F.col("rows")).alias("before"))
    if runs <= MOST_BROADCAST:  # else the join sorts the tokens by run first
        before = F.broadcast(before)
    slots = made.join(before, ["file", "first_row"]).withColumn("slot", slot(F.col("before") + F.col("number"), n, seed))
    slots = slots.withColumn("shard", F.floor(F.col("slot") / shard_rows).cast("int"))
    # slots are dense, so equal ranges of them need no sample
    parts = max(1, -(-n // shard_rows))
    ordered = (
        slots.repartitionById(parts, F.col("shard"))
        .sortWithinPartitions("slot")
        .select(
            "shard",
            "slot",
            ((F.col("slot") % shard_rows) * (2 * seq_len)).alias("byte_offset"),
            "doc_id",
            "seq",
            "n_tokens",
            F.rpad("tokens", F.lit(2 * seq_len), F.lit(END.to_bytes(2, "little"))).alias("tokens"),
        )
    )
    return ordered, n


def training_order(docs: DataFrame, vocabulary: str = VOCABULARY, seq_len: int = SEQ_LEN, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """shard, slot, byte_offset (in the shard), doc_id, seq (from 0 in its document), n_tokens, tokens.

    tokens has 2 * seq_len bytes, little-endian uint16, filled up with END behind the n_tokens of the text.
    Partitions are ranges of slots in order.  Texts that are null or empty have no sequence, very long ones
    have many; repeated rows have sequences each; a null doc_id stays null; an empty table has an empty
    result; columns beside doc_id and text have no part.  Numbers follow the order of the input's files and
    rows, whatever the tasks; of a table that isn't read from files, an order of hashes of doc_id and text.  A
    filter before costs a run for each stretch that it leaves: write what is filtered first.
    """
    return _ordered(docs, vocabulary, seq_len, shard_rows, seed)[0]


SHARDS = "shard int, first_slot long, n_rows int, stride int, doc_ids array<long>, seqs array<int>, n_tokens array<int>, data binary"


def _assembled(seq_len: int):
    names = [f.split()[0] for f in SHARDS.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(own: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(own)
            lists = [rows[c].to_pylist() for c in ("doc_id", "seq", "n_tokens")]
            made = (own[0].column("shard")[0].as_py(), own[0].column("slot")[0].as_py(), rows.num_rows, 2 * seq_len, *lists, b"".join(rows["tokens"].to_pylist()))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made, types)], names=names)

        own: list[pa.RecordBatch] = []  # of one shard
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            for part in np.split(np.arange(len(shard)), np.nonzero(np.diff(shard))[0] + 1):
                if own and len(part) and own[0].column("shard")[0].as_py() != shard[part[0]]:
                    yield whole(own)
                    own = []
                if len(part):
                    own.append(batch.slice(int(part[0]), len(part)))
        if own:
            yield whole(own)

    return run


def shards(docs: DataFrame, vocabulary: str = VOCABULARY, seq_len: int = SEQ_LEN, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """SHARDS: a row for each shard, data its n_rows * stride bytes, the lists what each of its rows is.  See training_order()."""
    return training_order(docs, vocabulary, seq_len, shard_rows, seed).mapInArrow(_assembled(seq_len), SHARDS)


def _files(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return pyarrow.fs.FileSystem.from_uri(folder)


def write_shards(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, seq_len: int = SEQ_LEN, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """shards() as folder/shard-NNNNNN.bin: shard, n_rows, path, is_new.

    The files are written as the rows are computed; folder/manifest.json, which says how many sequences there
    are, at once.  folder is a path or URI that all executors see: local, or any file system of pyarrow.fs
    (hdfs, s3, gs).  A shard appears whole, by renaming.  One that is there with the very bytes it should have
    is left as it is, so a broken run is taken up where it ended; any other is replaced.
    """
    rows, n = _ordered(docs, vocabulary, seq_len, shard_rows, seed)
    fs, root = _files(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"n": n, "seq_len": seq_len, "shard_rows": shard_rows, "seed": seed}).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(folder)
        for batch in batches:
            for shard, n_rows, data in zip(*(c.to_pylist() for c in batch.columns)):
                path = f"{root}/shard-{shard:06d}.bin"
                info = fs.get_file_info(path)
                new = info.type != pyarrow.fs.FileType.File or info.size != len(data)
                if not new:
                    with fs.open_input_stream(path) as f:
                        new = f.read() != data
                if new:
                    part = f"{path}.{uuid.uuid4().hex}"
                    with fs.open_output_stream(part) as f:
                        f.write(data)
                    fs.move(part, path)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (np.int32(shard), np.int32(n_rows), path, new)], names=["shard", "n_rows", "path", "is_new"])

    made = rows.mapInArrow(_assembled(seq_len), SHARDS).select("shard", "n_rows", "data")
    return made.mapInArrow(run, "shard int, n_rows int, path string, is_new boolean")


def read_from(folder: str, slot: int) -> Iterator[np.ndarray]:
    """The sequences from a slot on, in training order."""
    fs, root = _files(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        about = json.loads(f.read())
    stride, rows = 2 * about["seq_len"], about["shard_rows"]
    while slot < about["n"]:
        shard, row = divmod(slot, rows)
        with fs.open_input_file(f"{root}/shard-{shard:06d}.bin") as f:
            f.seek(row * stride)
            while len(data := f.read(stride)) == stride:
                yield np.frombuffer(data, "<u2")
        slot = (shard + 1) * rows


def op6_training_order_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards themselves, so that they go where the result goes."""
    return shards(table(spark, sf_dir, "documents"))
