"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

A source's documents, in seeded order, are one stream of tokens, cut into blocks of ``block_tokens``; the
last block of a source has what is left, so no word is without a block.  Of all blocks ``fraction`` are
seats.  They go one by one to the source with the highest quotient weight / (2 * seats + 1) that still has
a block.  Documents fall into shards of about ``shard_tokens`` tokens by a hash of their id, a block belongs
to the shard that it ends in, and a source's seats are spread over its shards in proportion to its blocks
there: integer quotas per shard, which are then filled with blocks in seeded order.  Seats are apportioned
over the whole corpus, so a source that is rare has its share however many shards there are.  Shards exchange
only their sources' token counts and the chosen ones of the blocks that they share, so a source that is most of
the corpus is as many groups as there are shards.  Tokens are words here: whatever ASCII white space separates.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bytes, row_hash, row_of, table, written

BLOCK_TOKENS, SHARD_TOKENS, FRACTION, SEED = 2048, 1 << 22, 0.6, 17
#: blocks that are sorted at once to give the last seats; the search for the least quotient goes on until so few are left
MOST_SORTED = 100_000
PIECE = r"[^ \t\n\r\x0B\f]+[ \t\n\r\x0B\f]*"


def _pieces(text: Column) -> Column:
    """The text's words with the white space behind each: joined again, the text from its first word on."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(PIECE), F.lit(0))


def word_counts(texts: pa.Array) -> np.ndarray:
    """How many words each text has; a null one has none."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    begins = ~((data == 32) | (data - np.uint8(9) < 5))  # ASCII white space
    first = offsets[:-1][np.diff(offsets) > 0]
    of_first = begins[first]
    begins[1:] &= ~begins[:-1]
    begins[first] = of_first
    return np.diff(np.searchsorted(np.flatnonzero(begins), offsets))


def _n_words(text: Column) -> Column:
    """The number of _pieces(), of which it makes none."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0, np.int64), *map(word_counts, by_bytes(texts))]))

    return F.arrow_udf(run, "long")(text.cast("string"))


def _seeded(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def _weight(weights: dict[str, float]) -> Column:
    """A source's weight; one that isn't named weighs 1."""
    out = F.lit(1.0)
    for name, x in sorted(weights.items()):
        out = F.when(F.col("source").eqNullSafe(name), F.lit(float(x))).otherwise(out)
    return out


def _above(bound: float) -> Column:
    """How many quotients weight / (2k + 1), k < n_blocks, are above the bound."""
    if bound <= 0:
        return F.col("n_blocks")
    over = lambda k: F.col("weight") / (2 * k + 1) > F.lit(bound)
    guess = F.least(F.col("n_blocks"), F.greatest(F.lit(0), F.floor((F.col("weight") / F.lit(bound) + 1) / 2))).cast("long")
    # the division is rounded: the guess may be one off
    return F.when((guess < F.col("n_blocks")) & over(guess), guess + 1).when((guess > 0) & ~over(guess - 1), guess - 1).otherwise(guess)


def quotas(totals: DataFrame, weights: dict[str, float], fraction: float, most_sorted: int = MOST_SORTED) -> DataFrame:
    """(source_key, n_blocks, quota) from totals(source_key, source, n_blocks), for the sources with weight and blocks.

    The seats are the blocks with the highest quotients.  A search over all sources at once closes in on the
    quotient of the last seat, 64 bounds a pass, so no task sorts the corpus' blocks; what lies between the
    last two bounds is sorted.  Equal quotients go to the source whose name is less.
    """
    own = written(totals.withColumn("weight", _weight(weights)).where("n_blocks > 0 AND weight > 0").select("source_key", "n_blocks", "weight"), "totals")
    every, most = totals.agg(F.coalesce(F.sum("n_blocks"), F.lit(0))).first()[0], own.agg(F.coalesce(F.sum("n_blocks"), F.lit(0)), F.max("weight")).first()
    n, heaviest = most
    seats = min(n, max(1, math.floor(fraction * every + 0.5)) if fraction > 0 else 0)
    if seats == n:
        return own.select("source_key", "n_blocks", F.col("n_blocks").alias("quota"))
    bits = lambda x: struct.unpack("<q", struct.pack("<d", x))[0]  # noqa: E731 - positive doubles are in the order of their bits
    low, high = (0, n), (bits(float(heaviest)), 0)  # bounds with the number of quotients above each: more than seats, at most seats
    while low[1] - high[1] > most_sorted and high[0] - low[0] > 1:
        step = max(1, (high[0] - low[0]) // 64)
        tried = list(range(low[0] + step, high[0], step))
        counts = own.agg(*(F.sum(_above(struct.unpack("<d", struct.pack("<q", b))[0])) for b in tried)).first()
        for at in zip(tried, counts):
            if at[1] > seats:
                low = max(low, at, key=lambda x: x[0])
            else:
                high = min(high, at, key=lambda x: x[0])
    least, greatest = (struct.unpack("<d", struct.pack("<q", x[0]))[0] for x in (low, high))
    sure = own.withColumn("sure", _above(greatest)).withColumn("open", _above(least))
    last = (
        sure.where("open > sure")
        .select("source_key", "weight", F.explode(F.expr("sequence(sure, open - 1)")).alias("k"))
        .orderBy((F.col("weight") / (2 * F.col("k") + 1)).desc(), "source_key")
        .limit(seats - high[1])
        .groupBy("source_key")
        .agg(F.count("*").alias("more"))
    )
    return sure.join(last, "source_key", "left").select("source_key", "n_blocks", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("quota"))


def _shard(n_shards: int) -> Column:
    return F.pmod(F.conv(F.substring("order", 1, 8), 16, 10).cast("long"), F.lit(n_shards))


def _streams(docs: DataFrame, keep: list[Column], n_shards: int, seed: int) -> DataFrame:
    doc_id = docs["doc_id"].cast("string")
    order = _seeded(seed, F.coalesce(doc_id, F.lit("")))
    return docs.select(
        *keep,
        docs["source"].cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit("")).alias("source_key"),
        order.alias("order"),
        docs["doc_id"].cast("long").alias("id"),
        F.xxhash64(docs["text"].cast("string")).alias("text_key"),
        _n_words(docs["text"]).alias("n"),
    ).where("n > 0").withColumn("shard", _shard(n_shards))


def supplies(counted: DataFrame, block_tokens: int) -> DataFrame:
    """(shard, source_key, source, begin, first_block, n_blocks, tail): where a shard's part of a source's stream
    begins, the blocks that end in it, and the block that it begins and a later shard ends, if there is one."""
    own = counted.groupBy("shard", "source_key").agg(F.first("source", ignorenulls=True).alias("source"), F.sum("n").alias("tokens"))
    # a source has as many rows here as there are shards
    w = Window.partitionBy("source_key").orderBy("shard")
    placed = own.withColumn("upto", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("last", F.lead("shard").over(w).isNull())
    return placed.selectExpr(
        "shard",
        "source_key",
        "source",
        "upto - tokens AS begin",
        f"(upto - tokens) div {block_tokens} AS first_block",
        f"(upto + IF(last, {block_tokens - 1}, 0)) div {block_tokens} - (upto - tokens) div {block_tokens} AS n_blocks",
        f"CASE WHEN NOT last AND upto % {block_tokens} > 0 THEN upto div {block_tokens} END AS tail",
    )


def chosen_blocks(counted: DataFrame, weights: dict[str, float], block_tokens: int, fraction: float, seed: int, most_sorted: int = MOST_SORTED) -> DataFrame:
    """(shard, source_key, begin, blocks, tail, tail_shard): the numbers of the blocks that fill the quotas.

    tail is the one of them that ends in a later shard, tail_shard, if there is one.
    """
    supply = written(supplies(counted, block_tokens), "supply")
    at = ["shard", "source_key"]
    totals = supply.groupBy("source_key").agg(F.first("source", ignorenulls=True).alias("source"), F.sum("n_blocks").alias("n_blocks"))
    seats = quotas(totals, weights, fraction, most_sorted).select("source_key", F.col("n_blocks").alias("total"), "quota")
    # a source's first b blocks have quota * b / total seats, rounded: the shards' quotas add up to the source's
    upto = lambda b: f"(CAST({b} AS DECIMAL(19, 0)) * CAST(quota AS DECIMAL(18, 0)) * 2 + total) div (2 * total)"
    picked = supply.where("n_blocks > 0").join(seats.where("quota > 0"), "source_key").withColumn("seats", F.expr(f"{upto('first_block + n_blocks')} - {upto('first_block')}"))
    key = _seeded(seed, F.col("shard").cast("string"), F.col("source_key"), F.col("b").cast("string"))
    chosen = (
        picked.where("seats > 0")
        .withColumn("b", F.explode(F.expr("sequence(first_block, first_block + n_blocks - 1)")))
        .withColumn("place", F.row_number().over(Window.partitionBy(*at).orderBy(key, "b")))
        .where("place <= seats")
        .select(*at, "begin", "b")
    )
    tails = supply.where("tail IS NOT NULL").select(*at, "begin", F.col("tail").alias("b")).join(chosen.select(F.col("shard").alias("tail_shard"), "source_key", "b"), ["source_key", "b"])
    # a list for each (shard, source): at most shard_tokens / block_tokens blocks, and two that it shares
    return (
        chosen.withColumn("tail_shard", F.lit(None).cast("long"))
        .unionByName(tails)
        .groupBy(*at)
        .agg(
            F.min("begin").alias("begin"),
            F.collect_set("b").alias("blocks"),
            F.max(F.when(F.col("tail_shard").isNotNull(), F.col("b"))).alias("tail"),
            F.max("tail_shard").alias("tail_shard"),
        )
    )


def parts_in(streams: DataFrame, lists: DataFrame, block_tokens: int, *ties: str) -> DataFrame:
    """streams with one row for each run of a shard's chosen blocks that a document is in: first_block, last_block, first_word, end_word.

    shard is the blocks' shard, which for the last block of a document's shard may be a later one.
    """
    w = Window.partitionBy("shard", "source_key").orderBy("order", "id", "text_key", *ties)
    placed = streams.withColumn("from", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    own = placed.join(lists, ["shard", "source_key"]).withColumn("from", F.col("from") + F.col("begin")).withColumn(
        "own", F.expr(f"filter(sequence(`from` div {block_tokens}, (`from` + n - 1) div {block_tokens}), b -> array_contains(blocks, b))")
    )
    runs = own.withColumn(
        "run",
        F.explode(F.arrays_zip(F.expr("filter(own, b -> NOT array_contains(own, b - 1) OR b <=> tail)").alias("s"), F.expr("filter(own, b -> NOT array_contains(own, b + 1) OR b + 1 <=> tail)").alias("e"))),
    )
    return runs.select(
        "*",
        F.col("run.s").alias("first_block"),
        F.col("run.e").alias("last_block"),
        F.greatest(F.lit(0).cast("long"), F.col("run.s") * block_tokens - F.col("from")).alias("first_word"),
        F.least(F.col("n"), (F.col("run.e") + 1) * block_tokens - F.col("from")).alias("end_word"),
    ).withColumn("shard", F.expr("CASE WHEN first_block <=> tail THEN tail_shard ELSE shard END")).drop("run", "own", "blocks", "begin", "tail", "tail_shard")


def _n_shards(tokens: int | None, shard_tokens: int) -> int:
    return max(1, math.ceil((tokens or 0) / shard_tokens))


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, fraction: float = FRACTION, seed: int = SEED
) -> DataFrame:
    """shard, source, first_block, last_block, doc_id, first_word, end_word: the parts of documents in chosen blocks.

    A source that weights doesn't name, a null one too, weighs 1.  Seats are fraction of all blocks, rounded, one
    at least if the fraction is above 0.  Texts that are null, empty or without a word have no token and no
    part; very long ones are in many blocks, and have a part for each run of chosen ones.  Repeated rows are
    so many documents; a null doc_id sorts first.  Equal quotients go to the source whose name is less.
    An empty table has an empty result; columns beside doc_id, text and source have no part.
    """
    counted = written(_streams(docs, [], 1, seed).drop("shard"), "counted")
    n_shards = _n_shards(counted.agg(F.sum("n")).first()[0], shard_tokens)
    streams = counted.withColumn("shard", _shard(n_shards))
    lists = chosen_blocks(streams, weights or {}, block_tokens, fraction, seed)
    return parts_in(streams, lists, block_tokens).select(
        "shard", "source", "first_block", "last_block", F.col("id").alias("doc_id"), "first_word", "end_word"
    )


def mixed(
    docs: DataFrame, weights: dict[str, float] | None = None, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, fraction: float = FRACTION, seed: int = SEED
) -> DataFrame:
    """docs with its columns, each row's text cut to the parts that mix() chooses, one row for each.

    A row that is chosen whole is as it was.  n_chars, if there is such a column, follows the text.  Null
    columns, empty and very long texts are as in mix(); rows that are alike in doc_id and text are in the
    order of a hash of all their columns; a further column of any name stays as it is.
    """
    counted = written(_streams(docs, [], 1, seed).drop("shard"), "counted")
    n_shards = _n_shards(counted.agg(F.sum("n")).first()[0], shard_tokens)
    lists = chosen_blocks(counted.withColumn("shard", _shard(n_shards)), weights or {}, block_tokens, fraction, seed)
    names = docs.columns
    parts = parts_in(_streams(docs, [row_of(docs).alias("row"), row_hash(docs).alias("row_key")], n_shards, seed), lists, block_tokens, "row_key")
    whole = (F.col("first_word") == 0) & (F.col("end_word") == F.col("n"))
    cut = F.array_join(F.slice(_pieces(F.col("row.text")), F.col("first_word").cast("int") + 1, (F.col("end_word") - F.col("first_word")).cast("int")), "")
    parts = parts.select("row", whole.alias("whole"), F.when(whole, F.col("row.text")).otherwise(cut).alias("part"))
    own = {"text": F.col("part"), "n_chars": F.when(F.col("whole"), F.col("row.n_chars")).otherwise(F.length("part").cast("long")) if "n_chars" in names else None}
    return parts.select(*((own[c] if own.get(c) is not None else F.col("row").getField(c)).alias(c) for c in names))


#: what the query and the pipeline aim at with the test tables' sources
TARGETS = {"src0": 2.0, "src1": 1.5, "src2": 0.5}


def op5_sainte_lague_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), TARGETS)


def oracle(weights: dict[str, float], block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, fraction: float = FRACTION, seed: int = SEED) -> str:
    """mix() in DuckDB's SQL, over documents without two rows of one doc_id."""
    weight = "CASE source " + " ".join(f"WHEN '{k}' THEN {float(v)!r}::DOUBLE" for k, v in sorted(weights.items())) + " ELSE 1.0::DOUBLE END"
    upto = lambda b: f"(({b})::HUGEINT * quota * 2 + nb) // (2 * nb)"
    return rf"""
WITH t AS (
  SELECT source, coalesce('=' || source, '') AS source_key, doc_id, md5('{seed}|' || coalesce(doc_id::VARCHAR, '')) AS ord,
         len(regexp_extract_all(text, '{PIECE}')) AS n
  FROM documents WHERE text IS NOT NULL),
c AS (SELECT greatest(1, ceil(sum(n) / {shard_tokens}.0))::BIGINT AS shards FROM t),
p AS (SELECT t.*, ('0x' || substr(ord, 1, 8))::BIGINT % shards AS shard FROM t, c WHERE n > 0),
f AS (SELECT *, (sum(n) OVER (PARTITION BY source_key ORDER BY shard, ord, doc_id) - n)::BIGINT AS frm FROM p),
s AS (SELECT source_key, source, sum(n)::BIGINT AS words, ((sum(n) + {block_tokens - 1}) // {block_tokens})::BIGINT AS nb, {weight} AS weight FROM p GROUP BY source_key, source),
every AS (SELECT greatest(1, floor({fraction}::DOUBLE * sum(nb) + 0.5)) AS seats FROM s),
k AS (SELECT source_key, row_number() OVER (ORDER BY weight / (2 * k + 1) DESC, source_key) AS place FROM (SELECT *, unnest(range(nb)) AS k FROM s WHERE weight > 0)),
q AS (SELECT source_key, count(*) AS quota FROM k, every WHERE place <= seats GROUP BY source_key),
b AS (
  SELECT e.source_key, e.nb, e.b, f.shard
  FROM (SELECT *, least((b + 1) * {block_tokens}, words) - 1 AS last_word FROM (SELECT *, unnest(range(nb)) AS b FROM s)) e
  JOIN f ON f.source_key = e.source_key AND e.last_word BETWEEN f.frm AND f.frm + f.n - 1),
h AS (SELECT source_key, shard, {upto("max(b) + 1")} - {upto("min(b)")} AS seats FROM b JOIN q USING (source_key) GROUP BY source_key, shard, nb, quota),
chosen AS (
  SELECT source_key, shard, b
  FROM (SELECT b.*, h.seats, row_number() OVER (PARTITION BY b.shard, b.source_key ORDER BY md5(concat_ws('|', '{seed}', b.shard, b.source_key, b.b)), b.b) AS place FROM b JOIN h USING (source_key, shard))
  WHERE place <= seats),
o AS (
  SELECT f.source, f.doc_id, f.frm, f.n, chosen.shard, chosen.b, chosen.b - row_number() OVER (PARTITION BY f.source_key, f.doc_id, chosen.shard ORDER BY chosen.b) AS run
  FROM f JOIN chosen ON f.source_key = chosen.source_key AND chosen.b BETWEEN f.frm // {block_tokens} AND (f.frm + f.n - 1) // {block_tokens})
SELECT shard, source, min(b) AS first_block, max(b) AS last_block, doc_id,
       greatest(0, min(b) * {block_tokens} - frm) AS first_word, least(n, (max(b) + 1) * {block_tokens} - frm) AS end_word
FROM o GROUP BY shard, source, doc_id, frm, n, run
"""


ORACLE = oracle(TARGETS)
