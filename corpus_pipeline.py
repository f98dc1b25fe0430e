"""A corpus from raw documents to packed sequences: five stages, each one of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phrasemill.llm import mixing, packing, quality_rules, secrets, simhash
from phrasemill.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule; the others go.

    A null or empty text has no word and goes; a value on a threshold stays; repeated rows are judged each; texts are
    measured whole; columns stay as they are, whatever their names; an empty table stays empty.
    """
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id, a null one last.

    Rows alike in all columns are one; documents without a word (null or empty texts) stay, all of them; texts count
    whole; columns stay as they are; an empty table stays empty.
    """
    return simhash.deduplicated(docs)


def scrubbed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in them masked.

    Null and empty texts stay as they are; repeated rows are alike still; texts are read whole, however long; of
    literals that overlap one mask is left; other columns stay; an empty table stays empty.
    """
    return secrets.without_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The parts of documents in the blocks that the sources' quotas take.

    A null source is a source; documents without a word (null or empty texts) have no block and go; a long text may
    have several parts, a row each; ties go by a hash of doc_id, then doc_id, text and all columns; an empty
    table stays empty.
    """
    return mixing.mixed(docs, mixing.TARGETS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences whose lengths are powers of two, none across documents.

    Null and empty texts have none, long ones many of the longest length; repeated rows have theirs each; a null doc_id
    stays null; other columns have no part; an empty table has an empty result.
    """
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", scrubbed),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents table; between stages a table in the shared folder.

    What is null, empty, very long, tied or repeated each stage says for itself; an empty table has an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs


#: the secret scan lexes and the packing encodes: SQL expresses neither
ORACLE_SQL = None
