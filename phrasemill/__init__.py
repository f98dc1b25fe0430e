"""phrasemill: keyphrase extraction and extractive summaries over a corpus, on Spark.

A document is a row, ``doc_id`` leads every relation's key, and everything up to the word graph and
after the ranking is DataFrame algebra.  Only what is iterative or order-dependent runs as Arrow kernels.
"""

import sys

from pyspark import cloudpickle

# Kernels travel to executors by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

from .functions.stopwords import get_stopwords  # noqa: E402
from .plans.api import (  # noqa: E402
    BaseTextRank,
    BiasedTextRank,
    ClusterDetail,
    ClusterMember,
    ConvergenceSummary,
    DebugPayload,
    DroppedCandidate,
    GraphStats,
    MultipartiteRank,
    Phrase,
    PhraseSplitEvent,
    PositionRank,
    SentenceRank,
    SingleRank,
    TextRankResult,
    TopicalPageRank,
    TopicRank,
    extract_keywords,
)
from .plans.config import TextRankConfig  # noqa: E402
from .plans.spec import validate_pipeline_spec  # noqa: E402
from .sources.json_docs import BatchIter, extract_batch_from_json, extract_batch_iter, extract_from_json, extract_jsonl_from_json  # noqa: E402
from .sources.topic_weights import topic_weights_from_lda  # noqa: E402

__all__ = [
    "BaseTextRank", "BatchIter", "BiasedTextRank", "ClusterDetail", "ClusterMember", "ConvergenceSummary", "DebugPayload", "DroppedCandidate", "GraphStats", "MultipartiteRank", "Phrase", "PhraseSplitEvent",
    "PositionRank", "SentenceRank", "SingleRank", "TextRankConfig", "TextRankResult", "TopicRank", "TopicalPageRank", "extract_batch_from_json", "extract_batch_iter", "extract_from_json",
    "extract_jsonl_from_json", "extract_keywords", "get_stopwords", "topic_weights_from_lda", "validate_pipeline_spec",
]
