"""The same extractions on streams: narrow maps, so any output mode and no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import document as D
from ..plans.config import Plan
from ..sources.json_docs import process_lines


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string, lang string", form: str = "parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format(form).schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path)


def keyphrases(docs: DataFrame, plan: Plan) -> DataFrame:
    """operators.document.extract() of a stream of documents."""
    return D.extract(docs, plan)


def json_results(lines: DataFrame, compat: bool = False) -> DataFrame:
    return process_lines(lines, compat)


def delivered_once(docs: DataFrame, event_time: str, delay: str) -> DataFrame:
    """docs without those that come again within the delay, by doc_id."""
    return docs.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["doc_id"])


def start(result: DataFrame, form: str, checkpoint: str, path: str | None = None, name: str | None = None, **options) -> StreamingQuery:
    writer = result.writeStream.format(form).outputMode("append").option("checkpointLocation", checkpoint).options(**options)
    writer = writer.queryName(name) if name else writer
    return writer.start(path) if path else writer.start()
