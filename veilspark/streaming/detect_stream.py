"""Streaming form of detection: the same stateless projection over a stream of documents, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import engine
from veilspark.operators.recognizers import Dictionaries


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def anonymized_stream(stream: DataFrame, mode: str = "maximum", words: Dictionaries | None = None, **options) -> DataFrame:
    return engine.anonymize(stream, mode, words, **options)


def windowed_counts(stream: DataFrame, time: str, mode: str = "maximum", length: str = "10 minutes", late: str = "10 minutes", words: Dictionaries | None = None, **options) -> DataFrame:
    """Findings per type and tumbling window of event time; state of a window goes once ``late`` has passed."""
    long = engine.findings(stream.withWatermark(time, late), mode, words, keep=(time,), **options)
    return long.groupBy(F.window(time, length), "entity_type").agg(F.count("*").alias("n"))
