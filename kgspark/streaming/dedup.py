"""Streams of chunk or triple files through the same functions as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import sentence_windows
from ..operators.triples import SPO, explode_triples


def document_stream(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, ts) rows as JSON files arrive in a folder."""
    return spark.readStream.schema("doc_id string, text string, ts timestamp").json(path)


def stream_windows(docs: DataFrame, size: int = 4, overlap: int = 1) -> DataFrame:
    """Sentence windows of each document; stateless, so any output mode does."""
    return sentence_windows(docs, "text", size, overlap)


def stream_triples(chunks: DataFrame, ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """Triples of chunks, each once within the watermark; state is dropped when it passes."""
    return explode_triples(chunks).withWatermark(ts, lateness).dropDuplicatesWithinWatermark(SPO)


def triple_counts(triples: DataFrame, ts: str = "ts", width: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Predicates counted by event-time windows."""
    return triples.withWatermark(ts, lateness).groupBy(F.window(ts, width), "predicate").count()
