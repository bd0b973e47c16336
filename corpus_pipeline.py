"""The corpus pipeline: quality rules, near-duplicates, repeated passages, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows it is given. All but
the last return the columns of ``documents``; the last returns a row a packed piece.
A stage's rows are written before the next is called. Scratch tables of a stage are
deleted when a later stage of the run is called on rows that no longer read them.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.common import release, scratch_root, scratch_scope
from kgspark.llm.near_dedup import near_dedup
from kgspark.llm.packing import pack_documents
from kgspark.llm.quality import quality_filter
from kgspark.llm.suffix_dedup import suffix_dedup


_scratch: list[str] = []


def _stage(first: bool = False):
    def wrap(f):
        @functools.wraps(f)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            global _scratch
            if first:
                _scratch = []  # tables of an earlier run may still be read by its result
            release(spark, _scratch, docs)
            with scratch_scope(_scratch):
                return f(spark, docs, sf_dir)

        return run

    return wrap


@_stage(first=True)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed and the adaptive rules.

    Null texts count as empty and go; null languages and sources are one group; repeated rows are judged alike.
    """
    return quality_filter(docs)


@_stage()
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near-duplicates.

    Null and empty texts are one class; null ids come last; of rows with one id and class any one stays.
    """
    return near_dedup(docs)


@_stage()
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 100 bytes or more that occur earlier; n_chars follows the text.

    Null texts stay null, texts may become empty; null ids come before all others, rows of one id in the order of their texts.
    """
    out = suffix_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@_stage()
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece: where it lies in which sequence of 4096 tokens.

    Null texts count as empty and are the closing id alone; repeated rows are packed each.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]
#: Near-duplicate classes, suffix arrays and tokenisation are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two the rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{scratch_root(spark)}/kgspark/{uuid.uuid4().hex}-pipeline"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
