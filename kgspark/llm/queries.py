"""The queries of this subpackage: one opN_<name> an operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_digest
from .common import table
from .html_extract import extract_pages
from .licenses import license_scan
from .lm import lm_score
from .media import media_digest
from .near_dedup import near_classes
from .packing import pack_documents
from .quality import ORACLE_SQL as QUALITY_SQL
from .quality import quality_digest
from .suffix_dedup import suffix_digest
from .warc import ORACLE_SQL as WARC_SQL
from .warc import warc_round_trip


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digest(table(spark, sf_dir, "documents"))


def op2_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_prob_minhash": op2_prob_minhash,
    "op3_warc": op3_warc,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_html_text": op6_html_text,
    "op7_media_columns": op7_media_columns,
    "op8_license_scan": op8_license_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_lm_score": op10_lm_score,
}
ORACLES: dict[str, str] = {"op3_warc": WARC_SQL, "op9_quality_rules": QUALITY_SQL}
