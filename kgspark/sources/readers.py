"""Readers: documents, schemas, triple files, stage files, alignments, labels, ontologies. All have fixed schemas."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions.text import collapse, normalize_label
from ..operators.ontology import last_definition, read_turtle
from ..operators.ordering import global_index


def documents(spark: SparkSession, path: str, mode: str = "all_combined") -> DataFrame:
    """(doc_id, source_path, text) of text files: all whose name holds ``_combined``, or one file in mode "test"."""
    if mode not in ("all_combined", "test"):
        raise ValueError(f"mode is {mode!r}, not all_combined or test")
    reader = spark.read.option("recursiveFileLookup", "true")
    if mode == "all_combined":
        reader = reader.option("pathGlobFilter", "*_combined*.txt")
    files = reader.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_path"))
    if files.isEmpty():
        raise FileNotFoundError(f"no documents under {path}")
    files = files.orderBy("source_path")
    return files.select(F.regexp_extract("source_path", r"([^/]*?)(\.[^./]*)?$", 1).alias("doc_id"), "source_path", F.col("value").alias("text"))


def _place() -> Column:
    """Where a row stands: its file's path, the block within it, then the order within the task. Spark deals files to tasks by size."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())


def line_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("text"))


def target_schema(spark: SparkSession, path: str) -> DataFrame:
    """(ord, relation, definition) of a two-column CSV: the last definition counts, at the relation's first place."""
    rows = spark.read.schema("relation string, definition string").option("header", "false").option("escape", '"').csv(path)
    last = last_definition(rows.withColumn("_n", _place()).where("relation is not null"), "relation", "definition", "_n")
    return global_index(last, ["ord"], "_ord").select(F.col("_ord").alias("ord"), "relation", "definition")


def triple_lines(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(line_ix, triples, warning): a list literal per non-empty line. Bad lines and items warn, or raise if ``strict``."""
    placed = spark.read.text(path).withColumn("_n", _place()).where(F.trim("value") != "")
    lines = global_index(placed, ["_n"], "line_ix").drop("_n")
    if strict:
        read = lines.withColumn("_t", parsing.literal_triples(F.col("value"), strip=False))
    else:
        read = lines.withColumn("_t", parsing.literal_triples(F.col("value")))
    three = lambda t: F.size(t) == 3
    bad = F.col("_t").isNull() | F.exists("_t", lambda t: ~three(t))
    if strict:
        checked = F.when(bad, F.raise_error(F.concat(F.lit("bad triple line: "), F.substring("value", 1, 200))).cast(parsing.TRIPLES)).otherwise(F.col("_t"))
        return read.select("line_ix", checked.alias("triples"), F.lit(None).cast("string").alias("warning"))
    kept = F.transform(F.filter(F.coalesce("_t", F.array().cast(parsing.TRIPLES)), three), lambda t: F.transform(t, lambda x: F.trim(x)))
    return read.select("line_ix", kept.alias("triples"), F.when(F.col("_t").isNull(), "unreadable line").when(bad, "items that are no triples").alias("warning"))


def ontology_triples(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (subject, predicate, object) of all lines of a triple file; an empty one is an error, several lines warn."""
    lines = triple_lines(spark, path)
    if len(lines.take(2)) > 1:
        warnings.warn(f"{path} has several lines; all are one ontology", stacklevel=2)
    rows = lines.select(F.explode("triples").alias("t")).select(*(F.col("t")[k].alias(c) for k, c in enumerate(("subject", "predicate", "object")))).distinct()
    if rows.isEmpty():
        raise ValueError(f"no triples in {path}")
    return rows


def stage_records(spark: SparkSession, path: str) -> DataFrame:
    """Stage records, a JSON list or an object a line; both spellings of the canonicalisation field are read."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    listed = first is not None and first.value.lstrip().startswith("[")
    rows = spark.read.schema(parsing.STAGE_SCHEMA).option("multiLine", str(listed).lower()).json(path)
    return rows.withColumn("schema_canonicalization", F.coalesce("schema_canonicalization", "schema_canonicalizaiton")).drop("schema_canonicalizaiton")


def relation_alignment(spark: SparkSession, path: str) -> DataFrame:
    """(sys, gold_p, score) in label form: all candidates of accepted and rejected items, the best score a pair."""
    item = "array<struct<system_relation:string,best_gold_relation:string,best_similarity:double,candidates:array<struct<gold_relation:string,similarity:double>>>>"
    rows = spark.read.schema(f"accepted {item}, rejected {item}").option("multiLine", "true").json(path)
    none = F.array().cast(item)
    items = rows.select(F.explode(F.concat(F.coalesce("accepted", none), F.coalesce("rejected", none))).alias("x")).select("x.*")
    pairs = items.select("system_relation", F.explode("candidates").alias("c")).select("system_relation", "c.gold_relation", "c.similarity").union(items.select("system_relation", "best_gold_relation", "best_similarity"))
    named = pairs.select(normalize_label(F.col("system_relation")).alias("sys"), normalize_label(F.col("gold_relation")).alias("gold_p"), F.col("similarity").alias("score"))
    return named.where("sys <> '' and gold_p <> '' and score is not null").groupBy("sys", "gold_p").agg(F.max("score").alias("score"))


def review_labels(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, label) of a label CSV: human_label, else label; blank ones are skipped, the last counts."""
    rows = spark.read.option("header", "true").option("escape", '"').csv(path).withColumn("_n", _place())
    found = [F.nullif(F.trim(c), F.lit("")) for c in ("human_label", "label") if c in rows.columns]
    return rows.select("sample_id", F.upper(F.coalesce(*found, F.lit(None).cast("string"))).alias("label"), "_n").where("label is not null").groupBy("sample_id").agg(F.max_by("label", "_n").alias("label"))


def crawled_definitions(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of crawled sentences with relations and definitions; quoted fields may have line breaks."""
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def page_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of pages as JSON lines from any PDF tool: (doc_id, page, text, x0, x1, top, bottom)."""
    return spark.read.schema("doc_id string, page bigint, text string, x0 double, x1 double, top double, bottom double").json(path)


def page_cells(spark: SparkSession, path: str) -> DataFrame:
    """Table cells of pages as JSON lines: (doc_id, page, table, row, cells), a map of header to cell."""
    return spark.read.schema("doc_id string, page bigint, table int, row int, cells map<string,string>").json(path)


def relation_definitions(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("relation_definitions map<string,string>").option("multiLine", "true").json(path)
    pairs = rows.select(F.explode("relation_definitions").alias("relation", "definition"))
    return pairs.select("relation", collapse(F.col("definition")).alias("definition")).where("definition <> ''")


def class_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("uri string, name string").json(path).where("uri is not null and name is not null")


def turtle(spark: SparkSession, path: str) -> DataFrame:
    return read_turtle(spark.read.text(path, wholetext=True))


def property_comments(spark: SparkSession, path: str) -> DataFrame:
    """(relation, definition) by regular expression: the longest English comment of each object property block."""
    from ..operators.ontology import longest, relation_name_ok

    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.expr(r"regexp_extract_all(value, '(?s)(\\S+)\\s+(?:a|rdf:type)\\s+owl:ObjectProperty\\s*;(.*?)(?=###|\\z)', 0)")).alias("b"))
    rows = blocks.select(F.regexp_extract("b", r"^(\S+)", 1).alias("uri"), F.explode(F.expr("regexp_extract_all(b, 'rdfs:comment\\\\s+\"([^\"]*)\"', 1)")).alias("t"))
    named = rows.select(F.regexp_extract(F.regexp_replace("uri", "[<>]", ""), r"[^#/:]+$", 0).alias("relation"), "t")
    return longest(named.where(relation_name_ok(F.col("relation"))), "relation", "t")


def distant_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Sentences whose every triple has three parts and names its subject and object in the sentence."""
    rows = spark.read.schema("sentence string, triples array<array<string>>").json(path)
    low = F.lower("sentence")
    return rows.where((F.size("triples") > 0) & F.forall("triples", lambda t: (F.size(t) == 3) & low.contains(F.lower(t[0])) & low.contains(F.lower(t[2]))))
