"""Writers. Each writes a folder on any store that Spark reaches; reports are small and come from aggregates."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import literal

RECORD_FIELDS = ["index", "doc_id", "chunk_id", "section_title", "input_text", "entity_hint", "relation_hint", "oie", "schema_definition", "schema_canonicalization", "triples_before_utility_filter", "useful_triplets", "utility_filter_trace"]


def json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def text_lines(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def chunk_records(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines in the order of their global index."""
    chunks.withColumnRenamed("index", "global_index").orderBy("global_index").write.json(path)


def stage_records(records: DataFrame, path: str) -> None:
    """A JSON object a chunk, in order; readers take lines as well as a list."""
    records.select(*RECORD_FIELDS).orderBy("index").write.json(path)


def literal_lines(records: DataFrame, path: str, triples: str, order: str = "index") -> None:
    """A list a chunk in order, as a Python literal; chunks without triples keep their line as []."""
    none = F.array().cast("array<array<string>>")
    kept = F.filter(F.coalesce(triples, none), lambda t: t.isNotNull())
    line = F.concat(F.lit("["), F.array_join(F.transform(kept, lambda t: F.concat(F.lit("["), F.array_join(F.transform(t, literal), ", "), F.lit("]"))), ", "), F.lit("]"))
    records.select(order, line.alias("value")).orderBy(order).select("value").write.text(path)


def sorted_triples(triples: DataFrame, path: str) -> None:
    """Distinct triples in one line as a sorted Python literal: an ontology, which is of bounded size."""
    one = triples.select("subject", "predicate", "object").distinct().agg(F.sort_array(F.collect_list(F.struct("subject", "predicate", "object"))).alias("l"))
    line = F.concat(F.lit("["), F.array_join(F.transform("l", lambda t: F.concat(F.lit("("), F.array_join(F.transform(F.array(t.subject, t.predicate, t.object), literal), ", "), F.lit(")"))), ", "), F.lit("]"))
    one.select(line.alias("value")).write.text(path)


def page_texts(lines: DataFrame, path: str) -> None:
    """Plain texts of documents, a folder a document: rows (doc_id, text) in the order given within a document."""
    lines.select("doc_id", "text").write.partitionBy("doc_id").text(path)


def page_tables(rows: DataFrame, path: str) -> None:
    """Table rows as JSON lines, a folder a document: cells become fields, with _page, _table and _row."""
    marks = F.map_from_arrays(F.array(*(F.lit(x) for x in ("_page", "_table", "_row"))), F.array(*(F.col(c).cast("string") for c in ("page", "table", "row"))))
    rows.select("doc_id", F.to_json(F.map_concat("cells", marks)).alias("value")).write.partitionBy("doc_id").text(path)


def triple_lists(chunks: DataFrame, path: str, order: str, triples: str = "triples") -> None:
    """A JSON list a chunk in order; chunks without triples keep their line as []."""
    none = F.array().cast("array<array<string>>")
    kept = F.filter(F.coalesce(triples, none), lambda t: t.isNotNull())
    chunks.select(order, F.to_json(kept).alias("value")).orderBy(order).select("value").write.text(path)


def csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header; columns that the rows lack are empty."""
    names = columns or df.columns
    df.select(*(F.col(c) if c in df.columns else F.lit("").alias(c) for c in names)).write.option("header", "true").option("escape", '"').csv(path)


def relation_json(definitions: DataFrame, path: str) -> None:
    """{"relations_total": n, "relation_definitions": {...}} in one line; a schema is of bounded size."""
    rows = F.sort_array(F.collect_list(F.struct("relation", "definition")))
    one = definitions.agg(F.struct(F.count("*").alias("relations_total"), F.map_from_entries(rows).alias("relation_definitions")).alias("x"))
    one.select(F.to_json("x").alias("value")).write.text(path)


def split_dataset(df: DataFrame, path: str, seed: int = 0, weights: tuple[float, float, float] = (0.75, 0.125, 0.125)) -> None:
    low = F.pmod(F.xxhash64(F.lit(seed), F.struct(*df.columns)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    first, second = weights[0] / sum(weights), (weights[0] + weights[1]) / sum(weights)
    part = F.when(low < first, "train").when(low < second, "test").otherwise("valid")
    df.withColumn("split", part).write.partitionBy("split").parquet(path)  # one pass; equal rows stay together


def report(sections: dict, path: str | None = None) -> str:
    """A report (see evaluation.report) as JSON text, also written to a local ``path`` of the driver if there is one."""
    text = json.dumps(sections, indent=2, default=str, ensure_ascii=False)
    if path is not None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text
