"""Documents to knowledge graph: chunk, extract, define, canonicalise, drop what has no relation, filter, refine.

Each stage's table is written under ``out`` and read by the next. A finished stage is
kept: a job with the same configuration and documents resumes after it, so model calls
are not repeated. Stages of other jobs and half-written ones are never read.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import Completer, Embedder, complete, entity_completer, hashing_embedder, prompt, rule_completer
from ..functions.parsing import parse_completion
from ..functions.text import definitions
from ..operators.canonicalize import canonicalize, canonicalize_enriched, utility_filter
from ..operators.chunking import adaptive_chunks, char_windows, sentence_windows
from ..operators.ordering import global_index
from ..operators.refinement import refinement_hints
from ..operators.triples import SPO, change_trace, explode_triples, first_seen

LISTS = "array<array<string>>"


@dataclass(frozen=True)
class JobConfig:
    chunking: str = "adaptive"
    chunking_settings: dict = field(default_factory=dict)
    extract_prompt: str = "Extract triples as a list of [subject, relation, object].\n{entity_hint}\n{relation_hint}\n\n{text}"
    define_prompt: str = "Define each relation, one a line, as name: definition.\n{relations}\n{triples}\n\n{text}"
    filter_prompt: str = "Keep the useful triples.\n\n{triples}"
    entity_prompt: str = "List the entities.\n\n{text}"
    merge_prompt: str = "Merge the lists of entities.\n{entity_list_1}\n{entity_list_2}\n\n{text}"
    use_definitions: bool = True
    use_filter: bool = False
    enrich: bool = False
    iterations: int = 1
    top_k: int = 3
    hint_top_k: int = 10
    min_similarity: float | None = 0.45
    min_margin: float | None = 0.08
    completer: Callable[[], Completer] = rule_completer
    entity_completer: Callable[[], Completer] = entity_completer
    verifier: Callable[[], Completer] | None = None
    embedder: Callable[[], Embedder] = hashing_embedder

    def settings(self) -> dict[str, str]:
        """All options by name; functions by where they are defined."""
        name = lambda v: f"{v.__module__}.{v.__qualname__}" if callable(v) else repr(v)
        return {f.name: name(getattr(self, f.name)) for f in sorted(dataclasses.fields(self), key=lambda f: f.name)}


def chunk(docs: DataFrame, cfg: JobConfig) -> DataFrame:
    """(doc_id, chunk_ix, chunk_id, section_title, text)"""
    ident = F.concat(F.col("doc_id").cast("string"), F.lit("::chunk_"), F.lpad(F.col("chunk_ix").cast("string"), 5, "0"))
    if cfg.chunking == "adaptive":
        return adaptive_chunks(docs, **cfg.chunking_settings).select("doc_id", "chunk_ix", "chunk_id", "section_title", "text")
    cut = {"sentences": sentence_windows, "characters": char_windows}[cfg.chunking]
    made = cut(docs.select("doc_id", "text"), "text", **cfg.chunking_settings)
    return made.select("doc_id", "chunk_ix", ident.alias("chunk_id"), F.lit(None).cast("string").alias("section_title"), F.col("chunk").alias("text"))


class Stages:
    """Tables under ``out`` in a folder named by configuration and input."""

    def __init__(self, docs: DataFrame, schema: DataFrame, out: str, cfg: JobConfig):
        self.spark = docs.sparkSession
        of = lambda df, *columns: df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0))).first()
        told = repr((sorted(cfg.settings().items()), of(docs, "doc_id", "text"), of(schema, "ord", "relation", "definition")))
        self.base = f"{out}/{hashlib.sha256(told.encode()).hexdigest()[:16]}"

    def finished(self, name: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}/_SUCCESS")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        if not self.finished(name):
            df.write.mode("overwrite").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")


def _lists(rows: DataFrame, relation: str, out: str) -> DataFrame:
    """(chunk_id, out): the triples of each chunk in order."""
    got = rows.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("triple_ix", F.array("subject", relation, "object").alias("t")))).alias("l"))
    return got.select("chunk_id", F.transform("l", lambda x: x.t).alias(out))


def extract(docs: DataFrame, schema: DataFrame, out: str, cfg: JobConfig = JobConfig()) -> DataFrame:
    """(chunk_id, triple_ix, subject, predicate, object, canonical) of all documents in the last round.

    Triples without a canonical relation are dropped; ``records`` has what each step did.
    """
    return run_job(docs, schema, out, cfg)[0]


def run_job(docs: DataFrame, schema: DataFrame, out: str, cfg: JobConfig = JobConfig()) -> tuple[DataFrame, DataFrame, Stages]:
    """(triples, records of the last round, stages). A record is a row a chunk, also of chunks without triples."""
    stage = Stages(docs, schema, out, cfg)
    chunks = stage(global_index(chunk(docs, cfg), ["doc_id", "chunk_ix"], "index"), "chunks")
    none = F.array().cast(LISTS)
    triples: DataFrame | None = None
    records: DataFrame | None = None
    for i in range(cfg.iterations):
        at, last = f"iter{i}", i == cfg.iterations - 1
        if triples is None:
            hints = chunks.select("chunk_id", F.lit("").alias("entity_hint"), F.lit("").alias("relation_hint"))
        else:
            before = triples.select("chunk_id", "triple_ix", "subject", F.col("canonical").alias("predicate"), "object")
            hints = stage(refinement_hints(chunks, before, schema, cfg.entity_prompt, cfg.merge_prompt, cfg.hint_top_k, cfg.entity_completer, cfg.embedder), f"{at}/hints")
        asked = chunks.join(hints, "chunk_id").withColumn("p", prompt(cfg.extract_prompt, entity_hint=F.col("entity_hint"), relation_hint=F.col("relation_hint"), text=F.col("text")))
        raw = stage(complete(asked.select("index", "chunk_id", "text", "entity_hint", "relation_hint", "p"), "p", "answer", cfg.completer).drop("p"), f"{at}/raw")
        rows = first_seen(explode_triples(raw.select("index", "chunk_id", F.array_distinct(parse_completion("answer")).alias("triples"))), ["chunk_id", *SPO], F.col("triple_ix"))
        rows = stage(rows, f"{at}/oie")
        told = rows.select("chunk_id").distinct().withColumn("d", F.create_map().cast("map<string,string>"))
        if cfg.use_definitions:
            names = rows.groupBy("chunk_id").agg(F.array_join(F.sort_array(F.collect_set("predicate")), ", ").alias("relations"))
            ask = names.join(_lists(rows, "predicate", "triples"), "chunk_id").join(chunks, "chunk_id")  # chunks without triples are not asked
            ask = ask.withColumn("p", prompt(cfg.define_prompt, relations=F.col("relations"), triples=F.to_json("triples"), text=F.col("text")))
            told = stage(complete(ask.select("chunk_id", "p"), "p", "answer", cfg.completer).select("chunk_id", definitions(F.col("answer")).alias("d")), f"{at}/definitions")
            defined = rows.join(told, "chunk_id", "left").withColumn("definition", F.coalesce(F.try_element_at("d", F.col("predicate")), F.col("predicate"))).drop("d")
            if cfg.enrich:
                placed = defined.withColumn("place", F.struct("index", "triple_ix"))  # the order in which triples are met
                done = canonicalize_enriched(placed, schema, "place", cfg.min_similarity or 0.0, cfg.min_margin or 0.0, cfg.embedder, cfg.verifier).drop("place")
            else:
                done = canonicalize(defined, schema, cfg.top_k, cfg.min_similarity, cfg.min_margin, cfg.embedder, cfg.verifier)
        else:
            done = rows.withColumn("canonical", F.col("predicate"))
        done = stage(done.select("chunk_id", "triple_ix", *SPO, "canonical"), f"{at}/canonical")
        triples = done.where("canonical is not null")
        kept = _lists(triples, "canonical", "triples_before_utility_filter")
        if cfg.use_filter and last:
            ready = kept.select("chunk_id", F.col("triples_before_utility_filter").alias("triples"))
            useful = utility_filter(ready.withColumn("p", prompt(cfg.filter_prompt, triples=F.to_json("triples"))), "triples", "p", cfg.completer).drop("p")
            useful = stage(useful.select("chunk_id", F.col("triples").alias("useful_triplets"), "parse_ok"), f"{at}/useful")
        else:
            useful = kept.select("chunk_id", F.col("triples_before_utility_filter").alias("useful_triplets"), F.lit(True).alias("parse_ok"))
        item = lambda df, c: df.select("chunk_id", F.explode(c).alias("t"))
        trace = change_trace(item(kept, "triples_before_utility_filter"), item(useful, "useful_triplets"), "chunk_id", ["t"])
        record = chunks.select("index", "doc_id", "chunk_id", "section_title", F.col("text").alias("input_text")).join(hints, "chunk_id")
        record = record.join(_lists(rows, "predicate", "oie"), "chunk_id", "left").join(told.select("chunk_id", F.col("d").alias("schema_definition")), "chunk_id", "left")
        every = _lists(done.withColumn("canonical", F.coalesce("canonical", F.lit(""))), "canonical", "all")
        nulled = F.transform("all", lambda t: F.when(t[1] != "", t))
        record = record.join(every.select("chunk_id", nulled.alias("schema_canonicalization")), "chunk_id", "left").join(kept, "chunk_id", "left").join(useful, "chunk_id", "left")
        record = record.join(trace.select("chunk_id", F.struct("unchanged", "removed", "added", "rewritten").alias("utility_filter_trace")), "chunk_id", "left")
        lists = {c: F.coalesce(c, none) for c in ("oie", "schema_canonicalization", "triples_before_utility_filter", "useful_triplets")}
        records = stage(record.withColumns(lists), f"{at}/records")
    return triples, records, stage


def settings_log(cfg: JobConfig, documents: int, chunks: DataFrame) -> str:
    """The run's settings, sorted, with the number of documents and chunks and the chunks' mean length."""
    s = chunks.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.length("text")), F.lit(0.0)).alias("mean")).first()
    head = ["run settings", f"timestamp_utc={datetime.now(UTC).isoformat()}", f"document_count={documents}", f"chunk_count={s.n}", f"avg_chunk_length_chars={s.mean:.2f}", "", "args:"]
    return "\n".join([*head, *(f"{k}={v}" for k, v in cfg.settings().items())]) + "\n"
