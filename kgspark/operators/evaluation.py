"""Evaluation: alignment to an ontology, and the novel rest, with its tables and report.

Predictions are rows (pred_id, subject, predicate, object) and, where known, line_idx,
doc_id, chunk_id, section_title, source_text_snippet. The order of predictions is that
of pred_id. A prediction is matched if the greedy one-to-one matching gave it a gold
triple, alignable if it has candidates for all three parts, novel if it is not matched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sample_id, snippet
from ..sources.scratch import checkpointed
from . import alignment as A
from . import metrics as M
from .ordering import few_rows, join_vocabulary

# Columns of the two exported tables, in order.
MATCH_COLUMNS = [
    "pred_id", "line_idx", "doc_id", "chunk_id", "subject", "predicate", "object", "alignable", "matched",
    "gold_subject", "gold_predicate", "gold_object", "overall_score", "subject_score", "relation_score", "object_score",
    "reason_for_novelty", "legacy_reason",
]
REVIEW_COLUMNS = ["sample_id", "doc_id", "chunk_id", "section_title", "source_text_snippet", "subject", "predicate", "object", "reason_for_novelty", "legacy_reason", "human_label"]
_CONTEXT = {"line_idx": "bigint", "doc_id": "string", "chunk_id": "string", "section_title": "string", "source_text_snippet": "string"}


def with_stages(preds: DataFrame, stages: DataFrame) -> DataFrame:
    """Predictions (with line_idx) and what the stage record of their line says; lines without a record keep nulls."""
    told = stages.select(F.col("index").alias("line_idx"), "doc_id", "chunk_id", "section_title", F.col("input_text"))
    return preds.join(told, "line_idx", "left").withColumn("source_text_snippet", snippet(F.col("input_text"))).drop("input_text")


def alignable(preds: DataFrame, relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Add ``alignable`` and, where it is false, ``not_alignable``: unknown_relation or entity_mismatch."""
    r = relations.select("p").distinct().withColumn("_r", F.lit(True))
    e = few_rows(checkpointed(entities.select("entity").distinct()))
    end = lambda c: e.select(F.col("entity").alias(c), F.lit(True).alias("_" + c))
    out = join_vocabulary(preds, r, "p").join(end("s"), "s", "left").join(end("o"), "o", "left")
    why = F.when(F.col("_r").isNull(), "unknown_relation").when(F.col("_s").isNull() | F.col("_o").isNull(), "entity_mismatch")
    return out.withColumns({"not_alignable": why, "alignable": why.isNull()}).drop("_r", "_s", "_o")


@dataclass(frozen=True)
class Evaluation:
    """records: each prediction with flags, alignable, matched, gold triple and scores, reason_for_novelty, legacy_reason.
    gold: distinct label forms. alignment: (sys, gold_p, score)."""

    records: DataFrame
    gold: DataFrame
    alignment: DataFrame

    @property
    def novel(self) -> DataFrame:
        """Unmatched predictions with ``branch`` (0: not alignable, 1: alignable) and a reason for all."""
        rows = self.records.where("not matched")
        legacy = F.when(F.col("normalized"), F.lit(A.KNOWN[3])).otherwise(F.col("legacy_reason"))
        return rows.withColumns({"branch": F.when(F.col("alignable"), 1).otherwise(0), "legacy_reason": legacy})


def evaluate(preds: DataFrame, gold: DataFrame, alignment: DataFrame, relation_threshold: float = 0.85, entity_threshold: float = 0.85, sequence: bool = True) -> Evaluation:
    """Both tracks, with the records written once."""
    for c, kind in _CONTEXT.items():
        preds = preds if c in preds.columns else preds.withColumn(c, F.lit(None).cast(kind))
    named = checkpointed(A.compliance(A.with_norm(preds), gold, alignment, relation_threshold))
    norm = checkpointed(A.gold_norm(gold))
    rel = checkpointed(A.relation_candidates(named, norm, alignment, relation_threshold))
    ents = checkpointed(A.entity_candidates(named.select(F.col("s").alias("entity")).union(named.select("o")), norm, entity_threshold, sequence))
    found = A.greedy_match(A.edges(named, norm, rel, ents))
    found = found.select("pred_id", F.col("gs").alias("gold_subject"), F.col("gp").alias("gold_predicate"), F.col("go").alias("gold_object"), F.col("overall").alias("overall_score"), "subject_score", "relation_score", "object_score")
    told = checkpointed(alignable(named, rel, ents).join(few_rows(found), "pred_id", "left").withColumn("matched", F.col("overall_score").isNotNull()))
    causes = A.diagnose(told.where("alignable and not matched"), norm, rel, ents)
    reason = F.when(F.col("matched"), "").otherwise(F.coalesce("cause", "not_alignable"))
    causes = few_rows(checkpointed(causes.select(*A.NORM, "cause", F.lit(True).alias("alignable"), F.lit(False).alias("matched"))))
    records = told.join(causes, [*A.NORM, "alignable", "matched"], "left").withColumns({"reason_for_novelty": reason, "legacy_reason": F.when(~F.col("normalized"), F.col("reason"))})
    return Evaluation(checkpointed(records.drop("cause", "not_alignable")), norm, alignment)


def match_rows(ev: Evaluation) -> DataFrame:
    """The table of all predictions with their match, scores rounded; its columns are MATCH_COLUMNS."""
    scores = {c: F.round(c, 6) for c in MATCH_COLUMNS if c.endswith("_score")}
    return ev.records.withColumns(scores).select(*MATCH_COLUMNS)


def review_sample(ev: Evaluation, size: int = 100, seed: int = 42) -> DataFrame:
    """At most ``size`` novel predictions for manual review: half of unknown relations, half of domain or range violations, the rest from all others."""
    novel = ev.novel.withColumn("reason", F.when(F.col("reason_for_novelty") == "unknown_relation", F.lit("unknown_relation")).otherwise(F.col("legacy_reason")))
    rows = M.stratified_sample(novel, size, seed)
    ident = sample_id(F.coalesce("line_idx", F.lit(-1)), F.col("subject"), F.col("predicate"), F.col("object"))
    return rows.withColumns({"sample_id": ident, "human_label": F.lit("")}).select(*REVIEW_COLUMNS)


def top_predicates(ev: Evaluation, n: int = 200) -> DataFrame:
    """(scope, predicate, count): the most frequent label forms of all and of novel predictions; ties by first occurrence."""
    novel = ev.novel.withColumn("place", F.struct("branch", "pred_id"))
    total = M.most_common(ev.records, "p", "pred_id", n).withColumn("scope", F.lit("total_predictions"))
    return total.unionByName(M.most_common(novel, "p", "place", n).withColumn("scope", F.lit("novel_predictions"))).select("scope", F.col("p").alias("predicate"), "count")


def counts(ev: Evaluation) -> DataFrame:
    """One row of the report's counts."""
    unique = F.count_distinct("subject", "predicate", "object")
    rows = ev.records.agg(
        F.count("*").alias("prediction_total"), unique.alias("prediction_triples_unique"), (F.count("*") - unique).alias("prediction_triples_duplicates"),
        F.count_if("alignable").alias("alignable_predictions"), F.count_if("matched").alias("matched"), F.count_if(F.col("alignable") & ~F.col("matched")).alias("unmatched_alignable"),
        F.count_if(~F.col("matched")).alias("novel_count"), F.count_distinct("p").alias("unique_predicates_total"), F.count_distinct(F.when(~F.col("matched"), F.col("p"))).alias("unique_predicates_novel"),
    )
    ends = ev.gold.select("s").union(ev.gold.select("o")).distinct().agg(F.count("*").alias("ontology_entities_total"))
    gold = ev.gold.agg(F.count("*").alias("gold_total"), F.count_distinct("p").alias("ontology_relations_total"))
    return rows.crossJoin(F.broadcast(gold)).crossJoin(F.broadcast(ends))  # one row each


def alignment_metrics(ev: Evaluation) -> DataFrame:
    c = counts(ev)
    p, r, f = M.prf(F.col("matched"), F.col("alignable_predictions"), F.col("gold_total"))
    return c.select(p.alias("alignment_precision"), r.alias("alignment_recall"), f.alias("alignment_f1"), r.alias("coverage_gold"))


def legacy_metrics(ev: Evaluation) -> DataFrame:
    """The nine rates of compliance."""
    rates = M.compliance_rates(ev.records)
    covered = ev.gold.join(ev.records.select(*A.NORM), A.NORM, "left_semi").agg(F.count("*").alias("covered"))
    total = ev.gold.agg(F.count("*").alias("total"))
    one = rates.crossJoin(F.broadcast(covered)).crossJoin(F.broadcast(total))  # one row each
    # The report's names.
    names = {
        "strict_rate": "strict_precision_exact_triple",
        "normalized_rate": "normalized_precision_exact_triple",
        "relation_known_rate": "relation_valid_rate",
        "relation_semantic_rate": "relation_valid_rate_semantic",
        "domain_ok_rate": "domain_valid_rate",
        "domain_semantic_rate": "domain_valid_rate_semantic",
        "range_ok_rate": "range_valid_rate",
        "range_semantic_rate": "range_valid_rate_semantic",
    }
    return one.select(*(F.col(a).alias(b) for a, b in names.items()), F.round(F.coalesce(F.try_divide("covered", "total"), F.lit(0.0)), 6).alias("ontology_coverage_by_predictions"))


def invalid_examples(ev: Evaluation, n: int = 50) -> DataFrame:
    """The first n predictions whose label form is not in the ontology."""
    return ev.records.where("not normalized").orderBy("pred_id").limit(n).select("pred_id", "subject", "predicate", "object", F.col("legacy_reason").alias("reason"), "mapped_predicate")


def unmatched_examples(ev: Evaluation, n: int = 20) -> DataFrame:
    """At most n alignable but unmatched predictions a cause, and how many the cause has."""
    rows = ev.records.where("alignable and not matched").withColumnRenamed("reason_for_novelty", "cause")
    total = rows.groupBy("cause").agg(F.count("*").alias("cause_count"))
    return M.examples(rows, "cause", "pred_id", n).join(F.broadcast(total), "cause").select("cause", "cause_count", "example_ix", "pred_id", "subject", "predicate", "object", "doc_id", "chunk_id", "section_title")


def novel_examples(ev: Evaluation, predicates: int = 20, n: int = 10) -> DataFrame:
    """At most n novel predictions of each of the most frequent novel predicates."""
    novel = ev.novel.withColumn("place", F.struct("branch", "pred_id"))
    top = M.most_common(novel, "p", "place", predicates)
    return M.examples(novel.join(F.broadcast(top.select("p", "count")), "p"), "p", "place", n).select(F.col("p").alias("top_predicate"), "count", "example_ix", "subject", "predicate", "object", "reason_for_novelty")


def canonical_predicates(stages: DataFrame, triples: str = "schema_canonicalization") -> DataFrame:
    """One row: distinct label forms of the predicates of canonical triples in stage records."""
    rows = stages.select(F.explode(triples).alias("t")).where(F.size("t") == 3)
    return rows.agg(F.count_distinct(A.normalize_label(F.col("t")[1])).alias("unique_predicates_after_canonicalization"))


def report(ev: Evaluation, inputs: dict[str, str | None] | None = None, labels: DataFrame | None = None, stages: DataFrame | None = None, sample_size: int = 100, seed: int = 42, thresholds: tuple[float, float] = (0.85, 0.85), warnings: list[str] | None = None) -> dict:
    """The report with its twelve sections. All that reaches the driver is single rows and top-n lists."""
    one = lambda df: df.first().asDict(recursive=True)
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    c, legacy = one(counts(ev)), one(legacy_metrics(ev))
    sample = checkpointed(review_sample(ev, sample_size, seed))
    top = [{"predicate": r["predicate"], "count": r["count"]} for r in rows(top_predicates(ev, 20).where("scope = 'novel_predictions'"))]
    after = one(canonical_predicates(stages))["unique_predicates_after_canonicalization"] if stages is not None else None
    manual = M.enrichment_precision(labels.join(sample.select("sample_id"), "sample_id")) if labels is not None else None
    strata = ev.novel.agg(F.count_if((F.col("reason_for_novelty") == "unknown_relation") | (F.col("legacy_reason") == "unknown_relation")).alias("unknown"), F.count_if(F.col("legacy_reason").contains("not_allowed")).alias("violations")).first()
    exported = sample.count()
    unknown, violations = min(sample_size // 2, strata.unknown), min(sample_size - sample_size // 2, strata.violations)
    examples: dict[str, list] = {}
    for r in rows(unmatched_examples(ev).orderBy("cause", "example_ix")):
        examples.setdefault(r["cause"], []).append(r)
    novel: dict[str, list] = {}
    for r in rows(novel_examples(ev).orderBy("top_predicate", "example_ix")):
        novel.setdefault(r["top_predicate"], []).append({k: r[k] for k in ("subject", "predicate", "object", "reason_for_novelty")})
    return {
        "input": inputs or {},
        "counts": c,
        "metrics_alignment": one(alignment_metrics(ev)),
        "metrics_enrichment_auto": {
            "novel_count": c["novel_count"], "novel_relation_count": c["unique_predicates_novel"], "novelty_rate": round(c["novel_count"] / c["prediction_total"], 6) if c["prediction_total"] else 0.0,
            "unique_predicates_total": c["unique_predicates_total"], "unique_predicates_novel": c["unique_predicates_novel"], "unique_predicates_after_canonicalization": after, "top_novel_predicates": top,
        },
        "metrics_enrichment_manual": one(manual) if manual is not None else {"enrichment_precision": None, "enrichment_precision_strict": None, "label_counts": {}},
        "metrics_legacy": legacy,
        "metrics": legacy,
        "sampling_info": {
            "sample_size_requested": sample_size, "sample_size_exported": exported, "sampling_seed": seed,
            "strata": {"unknown_relation_or_unmapped_relation": strata.unknown, "domain_range_violation": strata.violations},
            "sampled_strata": {"unknown_relation_or_unmapped_relation": unknown, "domain_range_violation": violations, "fallback_other": max(0, exported - unknown - violations)},
        },
        "thresholds": {"relation_threshold": thresholds[0], "entity_threshold": thresholds[1]},
        "diagnostics": {
            "alignment_relations_indexed": ev.alignment.select("sys").distinct().count(),
            "invalid_reason_counts": {r["legacy_reason"]: r["count"] for r in rows(ev.records.where("not normalized").groupBy("legacy_reason").count())},
            "invalid_examples": rows(invalid_examples(ev)), "alignable_unmatched_cause_counts": {k: v[0]["cause_count"] for k, v in examples.items()}, "alignable_unmatched_examples_top20": examples,
            "top_novel_predicates": top, "novel_examples_by_top_predicate": novel, "warnings": warnings or [],
        },
        "exports": {},
    }
