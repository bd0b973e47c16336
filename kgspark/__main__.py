"""Command line: ``python -m kgspark extract ...`` and ``python -m kgspark evaluate ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.models import read_template
from .operators import evaluation
from .operators.triples import SPO
from .plans.pipeline import JobConfig, run_job, settings_log
from .sources import readers, writers


def extract(spark: SparkSession, args: argparse.Namespace) -> None:
    """Documents to stage records, canonical and useful triples, chunks and a settings log under --out."""
    docs = readers.documents(spark, args.documents, args.mode)
    schema = readers.target_schema(spark, args.schema)
    prompts = {k: read_template(v) for k in ("extract_prompt", "define_prompt", "filter_prompt", "entity_prompt", "merge_prompt") if (v := getattr(args, k))}
    cfg = JobConfig(chunking=args.chunking, iterations=args.refinement_iterations + 1, use_definitions=not args.disable_dc, use_filter=args.filter, enrich=args.enrich_schema, top_k=args.top_k, min_similarity=args.min_similarity, min_margin=args.min_margin, **prompts)
    _, records, stages = run_job(docs, schema, f"{args.out}/stages", cfg)
    chunks = spark.read.parquet(f"{stages.base}/chunks")
    writers.chunk_records(chunks, f"{args.out}/chunks")
    writers.stage_records(records, f"{args.out}/result_at_each_stage")
    writers.literal_lines(records, f"{args.out}/canon_kg", "triples_before_utility_filter")
    if cfg.use_filter:
        writers.literal_lines(records, f"{args.out}/useful_kg", "useful_triplets")
    lines = settings_log(cfg, docs.count(), chunks).splitlines()
    spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, value string").coalesce(1).orderBy("k").select("value").write.text(f"{args.out}/run_settings")


def evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    """Match table, review sample, top predicates and report under --out."""
    lines = readers.triple_lines(spark, args.predictions)
    rows = lines.select("line_ix", F.posexplode("triples").alias("k", "t"))
    preds = readers.global_index(rows, ["line_ix", "k"], "pred_id").select("pred_id", F.col("line_ix").alias("line_idx"), *(F.col("t")[k].alias(c) for k, c in enumerate(SPO)))
    stages = readers.stage_records(spark, args.stages) if args.stages else None
    if stages is not None and "index" in stages.columns:
        preds = evaluation.with_stages(preds, stages)
    alignment = readers.relation_alignment(spark, args.alignment) if args.alignment else spark.createDataFrame([], "sys string, gold_p string, score double")
    ev = evaluation.evaluate(preds, readers.ontology_triples(spark, args.ontology), alignment, args.relation_threshold, args.entity_threshold)
    writers.csv(evaluation.match_rows(ev), f"{args.out}/alignment_matches", evaluation.MATCH_COLUMNS)
    writers.csv(evaluation.review_sample(ev, args.sample_size, args.seed), f"{args.out}/review_sample", evaluation.REVIEW_COLUMNS)
    writers.csv(evaluation.top_predicates(ev), f"{args.out}/top_predicates")
    labels = readers.review_labels(spark, args.labels) if args.labels else None
    inputs = {k: getattr(args, k) for k in ("predictions", "ontology", "alignment", "stages", "labels")}
    report = evaluation.report(ev, inputs, labels, stages, args.sample_size, args.seed, (args.relation_threshold, args.entity_threshold))
    spark.createDataFrame([(json.dumps(report, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.text(f"{args.out}/report")
    print(json.dumps(report["counts"] | report["metrics_alignment"]))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kgspark", description=__doc__)
    sub = p.add_subparsers(required=True)
    e = sub.add_parser("extract", help=extract.__doc__)
    for name in ("documents", "schema", "out"):
        e.add_argument(f"--{name}", required=True)
    e.add_argument("--mode", default="all_combined", choices=["all_combined", "test"])
    e.add_argument("--chunking", default="adaptive", choices=["adaptive", "sentences", "characters"])
    e.add_argument("--refinement-iterations", type=int, default=0)
    e.add_argument("--top-k", type=int, default=3)
    e.add_argument("--min-similarity", type=float, default=0.45)
    e.add_argument("--min-margin", type=float, default=0.08)
    for name in ("disable-dc", "filter", "enrich-schema"):
        e.add_argument(f"--{name}", action="store_true")
    for name in ("extract", "define", "filter", "entity", "merge"):
        e.add_argument(f"--{name}-prompt", help="a template file")
    e.set_defaults(run=extract)
    v = sub.add_parser("evaluate", help=evaluate.__doc__)
    for name in ("predictions", "ontology", "out"):
        v.add_argument(f"--{name}", required=True)
    for name in ("alignment", "stages", "labels"):
        v.add_argument(f"--{name}")
    v.add_argument("--relation-threshold", type=float, default=0.85)
    v.add_argument("--entity-threshold", type=float, default=0.85)
    v.add_argument("--sample-size", type=int, default=100)
    v.add_argument("--seed", type=int, default=42)
    v.set_defaults(run=evaluate)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
