"""Rates, histograms, precision and recall, review samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def round_even(c: Column, digits: int = 6) -> Column:
    """Rounded half to even, as binary floats usually are; SQL's round goes half up."""
    return F.bround(c, digits)


def rate(flag: Column) -> Column:
    return F.round(F.coalesce(F.avg(flag.cast("double")), F.lit(0.0)), 6)


def compliance_rates(flagged: DataFrame) -> DataFrame:
    names = ["strict", "normalized", "relation_known", "domain_ok", "range_ok", "relation_semantic", "domain_semantic", "range_semantic"]
    return flagged.agg(F.count("*").alias("predictions"), *(rate(F.col(n)).alias(n + "_rate") for n in names))


def prf(matched: Column, predicted: Column, gold: Column) -> list[Column]:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = zero(F.try_divide(matched, predicted)), zero(F.try_divide(matched, gold))
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(zero(F.try_divide(2 * p * r, p + r)), 6).alias("f1")]


def most_common(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The n most frequent values, ties by first occurrence: a top-k report."""
    counts = df.groupBy(key).agg(F.count("*").alias("count"), F.min(order).alias("first"))
    return counts.orderBy(F.desc("count"), "first").limit(n).select(key, "count")


def examples(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """At most n rows a key in order."""
    return df.withColumn("example_ix", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("example_ix") <= n)


def enrichment_precision(labels: DataFrame, label: str = "label") -> DataFrame:
    s, u, p = (F.count_if(F.col(label) == x) for x in ("SUPPORTED", "UNSUPPORTED", "PARTIALLY_SUPPORTED"))
    return labels.agg(s.alias("supported"), p.alias("partial"), u.alias("unsupported"), F.round(F.try_divide(s, F.count(label)), 6).alias("precision"), F.round(F.try_divide(s, s + u), 6).alias("strict_precision"))


def macro_prf(pairs: DataFrame) -> DataFrame:
    """Macro average over classes of rows (entry, class, in_gold, in_pred)."""
    tp, fp, fn = F.count_if(F.col("in_gold") & F.col("in_pred")), F.count_if(~F.col("in_gold") & F.col("in_pred")), F.count_if(F.col("in_gold") & ~F.col("in_pred"))
    per = pairs.groupBy("class").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r, f = zero(F.try_divide("tp", F.col("tp") + F.col("fp"))), zero(F.try_divide("tp", F.col("tp") + F.col("fn"))), zero(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return per.agg(F.round(F.avg(p), 6).alias("macro_precision"), F.round(F.avg(r), 6).alias("macro_recall"), F.round(F.avg(f), 6).alias("macro_f1"))


def arithmetic_hash(c: Column, seed: int) -> Column:
    """A hash that any SQL engine computes alike."""
    return F.pmod((c + seed) * F.lit(2654435761), F.lit(1 << 32))


def stratified_sample(novel: DataFrame, size: int, seed: int, id_col: str = "pred_id", reason: str = "reason") -> DataFrame:
    """Half from unknown relations, half from domain or range violations, the rest from all others, by hash order."""
    h = arithmetic_hash(F.col(id_col), seed)
    stratum = F.when(F.col(reason) == "unknown_relation", 0).when(F.col(reason).contains("not_allowed"), 1).otherwise(2)
    ranked = novel.withColumns({"stratum": stratum, "_h": h})
    want = F.when(F.col("stratum") == 0, size // 2).when(F.col("stratum") == 1, size - size // 2).otherwise(0)
    # No stratum gives more than ``size`` rows, so what a single task orders is bounded by 3 * size.
    few = ranked.withColumn("_r", F.row_number().over(W.partitionBy("stratum").orderBy("_h", id_col))).where(F.col("_r") <= size)
    order = [F.when(F.col("_r") <= want, F.col("stratum")).otherwise(2), F.col("_h"), F.col(id_col)]
    return few.orderBy(*order).limit(size).drop("_h", "_r")
