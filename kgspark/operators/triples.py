"""Triples as rows: explode, ordered deduplication, multiset change traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPO = ["subject", "predicate", "object"]


def valid_triple(t: Column) -> Column:
    return (F.size(t) == 3) & ~F.exists(t, lambda e: e.isNull() | e.isin("", "_"))


def explode_triples(df: DataFrame, triples: str = "triples") -> DataFrame:
    """One row a valid triple, with its place in the list; lists without any vanish here and come back by a left join on the key."""
    kept = df.select("*", F.posexplode(F.filter(triples, valid_triple)).alias("triple_ix", "_t"))
    return kept.select("*", *(F.col("_t")[k].alias(c) for k, c in enumerate(SPO))).drop("_t", triples)


def first_seen(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row a key: the first by ``order`` (aggregated before the shuffle, unlike a window)."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(order.alias("_o"), *rest)).alias("_b"))
    return best.select(*keys, *(F.col("_b")[c].alias(c) for c in rest))


def change_trace(before: DataFrame, after: DataFrame, group: str, items: list[str]) -> DataFrame:
    """Per group: how many items of two multisets are unchanged, removed, added and (the lesser of both) rewritten."""
    side = lambda df, b, a: df.select(group, *items, F.lit(b).alias("b"), F.lit(a).alias("a"))
    counts = side(before, 1, 0).unionByName(side(after, 0, 1)).groupBy(group, *items).agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    out = counts.groupBy(group).agg(F.sum(F.least("a", "b")).alias("unchanged"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("removed"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("added"))
    return out.withColumn("rewritten", F.least("removed", "added"))


def dropped(n_in: Column, n_out: Column) -> Column:
    return F.sum(F.greatest(n_in - n_out, F.lit(0)))
