"""Training pairs for a schema retriever: sentences with relations that they hold and relations that they do not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .metrics import arithmetic_hash
from .ordering import global_index


def explicit(triples: F.Column, text: F.Column) -> F.Column:
    """The triples whose subject and object stand in the text, in any case."""
    low = F.lower(text)
    return F.filter(triples, lambda t: (F.size(t) == 3) & low.contains(F.lower(t[0])) & low.contains(F.lower(t[2])))


def training_pairs(rows: DataFrame, per_sentence: int = 2, seed: int = 0, dataset_size: int | None = None) -> DataFrame:
    """(id, pair_ix, sentence, positive, negative, positive_relation, negative_relation, positive_triples).

    rows: id (bigint), text, triples, definitions (a map). A sentence's positive relations
    are those of its explicit triples that it defines, by name. As many others follow from
    a place in the ordered list of all relations that depends on id and seed; they are
    never positive ones. A negative relation is described by its first definition.
    """
    found = rows.withColumn("_t", explicit(F.col("triples"), F.col("text")))
    named = found.withColumn("pos", F.array_sort(F.array_distinct(F.filter(F.transform("_t", lambda t: t[1]), lambda r: F.try_element_at("definitions", r).isNotNull())))).where(F.size("pos") > 0)
    told = rows.select("id", F.explode("definitions").alias("relation", "definition"))
    every = global_index(told.groupBy("relation").agg(F.min_by("definition", "id").alias("definition")), ["relation"], "place")
    total = every.agg(F.count("*").alias("total"))
    start = F.pmod(arithmetic_hash(F.col("id"), seed), F.col("total"))
    want = F.least(F.size("pos"), F.lit(per_sentence))
    tries = named.crossJoin(F.broadcast(total)).withColumn("_k", F.explode(F.sequence(F.lit(0), F.least(F.size("pos") + want - 1, F.col("total").cast("int") - 1))))  # one row
    tries = tries.withColumn("place", F.pmod(start + F.col("_k"), F.col("total"))).join(every, "place").where(~F.array_contains("pos", F.col("relation")))
    ranked = tries.withColumn("pair_ix", F.row_number().over(W.partitionBy("id").orderBy("_k")) - 1).where(F.col("pair_ix") < want)
    mine = F.get("pos", F.col("pair_ix"))
    out = ranked.select(
        "id", "pair_ix", F.col("text").alias("sentence"), F.concat(mine, F.lit(": "), F.element_at("definitions", mine)).alias("positive"), F.concat("relation", F.lit(": "), "definition").alias("negative"),
        mine.alias("positive_relation"), F.col("relation").alias("negative_relation"), F.filter("_t", lambda t: t[1] == mine).alias("positive_triples"),
    )
    return out if dataset_size is None else out.orderBy("id", "pair_ix").limit(dataset_size)


def crawl_choice(rows: DataFrame, relations: int = 5) -> list[int]:
    """Ids of sentences, in order, that bring only relations not seen before, until there are so many relations. The driver reads no further."""
    seen: set[str] = set()
    out = []
    for r in rows.select("id", "triples").orderBy("id").toLocalIterator():
        if len(seen) >= relations:
            break
        if all(len(t) == 3 and t[1] not in seen for t in r.triples):
            seen |= {t[1] for t in r.triples}
            out.append(r.id)
    return out
