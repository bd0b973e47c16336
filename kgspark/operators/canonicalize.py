"""Schema canonicalisation, enrichment, utility filter, retrieval hints."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.models import Completer, Embedder, complete, embed_distinct, hashing_embedder, rule_completer
from ..functions.parsing import parse_completion
from .ordering import join_vocabulary
from .retrieval import gate, ranked_lists, top_k

MAX_ORDERED = 200_000


def canonicalize(triples: DataFrame, schema: DataFrame, k: int = 3, least: float | None = 0.45, margin: float | None = 0.08, embedder: Callable[[], Embedder] = hashing_embedder, verify: Callable[[], Completer] | None = None) -> DataFrame:
    """Add ``canonical``: the schema relation of each triple, or null.

    triples has predicate and definition; schema has relation, definition, ord. A
    predicate of the schema stays. Others are looked up by definition once a distinct
    definition, gated, and offered to the verifier if there is one.
    """
    known = schema.select(F.col("relation").alias("predicate"), F.col("relation").alias("_same"))
    open_ = join_vocabulary(triples, known, "predicate", "left_anti").where("definition is not null").select(F.col("definition").alias("query")).distinct()
    q = embed_distinct(open_, "query", "embedding", embedder)
    s = embed_distinct(schema.select("relation", F.concat("relation", F.lit(": "), "definition").alias("t")), "t", "embedding", embedder).select("relation", "embedding")
    best = ranked_lists(top_k(q, s, k, "query", "relation"), "query", "relation")
    best = best.withColumn("first", F.when(gate(F.col("scores"), least, margin), F.get("items", 0)))
    if verify is not None:
        told = best.select("query", F.posexplode("items").alias("i", "relation")).join(schema.select("relation", F.col("definition").alias("_d")), "relation", "left")
        told = told.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "relation", F.coalesce("_d", F.lit("")).alias("definition")))), lambda x: F.struct(x.relation.alias("relation"), x.definition.alias("definition"))).alias("offered"))
        offered = F.col("offered")
        best = best.join(told, "query", "left")
        asked = complete(best.where("first is not null").withColumn("prompt", F.concat("query", F.lit("\n"), X.choice_list(offered))), "prompt", "answer", verify)
        best = asked.withColumn("first", X.choice(F.col("items"), F.col("answer")))
    found = best.select(F.col("query").alias("definition"), F.col("first").alias("_found"))
    return join_vocabulary(join_vocabulary(triples, known, "predicate"), found, "definition").withColumn("canonical", F.coalesce("_same", "_found")).drop("_same", "_found")


def enrich(open_relations: list[tuple[str, str]], schema: list[tuple[str, str]], embed: Embedder, least: float, margin: float, verify: Callable[[str, str, list[tuple[str, str]]], str | None] | None = None) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Map open relations in first-seen order to the schema, which grows by those that nothing fits.

    This fold is sequential by nature: a decision depends on earlier additions. It runs
    over distinct relations (not triples), at most MAX_ORDERED of them; all are embedded
    in one call, and a step is one product of the schema's matrix with a vector.
    ``verify`` is asked where the scores pass (name, definition, candidates) and may return None.
    """
    if len(open_relations) + len(schema) > MAX_ORDERED:
        raise ValueError(f"{len(open_relations)} distinct relations and {len(schema)} of the schema are more than the ordered fold takes ({MAX_ORDERED})")
    grown = list(schema)
    names = {r for r, _ in grown}
    texts = [f"{r}: {d}" for r, d in [*grown, *open_relations]]
    vectors = np.asarray(embed(texts)) if texts else np.zeros((0, 1))
    rows = list(range(len(grown)))  # the vector of each relation of the schema
    matrix = np.empty_like(vectors)
    matrix[: len(rows)] = vectors[: len(rows)]
    mapping: dict[str, str] = {}
    for k, (relation, definition) in enumerate(open_relations):
        if relation in names:
            mapping[relation] = relation
            continue
        if not definition:
            continue
        v = vectors[len(schema) + k]
        scores = matrix[: len(grown)] @ v
        order = np.argsort(-scores, kind="stable")[:5]
        chosen = None
        if len(order) and scores[order[0]] >= least and (len(order) < 2 or scores[order[0]] - scores[order[1]] >= margin):
            chosen = grown[int(order[0])][0] if verify is None else verify(relation, definition, [grown[int(i)] for i in order])
        if chosen is None:
            chosen = relation
            matrix[len(grown)] = v
            grown.append((relation, definition))
            names.add(relation)
        mapping[relation] = chosen
    return mapping, grown


def canonicalize_enriched(triples: DataFrame, schema: DataFrame, order: str, least: float = 0.45, margin: float = 0.08, embedder: Callable[[], Embedder] = hashing_embedder, verify: Callable[[], Completer] | None = None) -> DataFrame:
    """Like canonicalize, with the schema enriched on the way; distinct relations in first-seen order by ``order``.

    The distinct relations are a vocabulary; more than MAX_ORDERED are an error.
    """
    seen = triples.groupBy("predicate").agg(F.min(order).alias("o"), F.min_by("definition", order).alias("definition"))
    rows = seen.orderBy("o", "predicate").limit(MAX_ORDERED + 1).collect()
    base = [(r.relation, r.definition) for r in schema.orderBy("ord").limit(MAX_ORDERED + 1).collect()]
    ask = None
    if verify is not None:
        model = verify()

        def ask(relation: str, definition: str, offered: list[tuple[str, str]]) -> str | None:
            lines = [f"{chr(65 + i)}. '{r}': {d}\n" for i, (r, d) in enumerate(offered)]
            answer = model([f"{definition}\n{''.join(lines)}{chr(65 + len(offered))}. None of the above.\n"])[0]
            at = ord(answer[0]) - 65 if answer else -1
            return offered[at][0] if 0 <= at < len(offered) else None

    mapping, _ = enrich([(r.predicate, r.definition) for r in rows], base, embedder(), least, margin, ask)
    table = triples.sparkSession.createDataFrame(list(mapping.items()), "predicate string, canonical string")
    return triples.join(F.broadcast(table), "predicate", "left")  # at most MAX_ORDERED rows


def utility_filter(chunks: DataFrame, triples: str, prompt: str, completer: Callable[[], Completer] = rule_completer) -> DataFrame:
    """Replace ``triples`` by what the model returns for the prompt; unreadable answers and empty inputs keep theirs."""
    full = complete(chunks.where(F.size(triples) > 0), prompt, "_answer", completer).withColumn("_new", parse_completion("_answer"))
    readable = (F.size("_new") > 0) | F.regexp_replace("_answer", r"\s", "").contains("[]")
    full = full.withColumn("parse_ok", readable).withColumn(triples, F.when(readable, F.col("_new")).otherwise(F.col(triples))).drop("_answer", "_new")
    empty = chunks.where((F.size(triples) == 0) | F.col(triples).isNull()).withColumn("parse_ok", F.lit(True))
    return full.unionByName(empty)


def hint_text(relations: F.Column, definitions: F.Column, examples: F.Column | None = None) -> F.Column:
    """Numbered hint lines of the relations that have a definition, each with its example if there is one; numbers are places in the hint list."""
    line = lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r, F.lit(": "), F.try_element_at(definitions, r))
    full = line if examples is None else lambda r, i: F.concat(line(r, i), F.coalesce(F.concat(F.lit("\n"), F.try_element_at(examples, r)), F.lit("")))
    lines = F.transform(relations, lambda r, i: F.when(F.try_element_at(definitions, r).isNotNull(), full(r, i)))
    return F.array_join(F.array_compact(lines), "\n")


def refine_hints(previous: DataFrame, retrieved: DataFrame, key: str, definitions: F.Column) -> DataFrame:
    """(key, relations, hint): relations of the last round, then the retrieved ones, each once."""
    none = F.array().cast("array<string>")
    out = previous.join(retrieved, key, "full").withColumn("relations", F.array_union(F.coalesce("previous", none), F.coalesce("retrieved", none)))
    return out.select(key, "relations", hint_text(F.col("relations"), definitions).alias("hint"))
