"""Hints for the next round of extraction: entities found and merged, relations retrieved from the schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import Completer, Embedder, complete, embed, entity_completer, hashing_embedder, prompt
from ..functions.parsing import entities as read_entities
from ..functions.text import literal
from .canonicalize import hint_text
from .retrieval import ranked_lists, top_k

RETRIEVE = "Retrieve descriptions of relations that are present in the given text."


def listed(items: Column) -> Column:
    """A list of strings as a Python literal."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, literal), ", "), F.lit("]"))


def previous(triples: DataFrame, key: str = "chunk_id", order: str = "triple_ix") -> DataFrame:
    """(key, entities, relations) of the last round's triples, each once in first-seen order."""
    rows = triples.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "subject", "predicate", "object"))).alias("l"))
    ends = F.array_distinct(F.flatten(F.transform("l", lambda t: F.array(t.subject, t.object))))
    return rows.select(key, ends.alias("entities"), F.array_distinct(F.transform("l", lambda t: t.predicate)).alias("relations"))


def extract_entities(chunks: DataFrame, template: str, completer: Callable[[], Completer] = entity_completer, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, found): entities that a model names; an answer without a list has none."""
    asked = complete(chunks.select(key, prompt(template, text=F.col(text)).alias("_p")), "_p", "_a", completer)
    return asked.select(key, F.coalesce(read_entities(F.col("_a")), F.array().cast("array<string>")).alias("found"))


def merge_entities(lists: DataFrame, template: str, completer: Callable[[], Completer], key: str = "chunk_id") -> DataFrame:
    """(key, merged): what a model makes of two lists (entities, found) and the text; an answer without a list keeps both lists' union."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce("entities", none), F.coalesce("found", none)
    filled = prompt(template, text=F.col("text"), entity_list_1=listed(a), entity_list_2=listed(b))
    asked = complete(lists.withColumn("_p", filled), "_p", "_a", completer)
    read = read_entities(F.col("_a"))
    return asked.select(key, F.when(F.size(read) > 0, read).otherwise(F.array_union(a, b)).alias("merged"))


def retrieve_relations(chunks: DataFrame, schema: DataFrame, k: int = 10, embedder: Callable[[], Embedder] = hashing_embedder, instruction: str = RETRIEVE, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, retrieved): the k relations whose definitions are nearest to the chunk. Queries carry an instruction, definitions do not."""
    asked = chunks.select(key, F.concat(F.lit(f"Instruct: {instruction}\nQuery: " if instruction else ""), text).alias("q"))
    q = embed(asked, "q", "embedding", embedder)
    s = embed(schema.select("relation", "definition"), "definition", "embedding", embedder)
    return ranked_lists(top_k(q, s, k, key, "relation"), key, "relation").select(key, F.col("items").alias("retrieved"))


def relation_examples(triples: DataFrame, chunks: DataFrame, key: str = "chunk_id", order: str = "triple_ix") -> DataFrame:
    """(relation, example): the line of each relation's first occurrence (by key and place), with its text."""
    first = triples.groupBy("predicate").agg(F.min(F.struct(key, order, "subject", "object")).alias("f"))
    at = first.select(F.col("predicate").alias("relation"), F.col("f")[key].alias(key), "f.subject", "f.object").join(chunks.select(key, "text"), key)
    shown = listed(F.array("subject", "relation", "object"))
    return at.select("relation", F.concat(F.lit("For example, "), shown, F.lit(' can be extracted from "'), "text", F.lit('"')).alias("example"))


def refinement_hints(chunks: DataFrame, triples: DataFrame, schema: DataFrame, entity_template: str, merge_template: str, k: int = 10, completer: Callable[[], Completer] = entity_completer, embedder: Callable[[], Embedder] = hashing_embedder, key: str = "chunk_id") -> DataFrame:
    """(key, entity_hint, relation_hint) of every chunk.

    Entities: those of the last round and those that a model finds, merged by a model.
    Relations: those of the last round, then the retrieved ones, each once; only those of
    the schema are printed, numbered by their place, with an example from the last round.
    """
    none = F.array().cast("array<string>")
    before = previous(triples, key)
    lists = chunks.select(key, "text").join(before.select(key, "entities"), key, "left").join(extract_entities(chunks, entity_template, completer, key), key, "left")
    ents = merge_entities(lists, merge_template, completer, key)
    known = F.map_from_entries(F.collect_list(F.struct("relation", "definition")))
    one = schema.groupBy("relation").agg(F.first("definition").alias("definition")).agg(known.alias("definitions"))
    shown = relation_examples(triples, chunks, key).join(schema.select("relation").distinct(), "relation", "left_semi").agg(F.map_from_entries(F.collect_list(F.struct("relation", "example"))).alias("examples"))
    rels = chunks.select(key).join(before.select(key, "relations"), key, "left").join(retrieve_relations(chunks, schema, k, embedder, key=key), key, "left")
    rels = rels.withColumn("all", F.array_union(F.coalesce("relations", none), F.coalesce("retrieved", none)))
    rels = rels.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(shown))  # one row each: the schema's definitions and examples
    text = hint_text(F.col("all"), F.col("definitions"), F.col("examples"))
    return rels.select(key, text.alias("relation_hint")).join(ents.select(key, listed(F.col("merged")).alias("entity_hint")), key)
