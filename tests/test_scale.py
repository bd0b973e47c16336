"""Steps that must not grow faster than their input: bounds, and the same results as plain versions."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from pyspark.sql import functions as F

from kgspark.operators import alignment, canonicalize, chunking, evaluation, layout, ordering, retrieval, spans


def test_sequence_ratio_in_slices(spark, monkeypatch):
    """pairs are compared in blocks against slices of gold, names of one alphabet and length too; no pair of tokens is joined for the ratio."""
    monkeypatch.setattr(alignment, "SLICE_LETTERS", 500)
    monkeypatch.setattr(alignment, "PAIRS_A_TASK", 1000)
    rng = random.Random(11)
    text = lambda n, signs: "".join(rng.choice(signs) for _ in range(n))
    mine = [f"supplier {rng.randrange(10**4):09d}" for _ in range(60)] + [text(rng.randint(1, 9), "ab1") for _ in range(60)] + ["x" * 70, "é日 " * 30, text(210, "abc"), "a b c"]
    theirs = [f"supplier {rng.randrange(10**4):09d}" for _ in range(50)] + [text(rng.randint(1, 9), "ab1") for _ in range(50)] + ["x" * 66, "é日 " * 29, mine[-2][:200] + "b", "c b a"]
    gold = spark.createDataFrame([(x, "r", x) for x in theirs], "s string, p string, o string")
    jaccard = lambda a, b: len(set(a.split()) & set(b.split())) / max(1, len(set(a.split()) | set(b.split())))
    want = {(a, b): s for a in set(mine) for b in set(theirs) if (s := max(SequenceMatcher(None, a, b).ratio(), jaccard(a, b))) >= 0.8}
    got = alignment.entity_candidates(spark.createDataFrame([(x,) for x in mine], "entity string"), gold, 0.8)
    assert "SortMergeJoin" not in alignment._alike(gold.select(gold.s.alias("entity")), gold.select(gold.s.alias("gold_entity")), 0.8)._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert len(rows) == len(want) > 300 and {(r.entity, r.gold_entity): r.score for r in rows} == want


def _plain_top(queries, items, k):
    """Scores as an ordered sum; nulls last, ties by id."""

    def dot(x, y):
        if x is None or y is None or len(x) != len(y) or None in [*x, *y]:
            return None
        s = 0.0
        for a, b in zip(x, y, strict=True):
            s += a * b
        return s

    key = lambda p: (p[1] is None, -(p[1] or 0.0), p[0])
    return {q: sorted(((i, dot(x, y)) for i, y in items), key=key)[:k] for q, x in queries}


@pytest.mark.parametrize("numbers", [16 << 20, 100])
@pytest.mark.parametrize("many", ["items", "queries"])
def test_top_k_by_products(spark, monkeypatch, numbers, many):
    """F2, F12, F13: scores to the last bit, copies by id, odd vectors too, with no pair of vectors made in a join."""
    monkeypatch.setattr(retrieval, "BROADCAST_NUMBERS", numbers)
    monkeypatch.setattr(retrieval, "ROWS", 16)
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(90, 7)).astype(np.float32)] + [[0.5] * 7] * 20
    rng.shuffle(vectors)
    items, queries = [(f"i{k:03d}", v) for k, v in enumerate(vectors)], [(k, vectors[3 * k]) for k in range(20)] + [(90, [0.5] * 7), (91, [0.0] * 7)]
    if many == "queries":
        items, queries = items[:13], [(k, v) for k, (_, v) in enumerate(items)]
    table = lambda rows, kind: spark.createDataFrame(rows, f"id {kind}, embedding array<float>").repartition(3)
    plan = retrieval.top_k(table(queries, "bigint"), table(items, "string").withColumnRenamed("id", "item"), 4, "id", "item")
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()
    for more_queries, more_items in (([], []), ([(200, None), (201, [1.0, None, 1.0, 0.0, 0.0, 0.0, 0.0])], [("a", [1.0] * 3), ("z", None), ("b", [])])):
        q, i = queries + more_queries, items + more_items
        got = {}
        for r in retrieval.top_k(table(q, "bigint"), table(i, "string").withColumnRenamed("id", "item"), 4, "id", "item").orderBy("id", "rank").collect():
            got.setdefault(r.id, []).append((r.item_item, r.score))
        assert got == _plain_top(q, i, 4)


@pytest.mark.parametrize("rows", [500_000, 0])
def test_hot_relation_is_not_one_task(spark, monkeypatch, rows):
    """F3 to F11, F14, F16, F17, F19: predictions of one relation stay spread, whether or not the vocabulary can be sent."""
    monkeypatch.setattr(ordering, "BROADCAST_ROWS", rows)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(kept, ("-1", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        preds = spark.range(4000, numPartitions=8).selectExpr("id AS pred_id", "concat('a', id) AS subject", "'placed by' AS predicate", "concat('b', id) AS object", "concat('something ', id % 3) AS definition")
        named = alignment.with_norm(preds)
        gold = spark.createDataFrame([("a1", "placed by", "b1"), ("a2", "near", "b2")], "subject string, predicate string, object string")
        align = spark.createDataFrame([("placed by", "near", 0.9)], "sys string, gold_p string, score double")
        relations, entities = spark.createDataFrame([("placed by",)], "p string"), spark.createDataFrame([("a1",), ("b1",), ("a2",)], "entity string")
        schema = spark.createDataFrame([(0, "placed by", "x")], "ord int, relation string, definition string")
        for made in (evaluation.alignable(named, relations, entities), alignment.compliance(named, gold, align, 0.85), canonicalize.canonicalize(preds, schema)):
            sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 4000 and max(sizes) < 1500, sizes
        told = {r.pred_id: r.not_alignable for r in evaluation.alignable(named, relations, entities).collect()}
        assert told == {k: None if k == 1 else "entity_mismatch" for k in range(4000)}
        strict = alignment.compliance(named, gold, align, 0.85).where("strict").select("pred_id", "reason").collect()
        assert [tuple(r) for r in strict] == [(1, "in_ontology")]
        assert canonicalize.canonicalize(preds, schema).where("canonical = 'placed by'").count() == 4000
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_edges_and_causes_by_form(spark, monkeypatch):
    """F3 to F11: what many predictions of one form share is joined once; each gets all of it."""
    pairs = {}
    real = alignment.checkpointed
    monkeypatch.setattr(alignment, "checkpointed", lambda df: pairs.setdefault(tuple(df.columns), real(df)))
    preds = spark.range(600).selectExpr("id AS pred_id", "'x' AS s", "'r' AS p", "'h' AS o")
    gold = spark.createDataFrame([("h", "r", f"t{k}") for k in range(50)] + [("h", "r", "x")], "s string, p string, o string")
    relations = spark.createDataFrame([("r", "r", 1.0)], "p string, gold_p string, score double")
    entities = spark.createDataFrame([(e, e, 1.0) for e in ("x", "h")], "entity string, gold_entity string, score double")
    causes = alignment.diagnose(preds, gold, relations, entities)
    assert [tuple(r) for r in causes.select("s", "p", "o", "cause").collect()] == [("x", "r", "h", "direction_mismatch")]
    assert pairs["s", "p", "o"].count() == 1
    turned = preds.selectExpr("pred_id", "o AS s", "p", "s AS o")
    assert sorted(r.pred_id for r in alignment.edges(turned, gold, relations, entities).collect()) == list(range(600))


def test_text_lines_hold_a_line(spark, monkeypatch):
    """a page's words are read in order and are not a table of their own."""
    rng = random.Random(2)
    words = [(p, rng.choice("abcd") + str(k), float(rng.randrange(50)), rng.choice([0.0, 2.0, 3.04, 3.06, 7.5, 40.0, 41.0])) for p in range(5) for k in range(80)]
    rows = words + [(9, "late", None, 1.0), (9, "b", 2.0, 1.0), (9, "last", 0.0, None)]
    plan = layout.text_lines(spark.createDataFrame(rows, "page bigint, text string, x0 double, top double"))
    assert "FlatMapGroups" not in plan._jdf.queryExecution().optimizedPlan().toString()
    want = [(9, 0, "last b late")]
    for p in range(5):
        page = sorted((w for w in words if w[0] == p), key=lambda w: (round(w[3] * 10), w[2], w[1]))
        lines = layout.line_groups([w[3] for w in page])
        want += [(p, k, " ".join(w[1] for w in sorted((w for w, at in zip(page, lines, strict=True) if at == k), key=lambda w: w[2]))) for k in set(lines)]
    assert sorted(map(tuple, plan.collect())) == sorted(want)


def test_span_patterns(spark):
    """entries of one pattern are scored once and count as many."""
    assert spans.pattern([["Ann Lee", "is", "x"]], [["ann", "is x", "q"]]) == spans.pattern([["Bob May", "has", "y"]], [["BOB", "has y", "w"]]) != spans.pattern([["Ann Lee", "is", "x"]], [["lee", "is x", "q"]])
    rows = [([["a", "b", "c"], ["d e", "f", "g"]], [["d", "f", "g"]])] * 3 + [([["k", "l", "m"]], [["m", "l", "k"]])]
    got = {(r.scheme, r.slot): r for r in spans.span_scores(spark.createDataFrame(rows, "ref array<array<string>>, cand array<array<string>>"), "ref", "cand").collect()}
    for scheme in spans.SCHEMES:
        pairs = [p for ref, cand in rows for p in spans.entry_pairs(ref, cand)]
        for k, slot in enumerate(spans.SLOTS):
            assert {c: got[scheme, slot][c] for c in spans.COUNTS} == {c: sum(p[k][scheme][c] for p in pairs) for c in spans.COUNTS}
            assert got[scheme, slot].f1 == pytest.approx(np.mean([spans.rates(scheme, p[k][scheme])[2] for p in pairs]), abs=1e-6)


def test_chunks_leave_by_letters(spark, monkeypatch):
    """a batch's documents are not all held as chunks at once, and the rows are those of the documents one by one."""
    monkeypatch.setattr(chunking, "PART_LETTERS", 500)
    texts = {k: "\n".join(f"Sentence {j} of {k} goes on and on." for j in range(k % 40)) for k in range(120)}
    plan = chunking.adaptive_chunks(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"))
    assert "ArrowEvalPython" not in plan._jdf.queryExecution().optimizedPlan().toString()
    want = {(k, i): c for k, t in texts.items() for i, c in enumerate(chunking.document_chunks(str(k), t))}
    assert {(r.doc_id, r.chunk_ix): {c: r[c] for c in plan.columns[2:]} for r in plan.collect()} == want and len(want) > 120
