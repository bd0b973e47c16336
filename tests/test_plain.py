"""Operators that SQL cannot express, against plain versions on small tables."""

import ast
import itertools
import json
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import kgspark.__main__ as cli
import kgspark.plans.more_queries  # noqa: F401
from kgspark.functions import models, parsing
from kgspark.functions import text as X
from kgspark.operators import alignment, canonicalize, chunking, evaluation, layout, refinement, spans
from kgspark.plans import pipeline
from kgspark.plans.queries import QUERIES
from kgspark.sources import readers, writers
from kgspark.streaming import dedup

DATA = "/root/testdata/sf0.001"


def test_entity_candidates_all_pairs(spark):
    rng = random.Random(4)
    words = ["data", "model", "view", "the", "node", "edge", "of", "x1", "supplier", "customer"]
    names = lambda n: [" ".join(rng.choice(words) + rng.choice(["", "", "s", "z"]) for _ in range(rng.randint(1, 7))) for _ in range(n)]
    mine, theirs = [*names(120), "", "supplier 0001", None], [*names(120), "", "supplier 0002", "supplier 0001"]
    jaccard = lambda a, b: len(set(a.split()) & set(b.split())) / max(1, len(set(a.split()) | set(b.split())))
    gold = spark.createDataFrame([(a, "r", a) for a in theirs], "s string, p string, o string")
    for threshold in (0.85, 0.6):
        want = {}
        for a, b in itertools.product({x for x in mine if x is not None}, set(theirs)):
            score = 1.0 if a == b else max(SequenceMatcher(None, a, b).ratio(), jaccard(a, b))
            if score >= threshold:
                want[a, b] = score
        got = alignment.entity_candidates(spark.createDataFrame([(x,) for x in mine], "entity string"), gold, threshold).collect()
        assert {(r.entity, r.gold_entity): pytest.approx(r.score) for r in got} == want


def test_greedy_is_one_by_one(spark):
    rng = random.Random(7)
    edges = [(p, f"s{g}", "r", f"o{g}", rng.choice([0.9, 1.0]), rng.choice([0.85, 0.9, 1.0]), rng.choice([0.85, 1.0])) for p in range(60) for g in rng.sample(range(40), 4)]
    rows = [(*e, (e[5] + e[4] + e[6]) / 3) for e in edges]
    df = spark.createDataFrame(rows, "pred_id int, gs string, gp string, go string, relation_score double, subject_score double, object_score double, overall double")
    used, want = set(), []
    for e in sorted(rows, key=lambda e: (-e[7], -e[4], -e[5], -e[6], e[0], e[2], e[1], e[3])):
        if not {("p", e[0]), ("g", e[1])} & used:
            used |= {("p", e[0]), ("g", e[1])}
            want.append((e[0], e[1], e[7]))
    got = alignment.greedy_match(df).collect()
    assert sorted((r.pred_id, r.gs, r.overall) for r in got) == sorted(want) and len(want) < 60




def test_label_and_text_forms(spark):
    cases = {' "Solar Panel"@en ': "solar panel", "R&D-Unit": "r and d unit", "XMLHttpRequest": "xml http request", "a@en-us  ": "a", "Straße": "strasse"}
    df = spark.createDataFrame(list(cases.items()), "a string, b string")
    assert all(r.x == r.b for r in df.select("b", X.normalize_label(F.col("a")).alias("x")).collect())
    texts = ["A construct", "x A thing", "é A bcd", "B  c", "AB cd", None, ""]
    fixed = lambda t: re.sub(r"\b([A-Z])\s+([a-z][a-zA-Z]+)\b", r"\1\2", t)
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.fix_spaced_word(F.col("t")).alias("x")).collect()
    assert all(r.x == (None if r.t is None else fixed(r.t)) for r in got)


@pytest.mark.parametrize("name", ["cell_fixes"])
def test_cell_fixes_table(spark, name):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in QUERIES[name](spark, DATA).collect():
        d = docs[r.doc_id]
        assert r.name == re.search(r"[^#/:]+$", f"{d.source}/{d.lang}#src:{d.source}")[0]
        assert r.fixed == re.sub(r"\b([A-Z])\s+([a-z][a-zA-Z]+)\b", r"\1\2", re.sub("\r\n?", "\n", d.text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=12), max_size=12), st.integers(1, 30), st.integers(0, 3))
def test_packed_runs(lines, most, overlap):
    runs = chunking.pack_by_length(lines, most, overlap)
    start = 0
    for k, run in enumerate(runs):
        assert run == lines[start : start + len(run)] and run
        assert len(run) == 1 or len("\n".join(run)) <= most
        stop = start + len(run)
        if stop < len(lines):
            assert len("\n".join(lines[start : stop + 1])) > most
        else:
            assert k == len(runs) - 1
        start = max(start + 1, stop - overlap)
    assert not lines or sum(map(len, runs)) >= len(lines)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["section_prose", "section_bullets", "table_json"]), st.sampled_from("AB"), st.integers(1, 60)), max_size=12))
def test_short_chunks_join(parts):
    make = lambda k, p: {"chunk_type": p[0], "section_id": p[1], "section_title": "T", "text": f"{k}:" + "x" * p[2], "merged": False}
    chunks = [make(k, p) for k, p in enumerate(parts)]
    out = chunking.merge_short([dict(c) for c in chunks], 20, 50)
    tables = lambda cs: [c["text"] for c in cs if c["chunk_type"] == "table_json"]
    assert tables(out) == tables(chunks)  # tables never join
    assert "".join(re.findall(r"\d+:x+", "\n".join(c["text"] for c in out))) == "".join(c["text"] for c in chunks)  # nothing is lost or moved
    assert all(len(c["text"]) <= 50 + 120 for c in out if c["merged"])
    for a, b in itertools.pairwise(out):  # what is still short could not join the one before
        if len(b["text"]) < 20 and b["chunk_type"] != "table_json" and a["chunk_type"] != "table_json" and a["section_id"] == b["section_id"]:
            assert a["merged"] or len(a["text"]) + len(b["text"]) + 1 > 170


def test_adaptive_chunks_table(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {}
    for r in QUERIES["adaptive_chunks"](spark, DATA).orderBy("doc_id", "chunk_ix").collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, rows in got.items():
        assert [r.chunk_id for r in rows] == [f"{d}::chunk_{k:05d}" for k in range(len(rows))]
        assert all(r.section_id == "sec_0000" and r.section_title == docs[d].source for r in rows)
        prefix = f"SECTION_TITLE: {docs[d].source}\nCONTENT:\n"
        assert all(r.text.startswith(prefix) or r.merged for r in rows)
        whole = set(docs[d].text.split())
        assert {w for r in rows for w in r.text.replace(prefix, "").split()} <= whole


def test_literals(spark):
    lines = ["[['a','b','c']]", "[('a','b','c'), ['d', \"e'f\", 'g']]", "[]", "oops", "[['a',1,'c']]", None, "[[' a ', 'b', 'c']]", "{'a': 1}"]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, x string").select("k", parsing.literal_triples(F.col("x")).alias("t")).collect()
    out = {r.k: r.t for r in got}
    assert out[0] == [["a", "b", "c"]] and out[1] == [["a", "b", "c"], ["d", "e'f", "g"]] and out[2] == [] and out[3] is None and out[4] == [["a", "1", "c"]] and out[5] is None
    for r in QUERIES["literal_parse"](spark, DATA).collect():
        name = r.triples.split('"')[1]
        assert json.loads(r.triples) == [[name, "in", "x"], ["a", "b'c", "d"]]


def test_strict_triple_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("[(' a', 'b', 'c')]\n[['x', 'y', 'z ']]\n")
    rows = readers.triple_lines(spark, f"file://{tmp_path}/a.txt", strict=True).orderBy("line_ix").collect()
    assert [(r.line_ix, r.triples) for r in rows] == [(0, [[" a", "b", "c"]]), (1, [["x", "y", "z "]])]
    (tmp_path / "b.txt").write_text("[['x', 'y']]\n")
    with pytest.raises(Exception, match="bad triple line"):
        readers.triple_lines(spark, f"file://{tmp_path}/b.txt", strict=True).collect()
    with pytest.warns(UserWarning, match="several lines"):
        assert readers.ontology_triples(spark, f"file://{tmp_path}/a.txt").count() == 2


def plain_gate(scores, least, margin):
    return bool(scores) and scores[0] >= least and (len(scores) < 2 or scores[0] - scores[1] >= margin)


TRIPLES = [(0, "livesIn", "something lives in a place"), (1, "partOf", "something is part of a whole"), (2, "located in", "x"), (3, "eats", "an animal eats food"), (4, "feedsOn", "an animal eats some food"), (5, "odd", None), (6, "livesIn", "something lives in a place")]
SCHEMA = [(0, "located in", "something is located in a place"), (1, "part of", "something is part of a whole")]


def test_canonical_relations(spark):
    triples = spark.createDataFrame(TRIPLES, "k int, predicate string, definition string")
    schema = spark.createDataFrame(SCHEMA, "ord int, relation string, definition string")
    embed = models.hashing_embedder()
    matrix = embed([f"{r}: {d}" for _, r, d in SCHEMA])

    def plain(p, d):
        if p in {r for _, r, _ in SCHEMA}:
            return p
        if d is None:
            return None
        scores = matrix @ embed([d])[0]
        order = sorted(range(len(SCHEMA)), key=lambda i: (-scores[i], SCHEMA[i][1]))
        return SCHEMA[order[0]][1] if plain_gate([scores[i] for i in order], 0.3, 0.05) else None

    got = canonicalize.canonicalize(triples, schema, 3, 0.3, 0.05).collect()
    assert {r.k: r.canonical for r in got} == {k: plain(p, d) for k, p, d in TRIPLES}
    assert any(r.canonical for r in got if r.predicate != "located in")

    def second_choice():
        def run(prompts):
            assert all("is located in a place" in p or "part of a whole" in p for p in prompts)  # candidates come with their definitions
            return ["B" for _ in prompts]

        return run

    verified = {r.k: r.canonical for r in canonicalize.canonicalize(triples, schema, 3, 0.3, 0.05, verify=second_choice).collect()}
    for k, p, d in TRIPLES:
        first = plain(p, d)
        if p != "located in":
            assert verified[k] == (None if first is None else next(r for _, r, _ in SCHEMA if r != first))


def test_enriched_relations(spark):
    triples = spark.createDataFrame(TRIPLES, "k int, predicate string, definition string")
    schema = spark.createDataFrame(SCHEMA, "ord int, relation string, definition string")
    embed = models.hashing_embedder()
    known, want = [(r, d) for _, r, d in SCHEMA], {}
    for _, p, d in TRIPLES:  # one triple after the other
        if p in want or p in dict(known):
            want.setdefault(p, p)
            continue
        if d is None:
            continue
        scores = [float(embed([f"{p}: {d}"])[0] @ embed([f"{r}: {x}"])[0]) for r, x in known]
        order = sorted(range(len(known)), key=lambda i: -scores[i])
        if plain_gate([scores[i] for i in order], 0.3, 0.05):
            want[p] = known[order[0]][0]
        else:
            want[p] = p
            known.append((p, d))
    got = canonicalize.canonicalize_enriched(triples, schema, "k", 0.3, 0.05).collect()
    assert {r.predicate: r.canonical for r in got} == {p: want.get(p) for _, p, _ in TRIPLES}
    assert want["feedsOn"] == "eats" and len(known) > 2


def test_hints(spark):
    chunks = spark.createDataFrame([("d::0", "Ann lives in Rome"), ("d::1", "nothing here"), ("d::2", "Bob's dog is part of Rome")], "chunk_id string, text string")
    triples = spark.createDataFrame([("d::0", 0, "Ann", "located in", "Rome"), ("d::0", 1, "Ann", "odd", "It's"), ("d::2", 0, "dog", "part of", "Rome")], "chunk_id string, triple_ix int, subject string, predicate string, object string")
    schema = spark.createDataFrame([(k, r, d) for k, r, d in SCHEMA], "ord int, relation string, definition string")
    got = {r.chunk_id: r for r in refinement.refinement_hints(chunks, triples, schema, "Entities?\n\n{text}", "{entity_list_1} {entity_list_2}\n\n{text}").collect()}
    assert set(got) == {"d::0", "d::1", "d::2"}
    assert ast.literal_eval(got["d::0"].entity_hint) == ["Ann", "Rome"] and ast.literal_eval(got["d::2"].entity_hint) == ["Bob", "Rome"]
    example = "For example, ['Ann', 'located in', 'Rome'] can be extracted from \"Ann lives in Rome\""
    lines = got["d::0"].relation_hint.split("\n")
    assert lines[:2] == ["1. located in: something is located in a place", example] and lines[2].startswith("3. part of")  # "odd" keeps its number
    assert "1. " in got["d::1"].relation_hint and "2. " in got["d::1"].relation_hint


def test_refine_hints_query(spark):
    e = [r.asDict() for r in spark.read.parquet(f"{DATA}/events.parquet").collect()]
    known = {"click": "user clicks", "purchase": "user buys"}
    for r in QUERIES["refine_hints"](spark, DATA).collect():
        old = sorted({x["event_type"] for x in e if x["user_id"] == r.user_id and x["value"] < 50})
        new = sorted({x["event_type"] for x in e if x["user_id"] == r.user_id and x["value"] >= 50})
        want = old + [x for x in new if x not in old]
        assert r.relations == want and r.hint == "\n".join(f"{i + 1}. {x}: {known[x]}" for i, x in enumerate(want) if x in known)


def test_best_assignment_is_best():
    rng = random.Random(5)
    for _ in range(100):
        rows, cols = rng.randint(1, 5), rng.randint(1, 5)
        score = [[round(rng.random(), 2) for _ in range(cols)] for _ in range(rows)]
        got = spans.assign(score)
        total = sum(score[i][j] for i, j in enumerate(got) if j >= 0)
        assert len({j for j in got if j >= 0}) == sum(j >= 0 for j in got) == min(rows, cols)
        if rows <= cols:
            best = max(sum(score[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(cols), rows))
        else:
            best = max(sum(score[i][j] for j, i in enumerate(p)) for p in itertools.permutations(range(rows), cols))
        assert total == pytest.approx(best)


def test_span_alignment():
    w = str.split
    assert spans.common_runs(w("a b c d"), w("c d a b")) == [(0, 2, 2), (2, 0, 2)]
    assert spans.slot_spans(w("a b c"), w("a b c")) == ((0, 3), [(0, 3)], True)
    assert spans.slot_spans(w("a b c"), w("x a b c y")) == ((0, 3), [(-1, 4)], True)  # linked before and after
    assert spans.slot_spans(w("a b c"), w("b x"))[1][0] == (1, 2) and len(spans.slot_spans(w("a b c"), w("b x"))[1]) == 2  # x stands beside
    assert spans.slot_spans([], w("x")) == (None, [(2, 3)], False) and spans.slot_spans(w("x"), []) == ((0, 1), [], False)
    triple = lambda *parts: [spans.words(x) for x in parts]
    same = spans.slot_counts(triple("Ann Lee", "lives in", "Rome"), triple("ann lee", "lives in", "rome"))
    assert all(slot[s]["correct"] == 1 for slot in same for s in spans.SCHEMES) and spans.pair_score(same) == 1.0
    part = spans.slot_counts(triple("Ann Lee", "lives in", "Rome"), triple("Ann", "stays at", "Rome"))
    assert part[0]["partial"]["partial"] == part[0]["ent_type"]["correct"] == part[0]["strict"]["incorrect"] == 1
    assert part[1]["strict"] == {"correct": 0, "incorrect": 0, "partial": 0, "missed": 1, "spurious": 1}
    turned = spans.slot_counts(triple("Ann", "knows", "Bob"), triple("Bob", "knows", "Ann"))
    assert turned[0]["exact"]["correct"] == turned[2]["exact"]["correct"] == 1 and turned[0]["strict"]["incorrect"] == turned[0]["ent_type"]["incorrect"] == 1
    more = spans.entry_pairs([["a", "b", "c"]], [["x", "y", "z"], ["a", "b", "c"]])
    assert len(more) == 2 and more[1][0]["strict"]["correct"] == 1 and more[0][0]["strict"]["spurious"] == 1
    assert spans.entry_pairs([], []) == []


def test_span_scores_table(spark):
    """Sums and means over pairs, from the entries one by one."""
    n = {r.n_nationkey: r for r in spark.read.parquet(f"{DATA}/nation.parquet").collect()}
    region = {r.r_regionkey: r.r_name for r in spark.read.parquet(f"{DATA}/region.parquet").collect()}
    totals, rates = {}, {}
    for s in spark.read.parquet(f"{DATA}/supplier.parquet").collect():
        nation = n[s.s_nationkey]
        ref = [[s.s_name, "located in", nation.n_name], [nation.n_name, "part of", region[nation.n_regionkey]]]
        cand = [[nation.n_name, "part of", "ASIA" if s.s_suppkey % 3 == 0 else region[nation.n_regionkey]], [nation.n_name, "is located in", s.s_name]]
        for pair in spans.entry_pairs(ref, cand):
            for scheme in spans.SCHEMES:
                whole = {c: sum(slot[scheme][c] for slot in pair) for c in spans.COUNTS}
                for name, counts in [("ALL", whole), *zip(spans.SLOTS, (slot[scheme] for slot in pair), strict=True)]:
                    t = totals.setdefault((scheme, name), dict.fromkeys(spans.COUNTS, 0))
                    for c in spans.COUNTS:
                        t[c] += counts[c]
                    rates.setdefault((scheme, name), []).append(spans.rates(scheme, counts))
    for r in QUERIES["span_scores"](spark, DATA).collect():
        t = totals[r.scheme, r.slot]
        assert {c: r[c] for c in spans.COUNTS} == t
        assert r.possible == t["correct"] + t["incorrect"] + t["partial"] + t["missed"]
        assert (r.precision, r.recall, r.f1) == tuple(pytest.approx(np.mean(x), abs=1e-6) for x in zip(*rates[r.scheme, r.slot], strict=True))


def test_text_lines_table(spark):
    e = [r.asDict() for r in spark.read.parquet(f"{DATA}/events.parquet").collect()]
    want = []
    for page in {x["user_id"] for x in e}:
        line, anchor, words = -1, None, {}
        for x in sorted((x for x in e if x["user_id"] == page), key=lambda x: (x["event_id"] % 700, x["value"])):
            top = float(x["event_id"] % 700)
            if anchor is None or abs(top - anchor) > 3:
                line, anchor = line + 1, top
            words.setdefault(line, []).append((x["value"], x["event_type"]))
        want += [(page, k, " ".join(w for _, w in sorted(ws, key=lambda x: x[0]))) for k, ws in words.items()]
    assert sorted((r.page, r.line, r.text) for r in QUERIES["text_lines"](spark, DATA).collect()) == sorted(want)


def test_headers_and_separators(spark):
    assert layout.unique_headers(["a", "a_2", "a", "a"]) == ["a", "a_2", "a_3", "a_4"]
    for r in QUERIES["kept_separators"](spark, DATA).groupBy("user_id").agg(F.sort_array(F.collect_list("top")).alias("t")).collect():
        assert all(b - a > 5 for a, b in itertools.pairwise(r.t))
    names = QUERIES["unique_headers"](spark, DATA).groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct("header").alias("d")).collect()
    assert all(r.n == r.d for r in names)


def test_models(tmp_path):
    calls = []

    def flaky():
        def run(prompts):
            calls.append(prompts)
            if len(calls) < 3:
                raise OSError("no answer")
            return ["fine"]

        return run

    assert models.retried(flaky, 3, 0.0)()(["a"]) == ["fine"] and len(calls) == 3
    calls.clear()
    with pytest.raises(OSError):
        models.retried(flaky, 2, 0.0)()(["a"])
    calls.clear()
    assert models.retried(flaky, 2, 0.0, default="UNSUPPORTED")()(["a"]) == ["UNSUPPORTED"]
    api, local = (lambda name: lambda ps: [f"api {name}" for _ in ps]), (lambda name: lambda ps: [f"local {name}" for _ in ps])
    assert models.routed("gpt-x", api, local)()(["p"]) == ["api gpt-x"] and models.routed("other", api, local, "Answer: ")()(["p"]) == ["Answer: local other"]
    made = []
    assert models.client("k", lambda: made.append(1) or "c") == models.client("k", lambda: made.append(1) or "c") == "c" and made == [1]
    (tmp_path / "t.txt").write_text("Say {text}")
    assert models.read_template(str(tmp_path / "t.txt")) == "Say {text}"


def test_job(spark, tmp_path):
    docs = spark.createDataFrame([("b", "Ann lives near Rome. Bob eats green apples."), ("a", "no"), ("a2", "One two. Dogs are part of packs.")], "doc_id string, text string")
    schema = spark.createDataFrame([(0, "lives", "lives"), (1, "eats", "eats")], "ord int, relation string, definition string")
    cfg = pipeline.JobConfig(chunking="sentences", iterations=2, use_filter=True, min_similarity=0.9)
    triples, records, stages = pipeline.run_job(docs, schema, str(tmp_path / "o"), cfg)
    rows = records.orderBy("index").collect()
    assert [r.doc_id for r in rows] == ["a", "a2", "b"] and [r["index"] for r in rows] == [0, 1, 2]
    by = {r.doc_id: r for r in rows}
    assert by["a"].oie == [] and by["a"].useful_triplets == []  # chunks without triples stay
    assert ["Ann", "lives", "Rome"] in by["b"].oie and ["Ann", "lives", "Rome"] in by["b"].triples_before_utility_filter
    assert by["a2"].oie and by["a2"].triples_before_utility_filter == [] and by["a2"].schema_canonicalization == [None] * len(by["a2"].oie)
    assert all(r.canonical is not None for r in triples.collect())
    assert by["b"].relation_hint.startswith("1. ")
    again = pipeline.Stages(docs, schema, str(tmp_path / "o"), cfg)
    assert again.base == stages.base and again.finished("iter1/records")
    other = pipeline.Stages(docs, schema, str(tmp_path / "o"), pipeline.JobConfig(chunking="sentences"))
    assert other.base != stages.base
    (next((tmp_path / "o").glob("*/iter1/records")) / "_SUCCESS").unlink()
    assert not again.finished("iter1/records")
    writers.literal_lines(records, f"file://{tmp_path}/canon", "triples_before_utility_filter")
    lines = [x for f in sorted((tmp_path / "canon").glob("part*")) for x in f.read_text().splitlines()]
    assert [ast.literal_eval(x) for x in lines] == [r.triples_before_utility_filter for r in rows]
    writers.stage_records(records, f"file://{tmp_path}/stages")
    writers.chunk_records(spark.read.parquet(f"{stages.base}/chunks"), f"file://{tmp_path}/chunks")
    assert sorted(json.loads(x)["global_index"] for f in (tmp_path / "chunks").glob("part*") for x in f.read_text().splitlines()) == [0, 1, 2]
    assert "chunk_count=3" in pipeline.settings_log(cfg, 3, spark.read.parquet(f"{stages.base}/chunks"))


def test_report(spark):
    preds = spark.createDataFrame([(0, 0, "A", "r", "B"), (1, 0, "a", "R", "b"), (2, 1, "A", "q", "C"), (3, 1, "B", "r", "A"), (4, 2, "zz", "r", "B")], "pred_id bigint, line_idx bigint, subject string, predicate string, object string")
    gold = spark.createDataFrame([("A", "r", "B"), ("C", "s", "A")], "subject string, predicate string, object string")
    ev = evaluation.evaluate(preds, gold, spark.createDataFrame([], "sys string, gold_p string, score double"))
    sample = evaluation.review_sample(ev, 10)
    labels = sample.select("sample_id", F.lit("SUPPORTED").alias("label")).limit(2)
    r = evaluation.report(ev, labels=labels, sample_size=10)
    assert list(r) == ["input", "counts", "metrics_alignment", "metrics_enrichment_auto", "metrics_enrichment_manual", "metrics_legacy", "metrics", "sampling_info", "thresholds", "diagnostics", "exports"]
    assert r["counts"]["matched"] == 1 and r["counts"]["alignable_predictions"] == 3 and r["counts"]["novel_count"] == 4
    assert r["metrics_alignment"] == {"alignment_precision": 0.333333, "alignment_recall": 0.5, "alignment_f1": 0.4, "coverage_gold": 0.5}
    assert r["metrics_legacy"]["strict_precision_exact_triple"] == 0.2 and r["metrics_legacy"]["normalized_precision_exact_triple"] == 0.4
    assert r["diagnostics"]["alignable_unmatched_cause_counts"] == {"direction_mismatch": 1, "entity_mismatch": 1}
    assert r["metrics_enrichment_manual"]["supported"] == 2 and r["sampling_info"]["sample_size_exported"] == 4
    reasons = {x.pred_id: x.legacy_reason for x in ev.novel.collect()}
    assert reasons[1] == "known_relation_and_arguments_allowed_but_triple_not_in_ontology" and reasons[2] == "unknown_relation"
    assert json.loads(writers.report(r))["counts"]["prediction_total"] == 5
    assert evaluation.match_rows(ev).columns == evaluation.MATCH_COLUMNS and sample.columns == evaluation.REVIEW_COLUMNS


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"doc_id": "d", "text": "One. Two. Three. Four. Five.", "ts": "2024-01-01T00:00:00Z"}\n')
    windows = dedup.stream_windows(dedup.document_stream(spark, f"file://{tmp_path}/in"))
    q = windows.writeStream.format("memory").queryName("kg_windows").option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.start_sentence, r.chunk) for r in spark.table("kg_windows").collect()) == [(0, "One. Two. Three. Four."), (3, "Four. Five.")]
    rows = [{"ts": f"2024-01-01T00:0{k}:00Z", "triples": [["a", "r", "b"], ["a", "r", "b"], ["x", "r", f"y{k % 2}"], ["bad", "_"]]} for k in range(4)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    chunks = spark.readStream.schema("ts timestamp, triples array<array<string>>").json(f"file://{tmp_path}/t")
    q = dedup.stream_triples(chunks).writeStream.format("memory").queryName("kg_triples").option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.subject, r.object) for r in spark.table("kg_triples").collect()) == [("a", "b"), ("x", "y0"), ("x", "y1")]


def test_command_line(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a_combined.txt").write_text("[SECTION_START]\nTITLE: T\nCONTENT:\nAnn lives near Rome. Bob eats apples.\n[SECTION_END]\n")
    (tmp_path / "docs" / "other.txt").write_text("not read")
    (tmp_path / "s.csv").write_text("lives,lives\neats,eats\n")
    cli.main(["extract", "--documents", f"file://{tmp_path}/docs", "--schema", f"file://{tmp_path}/s.csv", "--out", f"file://{tmp_path}/out", "--min-similarity", "0.9", "--filter"])
    read = lambda name: "".join(f.read_text() for f in sorted((tmp_path / "out" / name).glob("part*")))
    assert {"Ann", "Bob"} <= {t[0] for line in read("canon_kg").splitlines() for t in ast.literal_eval(line)}
    assert "chunk_count=1" in read("run_settings") and json.loads(read("result_at_each_stage").splitlines()[0])["index"] == 0
    (tmp_path / "gold.txt").write_text("[('ann', 'lives', 'rome'), ('x', 'eats', 'y')]\n")
    cli.main(["evaluate", "--predictions", f"file://{tmp_path}/out/canon_kg", "--ontology", f"file://{tmp_path}/gold.txt", "--stages", f"file://{tmp_path}/out/result_at_each_stage", "--out", f"file://{tmp_path}/ev"])
    report = json.loads("".join(f.read_text() for f in (tmp_path / "ev" / "report").glob("part*")))
    assert report["counts"]["matched"] == 1 and report["metrics_alignment"]["alignment_recall"] == 0.5
    assert report["metrics_enrichment_auto"]["unique_predicates_after_canonicalization"] == 2
    head = "".join(f.read_text() for f in (tmp_path / "ev" / "alignment_matches").glob("part*")).splitlines()[0]
    assert head.split(",") == evaluation.MATCH_COLUMNS
