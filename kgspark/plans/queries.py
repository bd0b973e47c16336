"""The queries of the library's operators over whole tables, and their DuckDB counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models, parsing
from ..functions import text as X
from ..operators import alignment as A
from ..operators import canonicalize as C
from ..operators import chunking as K
from ..operators import evaluation as E
from ..operators import layout as L
from ..operators import metrics as M
from ..operators import ontology as O
from ..operators import retrieval as R
from ..operators import spans as S
from ..operators import triples as T
from ..operators.ordering import global_index
from ..sources.scratch import checkpointed, shared_folder
from . import views as V
from .pipeline import JobConfig, extract

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
THRESHOLD = 0.85


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.replace("{KG}", V.KG_SQL)
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPLIT = r"list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: x <> '')"


@query(f"SELECT doc_id, i AS sentence_ix, s[i + 1] AS sentence FROM (SELECT doc_id, s, unnest(range(len(s)))::INT AS i FROM (SELECT doc_id, {SPLIT} AS s FROM documents))")
def sentence_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sentence_ix", "sentence"))


@query(f"SELECT doc_id, (i // 3)::INT AS chunk_ix, i::INT AS start_sentence, least(i + 4, len(s))::INT AS end_sentence, array_to_string(s[i + 1:i + 4], ' ') AS chunk FROM (SELECT doc_id, s, unnest(range(0, len(s), 3)) AS i FROM (SELECT doc_id, {SPLIT} AS s FROM documents))")
def sentence_windows(spark, sf):
    return K.sentence_windows(table(spark, sf, "documents").select("doc_id", "text")).drop("text")


STRIP = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


@query(f"""WITH w AS (SELECT doc_id, i, least(i + 1000, length(text)) AS e, trim(substring(text, i + 1, 1000), {STRIP}) AS c FROM (SELECT doc_id, text, unnest(range(0, length(text), 800))::INT AS i FROM documents))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_ix, i AS start_char, e::INT AS end_char, c AS chunk FROM w WHERE c <> ''""")
def char_windows(spark, sf):
    return K.char_windows(table(spark, sf, "documents").select("doc_id", "text")).drop("text")


@query(f"""SELECT count(*) AS chunks, round(avg(n), 6) AS avg_chars, max(n) AS max_chars, min(n) AS min_chars FROM (
SELECT length(array_to_string(s[i + 1:i + 4], ' ')) AS n FROM (SELECT s, unnest(range(0, len(s), 3)) AS i FROM (SELECT {SPLIT} AS s FROM documents)))""")
def chunk_stats(spark, sf):
    return K.chunk_stats(sentence_windows(spark, sf))


@query("SELECT doc_id, (i // 6)::INT AS chunk_ix, i::INT AS start_item, least(i + 6, len(l))::INT AS end_item, array_to_string(l[i + 1:i + 6], chr(10)) AS chunk FROM (SELECT doc_id, l, unnest(range(0, len(l), 6)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def tumbling_groups(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    return K.groups(docs, F.col("l"), 6).drop("l")


@query(f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: trim(x, {STRIP})), lambda x: x <> '' AND x NOT IN ('[SECTION_START]', '[SECTION_END]', '[TABLE_JSON_START]', '[TABLE_JSON_END]')), chr(10)) AS body FROM documents""")
def text_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("body"))


@query("WITH {KG} SELECT pred_id, s, p, o FROM pn")
def label_normalize(spark, sf):
    return A.with_norm(V.predictions(spark, sf)).select("pred_id", "s", "p", "o")


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || '_' || p_type), '([a-z])([A-Z])', '\1 \2', 'g'), '_', ' ', 'g') AS span, CASE WHEN p_name = '' THEN 'column_' || p_size ELSE replace(regexp_replace(trim(regexp_replace(lower(p_name || ' (' || p_type || ')'), '\s+', ' ', 'g')), '[^a-z0-9_ ]', '', 'g'), ' ', '_') END AS header FROM part""")
def header_normalize(spark, sf):
    name = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))
    span = X.normalize_span(F.lower(F.concat("p_name", F.lit("_"), "p_type")))
    return table(spark, sf, "part").select("p_partkey", span.alias("span"), X.normalize_header(name, F.col("p_size")).alias("header"))


@query(r"""WITH t AS (SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(p_type), '\s+'), lambda x: x <> '')) AS b FROM part)
SELECT p_partkey, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 6) AS score FROM t""")
def token_jaccard(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(X.token_jaccard(F.lower("p_name"), F.lower("p_type")), 6).alias("score"))


WORDS = r"list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT conv_id, turn, i, l[i + 1] AS word FROM (SELECT conv_id, turn, l, unnest(range(len(l)))::INT AS i FROM (SELECT conv_id, turn, {WORDS} AS l FROM conversations)))
SELECT conv_id, word, turn, i AS ix FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, word ORDER BY turn, i) AS r FROM w) WHERE r = 1""")
def dedup_line(spark, sf):
    words = F.filter(F.split(F.lower("text"), "[ \t\n\r]+"), lambda x: x != "")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(words).alias("ix", "word"))
    return T.first_seen(rows, ["conv_id", "word"], F.struct("turn", "ix"))


@query("SELECT event_type, props, min(event_id) AS event_id FROM events GROUP BY ALL")
def dedup_global(spark, sf):
    return T.first_seen(table(spark, sf, "events").select("event_type", "props", "event_id"), ["event_type", "props"], F.col("event_id"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) FILTER (WHERE value < 50) AS b, count(*) FILTER (WHERE value >= 50) AS a FROM events GROUP BY ALL)
SELECT user_id, sum(least(a, b))::BIGINT AS unchanged, sum(greatest(b - a, 0))::BIGINT AS removed, sum(greatest(a - b, 0))::BIGINT AS added, least(sum(greatest(b - a, 0)), sum(greatest(a - b, 0)))::BIGINT AS rewritten FROM c GROUP BY ALL HAVING sum(a + b) > 0""")
def triple_trace(spark, sf):
    e = table(spark, sf, "events")
    return T.change_trace(e.where("value < 50"), e.where("value >= 50"), "user_id", ["event_type"])


@query("""WITH a AS (SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_quantity < 25), b AS (SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_quantity >= 25)
SELECT 'both' AS kind, * FROM (SELECT *, count(*) AS n FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b) GROUP BY ALL)
UNION ALL SELECT 'removed', * FROM (SELECT *, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL)""")
def multiset_diff(spark, sf):
    """Multiset intersection and difference by counts, which keeps rows that are equal from being expanded."""
    keys = ["l_returnflag", "l_linestatus", "l_linenumber"]
    sides = table(spark, sf, "lineitem").groupBy(*keys).agg(F.count_if(F.col("l_quantity") < 25).alias("a"), F.count_if(F.col("l_quantity") >= 25).alias("b"))
    both, less = F.least("a", "b"), F.col("a") - F.col("b")
    return sides.select(F.lit("both").alias("kind"), *keys, both.alias("n")).where("n > 0").unionByName(sides.select(F.lit("removed").alias("kind"), *keys, less.alias("n")).where("n > 0"))


FLAGS_BODY = f"""best AS (SELECT p, gold_p FROM (SELECT p, gold_p, row_number() OVER (PARTITION BY p ORDER BY score DESC, gold_p) AS r FROM
 (SELECT DISTINCT pn.p, gn.p AS gold_p, 1.0 AS score FROM pn JOIN gn ON pn.p = gn.p UNION ALL SELECT DISTINCT pn.p, gold_p, score FROM pn JOIN align ON sys = pn.p WHERE score >= {THRESHOLD} AND gold_p IN (SELECT p FROM gn))) WHERE r = 1),
f AS (SELECT pn.*, EXISTS (SELECT 1 FROM gold g WHERE g.subject = pn.subject AND g.predicate = pn.predicate AND g.object = pn.object) AS strict, EXISTS (SELECT 1 FROM gn WHERE gn.s = pn.s AND gn.p = pn.p AND gn.o = pn.o) AS normalized,
 pn.p IN (SELECT p FROM gn) AS known, best.gold_p AS rel FROM pn LEFT JOIN best ON best.p = pn.p),
h AS (SELECT f.*, EXISTS (SELECT 1 FROM gn WHERE gn.p = f.rel AND gn.s = f.s) AS d, EXISTS (SELECT 1 FROM gn WHERE gn.p = f.rel AND gn.o = f.o) AS r FROM f),
flags AS (SELECT *, CASE WHEN normalized THEN 'in_ontology' WHEN rel IS NULL THEN 'unknown_relation' ELSE (CASE WHEN known THEN 'known_relation' ELSE 'aligned_relation' END) || (CASE WHEN NOT d AND NOT r THEN '_but_subject_and_object_not_allowed' WHEN NOT d THEN '_but_subject_not_allowed' WHEN NOT r THEN '_but_object_not_allowed' ELSE '_and_arguments_allowed_but_triple_not_in_ontology' END) END AS reason FROM h)"""
FLAGS = "{KG}, " + FLAGS_BODY


def _flagged(spark, sf):
    return A.compliance(A.with_norm(V.predictions(spark, sf)), V.gold(spark, sf), V.alignment(spark), THRESHOLD)


RATE = ", ".join(f"round(avg(({x})::INT), 6) AS {n}_rate" for n, x in (("strict", "strict"), ("normalized", "normalized"), ("relation_known", "known"), ("domain_ok", "known AND d"), ("range_ok", "known AND r"), ("relation_semantic", "rel IS NOT NULL"), ("domain_semantic", "d"), ("range_semantic", "r")))


@query(f"WITH {FLAGS} SELECT count(*) AS predictions, {RATE} FROM flags")
def compliance_rates(spark, sf):
    return M.compliance_rates(_flagged(spark, sf))


@query(f"WITH {FLAGS} SELECT reason, count(*) AS n FROM flags GROUP BY ALL")
def legacy_reason_hist(spark, sf):
    return _flagged(spark, sf).groupBy("reason").agg(F.count("*").alias("n"))


@query("WITH {KG} SELECT count(*) AS total, count(DISTINCT (s, p, o)) AS distinct_triples, count(*) - count(DISTINCT (s, p, o)) AS duplicates, (SELECT count(*) FROM gn) AS gold, (SELECT count(*) FROM (SELECT s, p, o FROM pn INTERSECT SELECT s, p, o FROM gn)) AS covered, round((SELECT count(*) FROM (SELECT s, p, o FROM pn INTERSECT SELECT s, p, o FROM gn)) / (SELECT count(*) FROM gn), 6) AS coverage FROM pn")
def coverage(spark, sf):
    distinct = A.with_norm(V.predictions(spark, sf)).groupBy(*A.NORM).agg(F.count("*").alias("n"))
    gold = A.gold_norm(V.gold(spark, sf)).withColumn("g", F.lit(1))
    j = distinct.join(gold, A.NORM, "full")
    out = j.agg(F.sum("n").alias("total"), F.count("n").alias("distinct_triples"), F.count("g").alias("gold"), F.count_if(F.col("n").isNotNull() & F.col("g").isNotNull()).alias("covered"))
    return out.select("total", "distinct_triples", (F.col("total") - F.col("distinct_triples")).alias("duplicates"), "gold", "covered", F.round(F.try_divide("covered", "gold"), 6).alias("coverage"))


CANDS_BODY = f"""rc AS (SELECT p, gold_p, max(score) AS score FROM (SELECT DISTINCT pn.p, gn.p AS gold_p, 1.0::DOUBLE AS score FROM pn JOIN gn ON pn.p = gn.p UNION ALL SELECT DISTINCT pn.p, gold_p, score FROM pn JOIN align ON sys = pn.p WHERE score >= {THRESHOLD} AND gold_p IN (SELECT p FROM gn)) GROUP BY ALL),
ge AS (SELECT s AS ge FROM gn UNION SELECT o FROM gn), pe AS (SELECT s AS pe FROM pn UNION SELECT o FROM pn),
tok AS (SELECT ge, unnest(list_distinct(list_filter(string_split(ge, ' '), lambda x: x <> ''))) AS w FROM ge), ptok AS (SELECT pe, unnest(list_distinct(list_filter(string_split(pe, ' '), lambda x: x <> ''))) AS w FROM pe),
cnt AS (SELECT pe, ge, count(*) AS n FROM ptok JOIN tok USING (w) GROUP BY ALL),
ec AS (SELECT pe AS entity, ge AS gold_entity, n / ((SELECT count(*) FROM ptok t WHERE t.pe = cnt.pe) + (SELECT count(*) FROM tok t WHERE t.ge = cnt.ge) - n) AS score FROM cnt),
ecs AS (SELECT * FROM ec WHERE score >= {THRESHOLD}),
edges AS (SELECT pred_id, gn.s AS gs, gn.p AS gp, gn.o AS go, rc.score AS relation_score, a.score AS subject_score, b.score AS object_score, (a.score + rc.score + b.score) / 3 AS overall FROM pn JOIN rc ON rc.p = pn.p JOIN ecs a ON a.entity = pn.s JOIN ecs b ON b.entity = pn.o JOIN gn ON gn.s = a.gold_entity AND gn.p = rc.gold_p AND gn.o = b.gold_entity)"""
CANDS = "{KG}, " + CANDS_BODY
# The walk over edges in falling order, one edge a step, with the lists of taken ends.
RECORDS = f"""{{KG}}, {FLAGS_BODY}, {CANDS_BODY},
ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY overall DESC, relation_score DESC, subject_score DESC, object_score DESC, pred_id, gp, gs, go) AS r, dense_rank() OVER (ORDER BY gs, gp, go) AS gid FROM edges),
walk AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS ps, []::BIGINT[] AS gids, []::BIGINT[] AS rs UNION ALL
 SELECT e.r, CASE WHEN e.free THEN list_append(e.ps, e.pred_id) ELSE e.ps END, CASE WHEN e.free THEN list_append(e.gids, e.gid) ELSE e.gids END, CASE WHEN e.free THEN list_append(e.rs, e.r) ELSE e.rs END
 FROM (SELECT k.r, k.pred_id, k.gid, w.ps, w.gids, w.rs, NOT list_contains(w.ps, k.pred_id) AND NOT list_contains(w.gids, k.gid) AS free FROM walk w JOIN ranked k ON k.r = w.r + 1) e),
m AS (SELECT * FROM ranked WHERE r IN (SELECT unnest(rs) FROM (SELECT rs FROM walk ORDER BY r DESC LIMIT 1))),
al AS (SELECT pn.*, CASE WHEN p NOT IN (SELECT p FROM rc) THEN 'unknown_relation' WHEN s NOT IN (SELECT entity FROM ecs) OR o NOT IN (SELECT entity FROM ecs) THEN 'entity_mismatch' END AS not_alignable FROM pn),
un AS (SELECT * FROM al WHERE not_alignable IS NULL AND pred_id NOT IN (SELECT pred_id FROM m)),
causes AS (SELECT pred_id, CASE
 WHEN EXISTS (SELECT 1 FROM gn JOIN ecs a ON a.entity = un.s AND gn.o = a.gold_entity JOIN ecs b ON b.entity = un.o AND gn.s = b.gold_entity JOIN rc ON rc.p = un.p AND rc.gold_p = gn.p) THEN 'direction_mismatch'
 WHEN EXISTS (SELECT 1 FROM gn JOIN ecs a ON a.entity = un.s AND gn.s = a.gold_entity JOIN ecs b ON b.entity = un.o AND gn.o = b.gold_entity WHERE gn.p NOT IN (SELECT gold_p FROM rc WHERE rc.p = un.p)) THEN 'relation_mismatch'
 WHEN EXISTS (SELECT 1 FROM gn JOIN rc ON rc.p = un.p AND rc.gold_p = gn.p WHERE gn.s IN (SELECT gold_entity FROM ecs WHERE entity = un.s) OR gn.o IN (SELECT gold_entity FROM ecs WHERE entity = un.o)) THEN 'entity_mismatch'
 ELSE 'threshold_not_met' END AS cause FROM un),
rec AS (SELECT x.pred_id, x.subject, x.predicate, x.object, x.s, x.p, x.o, x.normalized, al.not_alignable IS NULL AS alignable, m.pred_id IS NOT NULL AS matched, m.gs, m.gp, m.go, m.overall, m.subject_score, m.relation_score, m.object_score,
 CASE WHEN m.pred_id IS NOT NULL THEN '' ELSE coalesce(cause, not_alignable) END AS reason_for_novelty, CASE WHEN NOT x.normalized THEN x.reason END AS legacy_reason, CASE WHEN NOT x.known THEN x.rel END AS mapped_predicate
 FROM flags x JOIN al USING (pred_id) LEFT JOIN m USING (pred_id) LEFT JOIN causes USING (pred_id)),
novel AS (SELECT * REPLACE (CASE WHEN normalized THEN 'known_relation_and_arguments_allowed_but_triple_not_in_ontology' ELSE legacy_reason END AS legacy_reason), alignable::INT AS branch FROM rec WHERE NOT matched)"""


def _candidates(spark, sf, sequence=False):
    preds = checkpointed(A.with_norm(V.predictions(spark, sf)).select("pred_id", *A.NORM))
    gold = checkpointed(A.gold_norm(V.gold(spark, sf)))
    rel = A.relation_candidates(preds, gold, V.alignment(spark), THRESHOLD)
    entities = preds.select(F.col("s").alias("entity")).union(preds.select("o"))
    return preds, gold, rel, A.entity_candidates(entities, gold, THRESHOLD, sequence)


@query(f"WITH {CANDS} SELECT p, gold_p, score FROM rc")
def relation_candidates(spark, sf):
    return _candidates(spark, sf)[2]


@query(f"WITH {CANDS} SELECT entity, gold_entity, round(score, 6) AS score FROM ecs")
def entity_candidates_jaccard(spark, sf):
    return _candidates(spark, sf)[3].withColumn("score", F.round("score", 6))


@query()
def entity_candidates_sequence(spark, sf):
    """With the sequence ratio as well, which SQL lacks."""
    return _candidates(spark, sf, True)[3]


def _edges(spark, sf):
    preds, gold, rel, ents = _candidates(spark, sf)
    return A.edges(preds, gold, checkpointed(rel), checkpointed(ents))


@query(f"WITH {CANDS} SELECT * REPLACE (round(overall, 6) AS overall) FROM edges")
def alignment_edges(spark, sf):
    return _edges(spark, sf).withColumn("overall", F.round("overall", 6))


def _evaluation(spark, sf):
    """Token Jaccard alone, which SQL has too; predictions compete for gold triples here."""
    return E.evaluate(V.predictions(spark, sf), V.gold(spark, sf), V.alignment(spark), THRESHOLD, THRESHOLD, sequence=False)


@query(f"WITH RECURSIVE {RECORDS} SELECT pred_id, gs, gp, go, relation_score, subject_score, object_score, round(overall, 6) AS overall FROM m")
def greedy_match(spark, sf):
    return A.greedy_match(_edges(spark, sf)).withColumn("overall", F.round("overall", 6))


@query(f"""WITH RECURSIVE {RECORDS}, c AS (SELECT (SELECT count(*) FROM m) AS matched, (SELECT count(*) FROM al WHERE not_alignable IS NULL) AS alignable, (SELECT count(*) FROM gn) AS gold)
SELECT matched, alignable, gold, round(matched / alignable, 6) AS precision, round(matched / gold, 6) AS recall, round(2 * (matched / alignable) * (matched / gold) / (matched / alignable + matched / gold), 6) AS f1 FROM c""")
def pr_f1(spark, sf):
    c = E.counts(_evaluation(spark, sf))
    return c.select("matched", F.col("alignable_predictions").alias("alignable"), F.col("gold_total").alias("gold"), *M.prf(F.col("matched"), F.col("alignable_predictions"), F.col("gold_total")))


@query(f"WITH RECURSIVE {RECORDS} SELECT coalesce(not_alignable, 'alignable') AS kind, count(*) AS n FROM al GROUP BY ALL")
def alignable_hist(spark, sf):
    preds, _, rel, ents = _candidates(spark, sf)
    return E.alignable(preds, rel, ents).groupBy(F.coalesce("not_alignable", F.lit("alignable")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {RECORDS} SELECT pred_id, cause FROM causes")
def diagnosis(spark, sf):
    return _evaluation(spark, sf).records.where("alignable and not matched").select("pred_id", F.col("reason_for_novelty").alias("cause"))


@query(f"WITH RECURSIVE {RECORDS} SELECT pred_id, branch, reason_for_novelty AS reason, legacy_reason FROM novel")
def novel_records(spark, sf):
    return _evaluation(spark, sf).novel.select("pred_id", "branch", F.col("reason_for_novelty").alias("reason"), "legacy_reason")


@query(f"""WITH RECURSIVE {RECORDS} SELECT pred_id, NULL::BIGINT AS line_idx, NULL::VARCHAR AS doc_id, NULL::VARCHAR AS chunk_id, subject, predicate, object, alignable, matched, gs AS gold_subject, gp AS gold_predicate, go AS gold_object,
round(overall, 6) AS overall_score, round(subject_score, 6) AS subject_score, round(relation_score, 6) AS relation_score, round(object_score, 6) AS object_score, reason_for_novelty, legacy_reason FROM rec""")
def match_rows(spark, sf):
    return E.match_rows(_evaluation(spark, sf))


@query(f"""WITH RECURSIVE {RECORDS}, n AS (SELECT *, (pred_id + 42) * 2654435761 % 4294967296 AS h, CASE WHEN reason_for_novelty = 'unknown_relation' OR legacy_reason = 'unknown_relation' THEN 0 WHEN contains(legacy_reason, 'not_allowed') THEN 1 ELSE 2 END AS st FROM novel),
k AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY h, pred_id) AS r FROM n)
SELECT concat_ws('|', '-1', subject, predicate, object) AS sample_id, NULL::VARCHAR AS doc_id, NULL::VARCHAR AS chunk_id, NULL::VARCHAR AS section_title, NULL::VARCHAR AS source_text_snippet, subject, predicate, object, reason_for_novelty, legacy_reason, '' AS human_label
FROM (SELECT * FROM k WHERE r <= 100 ORDER BY CASE WHEN st < 2 AND r <= 50 THEN st ELSE 2 END, h, pred_id LIMIT 100)""")
def review_sample(spark, sf):
    return E.review_sample(_evaluation(spark, sf), 100, 42)


TOP = "SELECT '{0}' AS scope, p AS predicate, count(*) AS count FROM {1} GROUP BY p ORDER BY count(*) DESC, min(branch), min(pred_id) LIMIT 200"


@query(f"WITH RECURSIVE {RECORDS} SELECT * FROM ({TOP.format('total_predictions', '(SELECT *, 0 AS branch FROM rec)')}) UNION ALL SELECT * FROM ({TOP.format('novel_predictions', 'novel')})")
def scoped_predicates(spark, sf):
    return E.top_predicates(_evaluation(spark, sf))


@query(f"""WITH RECURSIVE {RECORDS} SELECT count(*) AS prediction_total, count(DISTINCT (subject, predicate, object)) AS prediction_triples_unique, count(*) - count(DISTINCT (subject, predicate, object)) AS prediction_triples_duplicates,
count(*) FILTER (WHERE alignable) AS alignable_predictions, count(*) FILTER (WHERE matched) AS matched, count(*) FILTER (WHERE alignable AND NOT matched) AS unmatched_alignable, count(*) FILTER (WHERE NOT matched) AS novel_count,
count(DISTINCT p) AS unique_predicates_total, count(DISTINCT p) FILTER (WHERE NOT matched) AS unique_predicates_novel, (SELECT count(*) FROM gn) AS gold_total, (SELECT count(DISTINCT p) FROM gn) AS ontology_relations_total,
(SELECT count(*) FROM (SELECT s FROM gn UNION SELECT o FROM gn)) AS ontology_entities_total FROM rec""")
def evaluation_counts(spark, sf):
    return E.counts(_evaluation(spark, sf))


@query(f"""WITH RECURSIVE {RECORDS} SELECT round(avg(strict::INT), 6) AS strict_precision_exact_triple, round(avg(normalized::INT), 6) AS normalized_precision_exact_triple, round(avg(known::INT), 6) AS relation_valid_rate, round(avg((rel IS NOT NULL)::INT), 6) AS relation_valid_rate_semantic,
round(avg((known AND d)::INT), 6) AS domain_valid_rate, round(avg(d::INT), 6) AS domain_valid_rate_semantic, round(avg((known AND r)::INT), 6) AS range_valid_rate, round(avg(r::INT), 6) AS range_valid_rate_semantic,
round((SELECT count(*) FROM (SELECT s, p, o FROM pn INTERSECT SELECT s, p, o FROM gn)) / (SELECT count(*) FROM gn), 6) AS ontology_coverage_by_predictions FROM flags""")
def legacy_metrics(spark, sf):
    return E.legacy_metrics(_evaluation(spark, sf))


@query(f"""WITH RECURSIVE {RECORDS}, k AS (SELECT *, row_number() OVER (PARTITION BY reason_for_novelty ORDER BY pred_id)::INT AS example_ix, count(*) OVER (PARTITION BY reason_for_novelty) AS cause_count FROM rec WHERE alignable AND NOT matched)
SELECT reason_for_novelty AS cause, cause_count, example_ix, pred_id, subject, predicate, object, NULL::VARCHAR AS doc_id, NULL::VARCHAR AS chunk_id, NULL::VARCHAR AS section_title FROM k WHERE example_ix <= 20""")
def unmatched_examples(spark, sf):
    return E.unmatched_examples(_evaluation(spark, sf))


@query(f"""WITH RECURSIVE {RECORDS}, t AS (SELECT p, count(*) AS count FROM novel GROUP BY p ORDER BY count(*) DESC, min(branch), min(pred_id) LIMIT 20), k AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY branch, pred_id)::INT AS example_ix FROM novel JOIN t USING (p))
SELECT p AS top_predicate, count, example_ix, subject, predicate, object, reason_for_novelty FROM k WHERE example_ix <= 10""")
def novel_examples(spark, sf):
    return E.novel_examples(_evaluation(spark, sf))


@query(f"WITH RECURSIVE {RECORDS} SELECT pred_id, subject, predicate, object, legacy_reason AS reason, mapped_predicate FROM rec WHERE NOT normalized ORDER BY pred_id LIMIT 50")
def invalid_examples(spark, sf):
    return E.invalid_examples(_evaluation(spark, sf))


@query("WITH {KG} SELECT predicate, count(*) AS count FROM pred GROUP BY predicate ORDER BY count DESC, min(pred_id) LIMIT 200")
def predicate_topk(spark, sf):
    return M.most_common(V.predictions(spark, sf), "predicate", "pred_id", 200)


@query(f"WITH {FLAGS} SELECT reason, example_ix, pred_id, subject, predicate, object FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY pred_id)::INT AS example_ix FROM flags) WHERE example_ix <= 20")
def reason_examples(spark, sf):
    return M.examples(_flagged(spark, sf), "reason", "pred_id", 20).select("reason", "example_ix", "pred_id", "subject", "predicate", "object")


LABEL = "CASE WHEN quality = 1 AND toxic = 0 THEN 'SUPPORTED' WHEN quality = 1 THEN 'I think PARTIALLY_SUPPORTED.' WHEN toxic = 0 THEN ' unsupported ' ELSE 'cannot say' END"


@query(f"SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS supported, count(*) FILTER (WHERE quality = 1 AND toxic <> 0) AS partial, count(*) FILTER (WHERE quality <> 1) AS unsupported, round(count(*) FILTER (WHERE quality = 1 AND toxic = 0) / count(*), 6) AS precision, round(count(*) FILTER (WHERE quality = 1 AND toxic = 0) / nullif(count(*) FILTER (WHERE (quality = 1 AND toxic = 0) OR quality <> 1), 0), 6) AS strict_precision FROM labels JOIN documents USING (doc_id)")
def enrichment_precision(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", X.judge_label(F.expr(LABEL)).alias("label"))
    return M.enrichment_precision(labels.join(table(spark, sf, "documents").select("doc_id"), "doc_id"))


@query(f"SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'SUPPORTED' WHEN quality = 1 THEN 'PARTIALLY_SUPPORTED' ELSE 'UNSUPPORTED' END AS label, concat_ws('|', doc_id::VARCHAR, quality::VARCHAR, toxic::VARCHAR, 'x') AS sample_id FROM labels")
def label_decode(spark, sf):
    return table(spark, sf, "labels").select("doc_id", X.judge_label(F.expr(LABEL)).alias("label"), X.sample_id(F.col("doc_id"), F.col("quality").cast("string"), F.col("toxic").cast("string"), F.lit("x")).alias("sample_id"))


@query("SELECT a.vec_id, b.vec_id AS item_vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id)::INT AS rank FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) a, embeddings b QUALIFY rank <= 3")
def topk_similarity(spark, sf):
    """The vectors of ids divisible by 100 are searched among all."""
    e = table(spark, sf, "embeddings")
    return R.top_k(e.where("vec_id % 100 = 0"), e, 3, "vec_id", "vec_id").withColumn("score", F.round("score", 6))


TOP2 = "SELECT q AS vec_id, max(s) FILTER (WHERE r = 1) AS best, max(s) FILTER (WHERE r = 2) AS second FROM (SELECT a.vec_id AS q, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) GROUP BY q"


def _top2(spark, sf):
    e = table(spark, sf, "embeddings")
    return R.ranked_lists(R.top_k(e.where("vec_id % 100 = 0"), e, 2, "vec_id", "vec_id"), "vec_id", "vec_id")


@query(f"SELECT vec_id, best >= 0.3 AND coalesce(best - second >= 0.02, true) AS accepted FROM ({TOP2})")
def gate_accept(spark, sf):
    return _top2(spark, sf).select("vec_id", R.gate(F.col("scores"), 0.3, 0.02).alias("accepted"))


@query(f"SELECT concat_ws(',', CASE WHEN best < 0.3 THEN 'below_min_similarity' END, CASE WHEN best - coalesce(second, -1) < 0.02 THEN 'below_min_margin' END) AS reasons, count(*) AS n FROM ({TOP2}) GROUP BY ALL")
def align_report(spark, sf):
    s = F.col("scores")
    return _top2(spark, sf).groupBy(R.rejection_reasons(F.get(s, 0), F.get(s, 1), 0.3, 0.02).alias("reasons")).agg(F.count("*").alias("n"))


@query("SELECT vec_id, round(list_aggregate(list_transform(embedding::DOUBLE[], lambda x: x / CASE WHEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) = 0 THEN 1 ELSE sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) END), 'sum'), 5) AS total FROM embeddings")
def l2_norm(spark, sf):
    v = X.l2_normalized(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(r"""WITH l AS (SELECT conv_id, turn, role || ': ' || trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, key, value FROM (SELECT conv_id, trim(split_part(t, ':', 1)) AS key, trim(substring(t, instr(t, ':') + 1)) AS value, row_number() OVER (PARTITION BY conv_id, trim(split_part(t, ':', 1)) ORDER BY turn DESC) AS r FROM l WHERE trim(substring(t, instr(t, ':') + 1)) <> '') WHERE r = 1""")
def relation_definition_parse(spark, sf):
    line = F.concat("role", F.lit(": "), X.collapse(F.col("text")))
    whole = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("t")))).alias("l"))
    return whole.select("conv_id", F.explode(X.definitions(F.array_join(F.transform("l", lambda x: x.t), "\n"))).alias("key", "value"))


@query("SELECT n_nationkey, 'A. ''in'': lies in ' || r_name || chr(10) || 'B. ''near'': close to ' || n_name || chr(10) || 'C. None of the above.' || chr(10) AS choices, CASE n_nationkey % 4 WHEN 0 THEN 'in' WHEN 1 THEN 'near' END AS chosen FROM nation JOIN region ON r_regionkey = n_regionkey")
def choice_list(spark, sf):
    j = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    cands = F.array(F.struct(F.lit("in").alias("relation"), F.concat(F.lit("lies in "), "r_name").alias("definition")), F.struct(F.lit("near").alias("relation"), F.concat(F.lit("close to "), "n_name").alias("definition")))
    answer = F.get(F.array(F.lit("A. in"), F.lit("B"), F.lit("C"), F.lit("")), (F.col("n_nationkey") % 4).cast("int"))
    return j.select("n_nationkey", X.choice_list(cands).alias("choices"), X.choice(F.transform(cands, lambda x: x.relation), answer).alias("chosen"))


@query("SELECT doc_id, 'Language: ' || lang || chr(10) || 'Source: ' || source || chr(10) || chr(10) || text AS prompt FROM documents")
def prompt_build(spark, sf):
    p = models.prompt("Language: {lang}\nSource: {source}\n\n{text}", lang=F.col("lang"), source=F.col("source"), text=F.col("text"))
    return table(spark, sf, "documents").select("doc_id", p.alias("prompt"))


@query("SELECT key, definition FROM (SELECT p_brand AS key, trim(p_name || ' ' || p_type) AS definition, row_number() OVER (PARTITION BY p_brand ORDER BY length(trim(p_name || ' ' || p_type)) DESC, trim(p_name || ' ' || p_type)) AS r FROM part) WHERE r = 1")
def longest_definition(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("key"), F.concat_ws(" ", "p_name", "p_type").alias("t"))
    return O.longest(rows, "key", "t")


@query("SELECT DISTINCT c_mktsegment AS prop, a.n_name AS domain, b.r_name AS range FROM customer JOIN nation a ON a.n_nationkey = c_nationkey JOIN region b ON b.r_regionkey = a.n_regionkey")
def domain_range_pairs(spark, sf):
    c, n, r = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "region")
    few = c.select("c_mktsegment", "c_nationkey").distinct()
    j = few.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("c_mktsegment").alias("prop"), F.col("n_name").alias("domain"), F.col("r_name").alias("range")).distinct()


@query("""WITH RECURSIVE e AS (SELECT s_name AS child, n_name AS parent FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION SELECT r_name, 'WORLD' FROM region),
c AS (SELECT * FROM e UNION SELECT c.child, e.parent FROM c JOIN e ON e.child = c.parent) SELECT * FROM c""")
def subclass_closure(spark, sf):
    s, n, r = table(spark, sf, "supplier"), table(spark, sf, "nation"), table(spark, sf, "region")
    links = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("child"), F.col("n_name").alias("parent"))
    links = links.union(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")).union(r.select("r_name", F.lit("WORLD")))
    return O.closure(links)


EVENT = "SELECT event_id, user_id, ts, CASE WHEN value < 50 THEN '' ELSE event_type END AS cell, event_type IN ('purchase', 'logout') OR value > 90 AS ends, CASE WHEN event_type = 'signup' OR value < 10 THEN event_type END AS title, event_type FROM events"


def _event_rows(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", "user_id", "ts", "CASE WHEN value < 50 THEN '' ELSE event_type END AS cell", "event_type IN ('purchase', 'logout') OR value > 90 AS ends", "CASE WHEN event_type = 'signup' OR value < 10 THEN event_type END AS title", "event_type")


@query(f"SELECT event_id, coalesce(last_value(nullif(cell, '') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), cell) AS cell FROM ({EVENT})")
def fill_down(spark, sf):
    return L.fill_down(_event_rows(spark, sf), "user_id", "event_id", "cell").select("event_id", "cell")


@query(f"SELECT user_id, island, string_agg(event_type, ' ' ORDER BY event_id) AS merged FROM (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS island FROM ({EVENT})) GROUP BY ALL")
def island_sentences(spark, sf):
    return L.merge_islands(_event_rows(spark, sf), "user_id", "event_id", "event_type", F.col("ends"))


@query(f"SELECT event_id, sum((title IS NOT NULL)::INT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS section FROM ({EVENT})")
def section_merge(spark, sf):
    return L.section_islands(_event_rows(spark, sf), "user_id", "event_id", "title").select("event_id", "section")


@query("""WITH b AS (SELECT user_id AS page, round(value, 3) AS y FROM events WHERE event_type = 'click' UNION ALL SELECT DISTINCT user_id, 0.0 FROM events UNION ALL SELECT DISTINCT user_id, 100.0 FROM events)
SELECT page, y AS band_top, band_bottom FROM (SELECT page, y, lead(y) OVER (PARTITION BY page ORDER BY y) AS band_bottom FROM b) WHERE band_bottom - y > 5""")
def band_bounds(spark, sf):
    e = table(spark, sf, "events")
    pages = e.select(F.col("user_id").alias("page")).distinct().withColumn("height", F.lit(100.0))
    return L.bands(e.where("event_type = 'click'").select(F.col("user_id").alias("page"), F.round("value", 3).alias("top")), pages)


@query("""WITH w AS (SELECT event_id, user_id AS page, value AS x0, value + 4 AS x1, event_id % 100 AS top, event_id % 100 + 2 AS bottom FROM events), b AS (SELECT page, k AS box_id, 20.0 * k AS x0, 10.0 * k AS top, 20.0 * k + 15 AS x1, 10.0 * k + 30 AS bottom FROM (SELECT DISTINCT user_id AS page FROM events), (SELECT unnest(range(4))::INT AS k))
SELECT event_id, box_id FROM w JOIN b USING (page) WHERE (w.x0 + w.x1) / 2 BETWEEN b.x0 - 1 AND b.x1 + 1 AND (w.top + w.bottom) / 2 BETWEEN b.top - 1 AND b.bottom + 1""")
def word_in_bbox(spark, sf):
    e = table(spark, sf, "events")
    words = e.select("event_id", F.col("user_id").alias("page"), F.col("value").alias("x0"), (F.col("value") + 4).alias("x1"), (F.col("event_id") % 100).alias("top"), (F.col("event_id") % 100 + 2).alias("bottom"))
    boxes = e.select(F.col("user_id").alias("page")).distinct().select("page", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("box_id"))
    boxes = boxes.selectExpr("page", "box_id", "20D * box_id AS x0", "10D * box_id AS top", "20D * box_id + 15 AS x1", "10D * box_id + 30 AS bottom")
    return L.words_in_boxes(words, boxes).select("event_id", "box_id")


@query("""WITH k AS (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events) SELECT user_id, k, event_type, event_id FROM k WHERE k IS NOT NULL""")
def json_props(spark, sf):
    return table(spark, sf, "events").select("user_id", F.from_json("props", "k bigint").k.alias("k"), "event_type", "event_id").where("k is not null")


PAIRS = "SELECT o_orderkey AS entry, o_orderpriority AS class, o_totalprice > 50000 AS in_gold, o_orderstatus <> 'O' AS in_pred FROM orders"


@query(f"""WITH c AS (SELECT class, count(*) FILTER (WHERE in_gold AND in_pred) AS tp, count(*) FILTER (WHERE NOT in_gold AND in_pred) AS fp, count(*) FILTER (WHERE in_gold AND NOT in_pred) AS fn FROM ({PAIRS}) GROUP BY class)
SELECT round(avg(coalesce(tp / nullif(tp + fp, 0), 0)), 6) AS macro_precision, round(avg(coalesce(tp / nullif(tp + fn, 0), 0)), 6) AS macro_recall, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1 FROM c""")
def macro_prf(spark, sf):
    return M.macro_prf(table(spark, sf, "orders").selectExpr("o_orderkey AS entry", "o_orderpriority AS class", "o_totalprice > 50000 AS in_gold", "o_orderstatus <> 'O' AS in_pred"))


@query("SELECT relation, ord, definition FROM (SELECT p_type AS relation, min(p_partkey) AS ord, arg_max(p_name, p_partkey) AS definition FROM part GROUP BY p_type)")
def schema_last_wins(spark, sf):
    return O.last_definition(table(spark, sf, "part").select(F.col("p_type").alias("relation"), F.col("p_name").alias("definition"), "p_partkey"), "relation", "definition", "p_partkey")


@query("""WITH RECURSIVE m AS (SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON instr(lower(d.text), lower(b.text)) > 0) SELECT * FROM m""")
def benchmark_contained(spark, sf):
    """Documents that hold a benchmark text (case-insensitive). Hash of up to 8 inner words meets by equi join; the whole is then compared.

    An item of one or two words has no inner ones: its longest meets the documents' distinct words at its first characters.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")
    texts = table(spark, sf, "documents").where("text is not null").select("doc_id", F.lower("text").alias("t"))
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", words(F.col("text")).alias("w"))
    b = table(spark, sf, "benchmark").where("text is not null").select("item_id", F.lower("text").alias("low"), words(F.col("text")).alias("w"))
    distinct = lambda lists: F.array_distinct(F.flatten(F.array(*lists)))
    # Inner words: the first and last may touch other text.
    inner = b.where(F.size("w") >= 3).withColumn("n", F.least(F.size("w") - 2, F.lit(8)))
    lengths = sorted(r.n for r in inner.select("n").distinct().collect())
    short = b.where(F.size("w").between(1, 2)).select("item_id", "low", F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))).x.alias("k"))
    short = short.withColumn("gram", F.substring("k", 1, 4))
    grams = sorted(r.n for r in short.select(F.length("gram").alias("n")).distinct().collect())
    blank = b.where(F.size("w") == 0).select("item_id", "low")
    near = spark.createDataFrame([], texts.select("doc_id").join(b.select("item_id", "low")).schema)
    if lengths:
        starts = lambda n: F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        runs = lambda n: F.transform(starts(n), lambda i: F.xxhash64(F.slice("w", i, n)))
        hashes = distinct(runs(n) for n in lengths)
        keys = inner.select("item_id", "low", F.xxhash64(F.slice("w", F.lit(2), F.col("n"))).alias("h"))
        near = near.union(d.select("doc_id", F.explode(hashes).alias("h")).join(keys, "h").select("doc_id", "item_id", "low"))
    if grams:
        placed = d.select("doc_id", F.explode(F.array_distinct("w")).alias("word"))
        cut = lambda n: F.when(F.length("word") >= n, F.transform(F.sequence(F.lit(1), F.length("word") - (n - 1)), lambda i: F.col("word").substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        known = placed.select("word").distinct().select("word", F.explode(distinct(cut(n) for n in grams)).alias("gram"))
        held = known.join(short, "gram").where(F.contains("word", "k")).select("word", "item_id", "low")
        near = near.union(placed.join(held, "word").select("doc_id", "item_id", "low").distinct())
    full = near.join(texts, "doc_id").where(F.instr("t", F.col("low")) > 0).select("doc_id", "item_id")
    if blank.isEmpty():
        return full
    spaces = texts.join(F.broadcast(blank.select("low").distinct()), F.contains("t", F.col("low"))).select("doc_id", "low")
    return full.union(spaces.join(blank, "low").select("doc_id", "item_id"))


@query("WITH {KG} SELECT s, p, o, (row_number() OVER (ORDER BY s, p, o) - 1) AS gold_id FROM gn")
def gold_ids(spark, sf):
    """Ids by lexicographic rank over all rows, without a window that one task would order."""
    return global_index(A.gold_norm(V.gold(spark, sf)), A.NORM, "gold_id")


@query()
def cell_fixes(spark, sf):
    """All documents; word boundaries of Java and DuckDB differ beside letters that are not ASCII."""
    uri = F.concat_ws("", "source", F.lit("/"), "lang", F.lit("#src:"), "source")
    return table(spark, sf, "documents").select("doc_id", X.local_name(uri).alias("name"), X.fix_spaced_word(X.newlines(F.col("text"))).alias("fixed"))


# Beyond SQL: tests compare these with plain versions.


@query()
def adaptive_chunks(spark, sf):
    d = table(spark, sf, "documents")
    marked = d.select("doc_id", K.marked_up(F.col("source"), F.col("text")).alias("text"))
    return K.adaptive_chunks(marked)


@query()
def bracket_parse(spark, sf):
    c = table(spark, sf, "conversations")
    quoted = F.col("text")
    for sign, escape in {"\\": r"\\", '"': r"\"", "\n": r"\n", "\r": r"\r", "\0": r"\x00", "[": r"\x5b", "]": r"\x5d"}.items():  # a bare bracket would end the list
        quoted = F.replace(quoted, F.lit(sign), F.lit(escape))
    said = F.concat(F.lit("Triplets: [['"), "role", F.lit("', 'says', \""), quoted, F.lit("\"], ['_', 'a', 'b'], ['x', ['y', 'z']]]"))
    return c.select("conv_id", "turn", F.explode(parsing.parse_completion(said)).alias("t")).select("conv_id", "turn", F.to_json("t").alias("triple"))


@query()
def literal_parse(spark, sf):
    n = table(spark, sf, "nation")
    line = F.concat(F.lit("[('"), "n_name", F.lit("', 'in', 'x'), ['a', \"b'c\", 'd']]"))
    return n.select("n_nationkey", F.to_json(parsing.literal_triples(line)).alias("triples"))


@query()
def canonicalize(spark, sf):
    triples = V.predictions(spark, sf).withColumn("definition", F.concat(F.lit("something is "), F.regexp_replace("predicate", r"([a-z])([A-Z])|_", "$1 $2")))
    schema = spark.createDataFrame([(0, "located in", "something is located in a place"), (1, "part of", "something is part of a whole")], "ord int, relation string, definition string")
    return C.canonicalize(triples, schema).select("pred_id", "predicate", "canonical")


@query()
def canonicalize_enrich(spark, sf):
    triples = V.predictions(spark, sf).withColumn("definition", F.concat(F.lit("something is "), F.regexp_replace("predicate", r"([a-z])([A-Z])|_", "$1 $2")))
    schema = spark.createDataFrame([(0, "located in", "something is located in a place")], "ord int, relation string, definition string")
    return C.canonicalize_enriched(triples, schema, "pred_id").select("pred_id", "predicate", "canonical")


@query()
def refine_hints(spark, sf):
    e = table(spark, sf, "events")
    prev = e.where("value < 50").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("previous"))
    got = e.where("value >= 50").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("retrieved"))
    known = F.create_map(F.lit("click"), F.lit("user clicks"), F.lit("purchase"), F.lit("user buys"))
    return C.refine_hints(prev, got, "user_id", known)


@query()
def span_scores(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    j = table(spark, sf, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    triple = lambda a, b, c: F.array(a, b, c)
    ref = F.array(triple(F.col("s_name"), F.lit("located in"), F.col("n_name")), triple(F.col("n_name"), F.lit("part of"), F.col("r_name")))
    cand = F.array(triple(F.col("n_name"), F.lit("part of"), F.when(F.col("s_suppkey") % 3 == 0, "ASIA").otherwise(F.col("r_name"))), triple(F.col("n_name"), F.lit("is located in"), F.col("s_name")))
    return S.span_scores(j.select(ref.alias("ref"), cand.alias("cand")), "ref", "cand")


@query()
def text_lines(spark, sf):
    e = table(spark, sf, "events")
    return L.text_lines(e.select(F.col("user_id").alias("page"), F.col("event_type").alias("text"), F.col("value").alias("x0"), (F.col("event_id") % 700).cast("double").alias("top")))


@query()
def knowledge_graph(spark, sf):
    """The whole pipeline with offline models over all conversations as documents."""
    docs = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text")
    schema = spark.createDataFrame([(0, "the", "the thing"), (1, "and", "and so on")], "ord int, relation string, definition string")
    return extract(docs, schema, f"{shared_folder(spark)}/kgspark/{uuid.uuid4().hex}-kg", JobConfig(chunking="sentences"))
