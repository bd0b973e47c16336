"""Queries of parsers, page layout, ontology details, stage records, retriever data and judging, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models
from ..functions import parsing as P
from ..functions import text as X
from ..operators import chunking as K
from ..operators import evaluation as E
from ..operators import layout as L
from ..operators import metrics as M
from ..operators import ontology as O
from ..operators import refinement as N
from ..operators import retriever_data as D
from ..operators import spans as S
from ..operators import triples as T
from ..operators.ordering import global_index
from . import views as V
from .queries import STRIP, query, table

LINES = "SELECT doc_id, (i - 1)::INT AS line_ix, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"


@query(f"SELECT doc_id, line_ix, length(line) <= 120 AND NOT ends_with(line, '.') AND NOT regexp_matches(line, '^(-|•|o )') AND len(list_filter(string_split_regex(trim(line), '\\s+'), lambda x: x <> '')) BETWEEN 1 AND 12 AS title, regexp_matches(line, '^\\s*([-*•]|\\d+\\.)\\s+') AS bullet FROM ({LINES})")
def line_kinds(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_ix", "line"))
    return rows.select("doc_id", "line_ix", X.looks_like_title(F.col("line")).alias("title"), X.is_bullet(F.col("line")).alias("bullet"))


@query("SELECT conv_id, turn, array_to_string(list_slice(list_concat(string_split(text, ' '), ['', '', '', '', '']), 1, 5), '|') AS cells FROM conversations")
def padded_rows(spark, sf):
    cells = L.pad_row(F.split("text", " "), F.lit(5))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(cells, "|").alias("cells"))


@query("SELECT event_id FROM (SELECT event_id, value AS x0, value + event_id % 100 AS x1, 1.0 AS top, 1.0 + event_id % 5 AS bottom, 100.0 AS width FROM events) WHERE x1 - x0 >= 0.6 * width AND bottom - top <= 3")
def separator_lines(spark, sf):
    lines = table(spark, sf, "events").selectExpr("event_id", "value AS x0", "value + event_id % 100 AS x1", "1D AS top", "1D + event_id % 5 AS bottom", "100D AS width")
    return L.separators(lines).select("event_id")


@query("""WITH b AS (SELECT user_id AS page, event_id % 3 AS band, event_id % 50 AS top, event_type AS text, event_type IN ('signup', 'purchase') AS anchor FROM events),
r AS (SELECT page, band, top, CASE WHEN anchor THEN 'anchor' ELSE 'line' END AS kind, CASE WHEN anchor THEN '[TABLE ' || text || ']' ELSE text END AS text FROM b)
SELECT page, band, (row_number() OVER (PARTITION BY page, band ORDER BY top, kind, text) - 1)::INT AS seq, kind, text FROM r""")
def inline_anchors(spark, sf):
    b = table(spark, sf, "events").selectExpr("user_id AS page", "event_id % 3 AS band", "event_id % 50 AS top", "event_type AS text", "event_type IN ('signup', 'purchase') AS is_anchor")
    anchors = b.where("is_anchor").select("page", "band", "top", F.concat(F.lit("[TABLE "), "text", F.lit("]")).alias("anchor"))
    return L.inline_anchors(b.where("not is_anchor"), anchors)


@query("""WITH w AS (SELECT event_id, user_id AS page, value AS x0, value + 4 AS x1, event_id % 100 AS top, event_id % 100 + 2 AS bottom FROM events), b AS (SELECT page, k AS box_id, 20.0 * k AS x0, 10.0 * k AS top, 20.0 * k + 15 AS x1, 10.0 * k + 30 AS bottom FROM (SELECT DISTINCT user_id AS page FROM events), (SELECT unnest(range(4))::INT AS k))
SELECT event_id FROM w WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page = w.page AND (w.x0 + w.x1) / 2 BETWEEN b.x0 - 1 AND b.x1 + 1 AND (w.top + w.bottom) / 2 BETWEEN b.top - 1 AND b.bottom + 1)""")
def words_outside(spark, sf):
    e = table(spark, sf, "events")
    words = e.select("event_id", F.col("user_id").alias("page"), F.col("value").alias("x0"), (F.col("value") + 4).alias("x1"), (F.col("event_id") % 100).alias("top"), (F.col("event_id") % 100 + 2).alias("bottom"))
    boxes = e.select(F.col("user_id").alias("page")).distinct().select("page", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("box_id"))
    boxes = boxes.selectExpr("page", "box_id", "20D * box_id AS x0", "10D * box_id AS top", "20D * box_id + 15 AS x1", "10D * box_id + 30 AS bottom")
    return L.words_outside(words, boxes, "event_id").select("event_id")


@query()
def unique_headers(spark, sf):
    """Header names of each conversation: the first words of its turns, each made unique."""
    words = F.sort_array(F.collect_list(F.struct("turn", F.substring_index(F.lower("text"), " ", 1).alias("w"))))
    rows = table(spark, sf, "conversations").where("text is not null").groupBy("conv_id").agg(F.transform(words, lambda x: x.w).alias("names"))
    return rows.select("conv_id", F.posexplode(L.unique_headers_udf("names")).alias("ix", "header"))


@query()
def kept_separators(spark, sf):
    tops = F.collect_list((F.col("event_id") % 97).cast("double"))
    return table(spark, sf, "events").groupBy("user_id").agg(tops.alias("t")).select("user_id", F.explode(L.kept_separators_udf("t")).alias("top"))


@query("SELECT n_nationkey, '[' || chr(10) || '{\"name\":\"' || n_name || '\"},' || chr(10) || '{\"key\":\"' || n_nationkey || '\"}' || chr(10) || ']' AS block FROM nation")
def table_blocks(spark, sf):
    n = table(spark, sf, "nation")
    rows = F.array(F.create_map(F.lit("name"), F.col("n_name"), F.lit("_row"), F.lit("0")), F.create_map(F.lit("_page"), F.lit("1"), F.lit("key"), F.col("n_nationkey").cast("string")))
    return n.select("n_nationkey", L.table_block(rows).alias("block"))


@query("SELECT r_regionkey, CASE WHEN r_regionkey % 3 = 0 THEN r_name || '|' || r_regionkey WHEN r_regionkey % 3 = 1 THEN '' END AS found FROM region")
def entity_lists(spark, sf):
    """Entities of answers: a list, an unreadable list, no list."""
    r = table(spark, sf, "region")
    key = F.col("r_regionkey") % 3
    answer = F.when(key == 0, F.concat(F.lit("Entities: ['"), "r_name", F.lit("', '"), F.col("r_regionkey").cast("string"), F.lit("'] and more ['x']"))).when(key == 1, "[no, list").otherwise("none")
    answer = F.when(key == 1, "[{not a list}]").otherwise(answer)
    return r.select("r_regionkey", F.array_join(P.entities(answer), "|").alias("found"))


@query("SELECT user_id, sum(greatest(b - a, 0))::BIGINT AS dropped FROM (SELECT user_id, event_type, count(*) FILTER (WHERE value < 50) AS b, count(*) FILTER (WHERE value >= 50) AS a FROM events GROUP BY ALL) GROUP BY user_id")
def dropped_counts(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("value") < 50).alias("b"), F.count_if(F.col("value") >= 50).alias("a"))
    return c.groupBy("user_id").agg(T.dropped(F.col("b"), F.col("a")).alias("dropped"))


@query("SELECT DISTINCT n_name AS subject, 'subClassOf' AS predicate, r_name AS object FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 2 = 0")
def subclass_triples(spark, sf):
    """subClassOf between named classes; odd nations have no name."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    statements = n.select(F.concat(F.lit("x#n"), "n_nationkey").alias("s"), F.lit("rdfs:subClassOf").alias("p"), F.concat(F.lit("x#r"), "n_regionkey").alias("o"), F.lit("uri").alias("kind"))
    statements = statements.union(statements.select("s", F.lit("rdf:type"), F.lit("owl:Class"), "kind"))
    names = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("x#n"), "n_nationkey").alias("uri"), F.col("n_name").alias("name")).union(r.select(F.concat(F.lit("x#r"), "r_regionkey"), "r_name"))
    return O.subclass_triples(statements, names)


@query("WITH {KG}, a AS (SELECT DISTINCT p FROM pn), b AS (SELECT DISTINCT p FROM gn) SELECT (SELECT count(*) FROM a) AS system, (SELECT count(*) FROM b) AS gold, (SELECT count(*) FROM a JOIN b USING (p)) AS overlap")
def name_overlap(spark, sf):
    from ..operators import alignment as A

    pred = A.with_norm(V.predictions(spark, sf)).select(F.col("p").alias("relation"))
    return O.name_overlap(pred, A.gold_norm(V.gold(spark, sf)).select(F.col("p").alias("relation")))


@query("SELECT p_brand AS key, string_agg(p_name, '|' ORDER BY p_partkey, p_name) AS definitions FROM part GROUP BY p_brand")
def definition_lists(spark, sf):
    rows = O.definition_lists(table(spark, sf, "part").select(F.col("p_brand").alias("key"), "p_name", "p_partkey"), "key", "p_name", "p_partkey")
    return rows.select("key", F.array_join("definitions", "|").alias("definitions"))


@query("WITH t AS (SELECT p_brand AS key, p_partkey, CASE WHEN p_brand <> 'Brand#11' THEN nullif(trim(regexp_replace(p_type, '\\s+', ' ', 'g')), '') END AS t FROM part) SELECT key, arg_min(t, (-length(t), p_partkey)) AS definition, CASE WHEN count(t) = 0 THEN 'no comment' END AS warning FROM t GROUP BY key")
def longest_comment(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("key"), F.when(F.col("p_brand") != "Brand#11", F.col("p_type")).alias("t"), "p_partkey")
    return O.longest_comment(rows, "key", "t", "p_partkey")


@query(f"""WITH w AS (SELECT doc_id, i, trim(substring(text, i + 1, 1000), {STRIP}) AS c FROM (SELECT doc_id, text, unnest(range(0, length(text), 800))::INT AS i FROM documents))
SELECT doc_id, i AS start_char, row_number() OVER (ORDER BY doc_id, i) - 1 AS global_index FROM w WHERE c <> ''""")
def chunk_index(spark, sf):
    chunks = K.char_windows(table(spark, sf, "documents").select("doc_id", "text"))
    return global_index(chunks.select("doc_id", "start_char"), ["doc_id", "start_char"], "global_index")


MESSAGE = """'Triple: [' || CASE WHEN contains(c_name, '''') THEN '"' || c_name || '"' ELSE '''' || c_name || '''' END || ', ''placed by'', ''' || c_mktsegment || ''']' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE chr(10) || 'Novelty reason: unknown_relation' END || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN '(No source text snippet available.)' ELSE 'Source text snippet:' || chr(10) || '\"\"\"' || chr(10) || substring(repeat(c_name || ' ', 60), 1, 600) || chr(10) || '\"\"\"' END"""
JUDGED = "(SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'it''s ' || c_name ELSE c_name END AS c_name, c_mktsegment FROM customer)"


def _messages(spark, sf):
    c = table(spark, sf, "customer").withColumn("c_name", F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("it's "), "c_name")).otherwise(F.col("c_name")))
    snippet = F.when(F.col("c_custkey") % 2 == 0, "  ").otherwise(F.repeat(F.concat("c_name", F.lit(" ")), F.lit(60)))
    return c.withColumn("message", X.judge_message(F.col("c_name"), F.lit("placed by"), F.col("c_mktsegment"), snippet, F.when(F.col("c_custkey") % 3 != 0, "unknown_relation")))


@query(f"SELECT c_custkey, {MESSAGE} AS message FROM {JUDGED}")
def judge_messages(spark, sf):
    return _messages(spark, sf).select("c_custkey", "message")


def segment_judge():
    """A stand-in judge that goes by the segment in the message; it fails on some prompts."""

    def run(prompts):
        out = []
        for p in prompts:
            if "MACHINERY" in p:
                raise OSError("no answer")
            out.append("Supported" if "BUILDING" in p else "rather partially_supported." if "FURNITURE" in p else "?")
        return out

    return run


@query("SELECT c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 'SUPPORTED' WHEN c_mktsegment = 'FURNITURE' THEN 'PARTIALLY_SUPPORTED' ELSE 'UNSUPPORTED' END AS label FROM customer GROUP BY c_mktsegment")
def judge_labels(spark, sf):
    rows = table(spark, sf, "customer").select("c_mktsegment").distinct()
    message = X.judge_message(F.lit("a"), F.lit("b"), F.col("c_mktsegment"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return models.judge(rows.withColumn("message", message), "message", "label", segment_judge).drop("message")


@query("SELECT s_suppkey, n_name || ': ' || s_name AS text, substring(s_name, 1, 5) AS snippet FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def embed_texts(spark, sf):
    j = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))
    return j.select("s_suppkey", X.text_to_embed(F.col("n_name"), F.col("s_name")).alias("text"), X.snippet(F.col("s_name"), 5).alias("snippet"))


@query("""SELECT p.pred_id, 'doc' || n_nationkey AS doc_id, 'doc' || n_nationkey || '::chunk_00000' AS chunk_id, substring(coalesce(n_name, ''), 1, 500) AS source_text_snippet FROM (SELECT o_orderkey AS pred_id, o_orderkey % 40 AS line_idx FROM orders) p LEFT JOIN nation ON n_nationkey = line_idx""")
def stage_join(spark, sf):
    """Predictions with what their line's stage record says; lines without one stay."""
    preds = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pred_id"), (F.col("o_orderkey") % 40).cast("bigint").alias("line_idx"))
    n = table(spark, sf, "nation")
    stages = n.select(F.col("n_nationkey").cast("bigint").alias("index"), F.concat(F.lit("doc"), "n_nationkey").alias("doc_id"), F.concat(F.lit("doc"), "n_nationkey", F.lit("::chunk_00000")).alias("chunk_id"), F.lit(None).cast("string").alias("section_title"), F.col("n_name").alias("input_text"))
    return E.with_stages(preds, stages).select("pred_id", "doc_id", "chunk_id", "source_text_snippet")


@query("SELECT count(DISTINCT p) AS unique_predicates_after_canonicalization FROM (SELECT lower(n_name) AS p FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'part of')")
def canonical_predicates(spark, sf):
    n = table(spark, sf, "nation")
    lists = F.array(F.array(F.lit("a"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("part_of"), F.lit("b")), F.array(F.lit("too"), F.lit("short")), F.lit(None).cast("array<string>"))
    return E.canonical_predicates(n.select(lists.alias("schema_canonicalization")))


@query("""WITH o AS (SELECT o_orderkey AS line_ix, o_orderkey % 4 AS g, o_custkey % 5 AS p, o_orderkey % 7 = 0 AS bad FROM orders)
SELECT line_ix, p AS n_predicted, g AS n_gold FROM o WHERE NOT (bad AND p > 0) AND abs(g - p) <= 1""")
def paired_lines(spark, sf):
    o = table(spark, sf, "orders")
    triple = F.array(F.lit("a"), F.lit("r"), F.lit("b"))
    short = F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("a"), F.lit("r"))).otherwise(triple)
    gold = o.select(F.col("o_orderkey").alias("line_ix"), F.array_repeat(triple, (F.col("o_orderkey") % 4).cast("int")).alias("triples"))
    pred = o.select(F.col("o_orderkey").alias("line_ix"), F.array_repeat(short, (F.col("o_custkey") % 5).cast("int")).alias("triples"))
    return S.paired_lines(pred, gold, max_length_diff=1).select("line_ix", F.size("predicted").cast("bigint").alias("n_predicted"), F.size("gold").cast("bigint").alias("n_gold"))


@query(r"""SELECT p_partkey, lower(p_name) || ' elan de ' || lower(p_brand) AS subject, trim(regexp_replace(lower(p_type), '\s+', ' ', 'g')) AS object FROM part""")
def span_triples(spark, sf):
    t = F.array(F.concat("p_name", F.lit("_Élan_dé "), "p_brand"), F.lit("brandOf"), F.concat("p_type", F.lit("  (a Çode)")))
    out = table(spark, sf, "part").select("p_partkey", S.span_triple(t).alias("t"))
    return out.select("p_partkey", F.get("t", 0).alias("subject"), F.get("t", 2).alias("object"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 1) AS q FROM lineitem")
def half_even(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", M.round_even(F.col("l_quantity").cast("double") / 4, 1).alias("q"))


PAIR_ROWS = """SELECT s_suppkey AS id, s_name || ' lies in ' || n_name AS text, ['in ' || n_name, 'made by', 'near ' || s_nationkey % 7] AS rel FROM supplier JOIN nation ON n_nationkey = s_nationkey"""


@query(f"""WITH r AS ({PAIR_ROWS}), pos AS (SELECT id, list_sort([rel[1], rel[3]]) AS pos FROM r), d AS (SELECT id, unnest(rel) AS relation FROM r),
every AS (SELECT relation, 'def of ' || relation || ' by ' || min(id) AS definition, row_number() OVER (ORDER BY relation) - 1 AS place FROM d GROUP BY relation), n AS (SELECT count(*) AS n FROM every),
k AS (SELECT id, pos, k, (id * 2654435761 % 4294967296 % n + k) % n AS place FROM pos, n, (SELECT unnest(range(4)) AS k) WHERE k <= least(len(pos) + 1, n - 1)),
neg AS (SELECT id, pos, relation, definition, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS pair_ix FROM k JOIN every USING (place) WHERE NOT list_contains(pos, relation))
SELECT id, pair_ix::INT AS pair_ix, pos[pair_ix + 1] AS positive_relation, relation AS negative_relation, pos[pair_ix + 1] || ': def of ' || pos[pair_ix + 1] || ' by ' || id AS positive, relation || ': ' || definition AS negative FROM neg WHERE pair_ix < 2""")
def retriever_pairs(spark, sf):
    j = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))
    rel = [F.concat(F.lit("in "), "n_name"), F.lit("made by"), F.concat(F.lit("near "), (F.col("s_nationkey") % 7).cast("string"))]
    triples = F.array(F.array(F.upper("s_name"), rel[0], F.col("n_name")), F.array(F.col("s_name"), rel[1], F.lit("nobody here")), F.array(F.col("n_name"), rel[2], F.col("s_name")))
    told = F.map_from_entries(F.array(*(F.struct(r.alias("k"), F.concat(F.lit("def of "), r, F.lit(" by "), F.col("s_suppkey").cast("string")).alias("v")) for r in rel)))
    rows = j.select(F.col("s_suppkey").cast("bigint").alias("id"), F.concat("s_name", F.lit(" lies in "), "n_name").alias("text"), triples.alias("triples"), told.alias("definitions"))
    return D.training_pairs(rows).select("id", "pair_ix", "positive_relation", "negative_relation", "positive", "negative")


@query()
def refinement_hints(spark, sf):
    """Entities found, merged and relations retrieved for every conversation turn."""
    chunks = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.split(F.col("text"), r"\s+")
    triples = chunks.where(F.size(words) >= 3).select("chunk_id", F.lit(0).alias("triple_ix"), words[0].alias("subject"), F.lower(words[1]).alias("predicate"), words[2].alias("object"))
    schema = triples.groupBy(F.col("predicate").alias("relation")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation").limit(30)  # a schema of the thirty most frequent
    schema = schema.select("relation", F.concat(F.lit("the relation "), "relation").alias("definition"))
    return N.refinement_hints(chunks, triples, schema, "List the entities.\n\n{text}", "{entity_list_1}\n{entity_list_2}\n\n{text}")


def _statements(spark, sf):
    """An ontology over customers: segments are properties, nations their domains (by a union list of two), regions their ranges."""
    c, n, r = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "region")
    row = lambda df, s, p, o, kind: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("kind"))
    text = lambda *parts: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in parts))
    few = c.select("c_mktsegment", "c_nationkey").distinct().join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    prop, key = text("http://x/#", F.col("c_mktsegment")), F.col("n_nationkey").cast("string")
    node = text("_:u", F.col("c_mktsegment"), key)
    other = F.pmod(F.col("n_nationkey") + 1, F.lit(25)).cast("string")
    out = row(few, prop, "rdf:type", F.lit("owl:ObjectProperty"), "uri").union(row(few, prop, "rdfs:domain", node, "blank"))
    out = out.union(row(few, prop, "rdfs:range", text("http://x/#R", F.col("n_regionkey").cast("string")), "uri"))
    out = out.union(row(few, node, "owl:unionOf", text(node, "a"), "blank"))
    out = out.union(row(few, text(node, "a"), "rdf:first", text("http://x/#N", key), "uri")).union(row(few, text(node, "a"), "rdf:rest", text(node, "b"), "blank"))
    out = out.union(row(few, text(node, "b"), "rdf:first", text("http://x/#N", other), "uri")).union(row(few, text(node, "b"), "rdf:rest", F.lit("rdf:nil"), "uri"))
    names = n.where("n_nationkey % 2 = 0").select(text("http://x/#N", F.col("n_nationkey").cast("string")).alias("uri"), F.col("n_name").alias("name"))
    return out, names.union(r.select(text("http://x/#R", F.col("r_regionkey").cast("string")), "r_name"))


FEW = "few AS (SELECT DISTINCT c_mktsegment AS seg, n_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey), node AS (SELECT '_:u' || seg || n AS u, 'http://x/#N' || n AS a, 'http://x/#N' || ((n + 1) % 25) AS b FROM few)"


@query(f"WITH {FEW} SELECT u AS node, a AS member FROM node UNION SELECT u, b FROM node UNION SELECT u || 'a', a FROM node UNION SELECT u || 'a', b FROM node UNION SELECT u || 'b', b FROM node")
def union_members(spark, sf):
    return O.union_members(_statements(spark, sf)[0])


@query(f"""WITH {FEW}, d AS (SELECT DISTINCT seg, n FROM few UNION SELECT seg, (n + 1) % 25 FROM few), g AS (SELECT DISTINCT seg, r FROM few)
SELECT DISTINCT CASE WHEN d.n % 2 = 0 THEN n_name ELSE 'N' || d.n END AS subject, d.seg AS predicate, r_name AS object FROM d JOIN g USING (seg) JOIN nation ON n_nationkey = d.n JOIN region ON r_regionkey = g.r""")
def gold_from_ontology(spark, sf):
    """Named domain classes x named range classes of each property; odd nations are known by their local name."""
    return O.gold_triples(*_statements(spark, sf))
