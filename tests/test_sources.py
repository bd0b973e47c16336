"""Readers, writers and parsers on invented files."""

import ast
import json

from pyspark.sql import functions as F

from kgspark.functions.parsing import completion_triples
from kgspark.operators import ontology, spans
from kgspark.operators.layout import kept_separators, line_groups, unique_headers
from kgspark.sources import readers

TTL = """@prefix ex: <http://x/#> .
ex:uses a owl:ObjectProperty ; rdfs:domain [ a owl:Class ; owl:unionOf ( ex:App ex:Team ) ] ; rdfs:range ex:Tool ; rdfs:comment "is used"@en .
"""


def test_turtle(spark, tmp_path):
    (tmp_path / "o.ttl").write_text(TTL)
    got = ontology.gold_triples(readers.turtle(spark, f"file://{tmp_path}/o.ttl")).collect()
    assert sorted(map(tuple, got)) == [("App", "uses", "Tool"), ("Team", "uses", "Tool")]


def test_schema_and_triples(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a,first\nb,other\na,last\n")
    assert {(r.relation, r.definition) for r in readers.target_schema(spark, f"file://{tmp_path}/s.csv").collect()} == {("a", "last"), ("b", "other")}
    (tmp_path / "t.txt").write_text("[['x ','r','y']]\n\n[('x','r','y'), ['a','b']]\nnonsense\n[]\n")
    rows = readers.triple_lines(spark, f"file://{tmp_path}/t.txt").orderBy("line_ix").collect()
    assert [r.triples for r in rows] == [[["x", "r", "y"]], [["x", "r", "y"]], [], []]
    assert [r.warning for r in rows] == [None, "items that are no triples", "unreadable line", None]


def test_plain_parts():
    assert completion_triples("Triplets: [['a','b','c'], ['_','b','c']]") == [["a", "b", "c"]]
    assert unique_headers(["a", "a", "b", "a"]) == ["a", "a_2", "b", "a_3"]
    assert line_groups([0, 2, 3.5, 9]) == [0, 0, 1, 2] and kept_separators([1, 4, 7, 13]) == [1, 7, 13]
    assert spans.assign([[0.1, 0.9], [0.8, 0.85]]) == [1, 0]


def test_stage_records_as_list_and_lines(spark, tmp_path):
    rows = [{"index": k, "input_text": f"t{k}", "oie": [["a", "r", "b"]], "schema_canonicalizaiton": [["a", "s", "b"], None]} for k in range(3)]
    (tmp_path / "list.json").write_text(json.dumps(rows, indent=4))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    for name in ("list", "lines"):
        got = readers.stage_records(spark, f"file://{tmp_path}/{name}.json").collect()
        assert sorted(r["index"] for r in got) == [0, 1, 2] and all(r.schema_canonicalization == [["a", "s", "b"], None] for r in got)


def test_places_over_several_files(spark, tmp_path):
    """What comes last goes by path, whatever the files' sizes."""
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1.csv").write_text("a,first\n" + "".join(f"z{k},{'x' * 200}\n" for k in range(50)))
    (tmp_path / "s" / "2.csv").write_text("a,last\nb,other\n")
    got = {r.relation: r for r in readers.target_schema(spark, f"file://{tmp_path}/s").collect()}
    assert got["a"].definition == "last" and got["a"].ord == 0 and got["b"].ord == 51


def test_more_readers(spark, tmp_path):
    (tmp_path / "al.json").write_text(json.dumps({"accepted": [{"system_relation": "madeBy", "best_gold_relation": "brand of", "best_similarity": 0.9, "candidates": [{"gold_relation": "brandOf", "similarity": 0.95}]}], "rejected": [{"system_relation": "x", "candidates": [{"gold_relation": "y", "similarity": 0.2}, {"gold_relation": "", "similarity": 1.0}]}]}))
    assert {tuple(r) for r in readers.relation_alignment(spark, f"file://{tmp_path}/al.json").collect()} == {("made by", "brand of", 0.95), ("x", "y", 0.2)}
    (tmp_path / "lab.csv").write_text("sample_id,human_label,label\n1,supported,\n2,,unsupported\n1,Partially_Supported,\n3,,\n")
    assert {tuple(r) for r in readers.review_labels(spark, f"file://{tmp_path}/lab.csv").collect()} == {("1", "PARTIALLY_SUPPORTED"), ("2", "UNSUPPORTED")}
    (tmp_path / "d.json").write_text(json.dumps({"relation_definitions": {"a": " x  y ", "b": " "}}))
    assert [tuple(r) for r in readers.relation_definitions(spark, f"file://{tmp_path}/d.json").collect()] == [("a", "x y")]
    (tmp_path / "c.jsonl").write_text('{"uri": "u", "name": "n"}\nbad\n{"uri": "v"}\n')
    assert [tuple(r) for r in readers.class_names(spark, f"file://{tmp_path}/c.jsonl").collect()] == [("u", "n")]
    (tmp_path / "k.jsonl").write_text('{"sentence": "Ann lives in Rome", "triples": [["ann", "r", "ROME"]]}\n{"sentence": "x", "triples": [["a", "r", "x"]]}\n{"sentence": "x", "triples": [["x", "r"]]}\n')
    assert [r.sentence for r in readers.distant_sentences(spark, f"file://{tmp_path}/k.jsonl").collect()] == ["Ann lives in Rome"]
    (tmp_path / "p.ttl").write_text('x:uses a owl:ObjectProperty ;\n rdfs:comment "short" ;\n rdfs:comment "the longer one" .\n### \nx:relOther rdf:type owl:ObjectProperty ; rdfs:comment "no" .\n###\n')
    assert [tuple(r) for r in readers.property_comments(spark, f"file://{tmp_path}/p.ttl").collect()] == [("uses", "the longer one")]
    (tmp_path / "w.json").write_text('{"doc_id": "d", "page": 1, "text": "w", "x0": 1, "x1": 2, "top": 3, "bottom": 4}\n')
    assert readers.page_words(spark, f"file://{tmp_path}/w.json").first().text == "w"
    (tmp_path / "crawl.csv").write_text('text,triplets,relations,definitions\nt,"[[\'a\']]","[]","r: x\ns: y"\n')
    assert readers.crawled_definitions(spark, f"file://{tmp_path}/crawl.csv").first().definitions == "r: x\ns: y"


def test_writers(spark, tmp_path):
    from kgspark.sources import writers

    triples = spark.createDataFrame([("b", "r", "c"), ("a", "it's", "c"), ("b", "r", "c")], "subject string, predicate string, object string")
    writers.sorted_triples(triples, f"file://{tmp_path}/gold")
    line = "".join(f.read_text() for f in (tmp_path / "gold").glob("part*"))
    assert ast.literal_eval(line) == [("a", "it's", "c"), ("b", "r", "c")]
    cells = spark.createDataFrame([("d", 1, 0, 2, {"name": "x"})], "doc_id string, page bigint, table int, row int, cells map<string,string>")
    writers.page_tables(cells, f"file://{tmp_path}/tables")
    assert json.loads(next((tmp_path / "tables" / "doc_id=d").glob("part*")).read_text()) == {"name": "x", "_page": "1", "_table": "0", "_row": "2"}
    writers.page_texts(spark.createDataFrame([("d", "one"), ("e", "two")], "doc_id string, text string"), f"file://{tmp_path}/texts")
    assert next((tmp_path / "texts" / "doc_id=e").glob("part*")).read_text() == "two\n"
    writers.relation_json(spark.createDataFrame([("a", "x")], "relation string, definition string"), f"file://{tmp_path}/rel")
    assert json.loads("".join(f.read_text() for f in (tmp_path / "rel").glob("part*"))) == {"relations_total": 1, "relation_definitions": {"a": "x"}}
    rows = spark.range(4000).withColumn("v", F.col("id") % 7)
    writers.split_dataset(rows, f"file://{tmp_path}/split")
    parts = {r.split: r["count"] for r in spark.read.parquet(f"file://{tmp_path}/split").groupBy("split").count().collect()}
    assert sum(parts.values()) == 4000 and abs(parts["train"] / 4000 - 0.75) < 0.05 and abs(parts["test"] / 4000 - 0.125) < 0.04
