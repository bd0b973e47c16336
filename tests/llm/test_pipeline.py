"""The pipeline against a brute-force version of its stages."""

import struct
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import public_tokenizers
from tokenizers import Tokenizer

from kgspark.llm import quality, queries

from .conftest import DATA
from .test_bytes import removed
from .test_text import class_ids


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    c = duckdb.connect()
    c.register("documents", docs.toArrow())
    kept = {r[0] for r in c.sql(f"select doc_id from ({quality.ORACLE_SQL}) where kept").fetchall()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    first = {d for d, name, _ in class_ids(rows) if d == name}
    text = {}
    for d, _, n, _, _, raw in removed([r for r in rows if r[0] in first]):
        text[d] = raw
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = corpus_pipeline.run(spark, DATA).collect()
    got = defaultdict(list)
    for r in out:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert set(got) == first
    for d, raw in text.items():
        try:
            ids = [*lib.encode(raw.decode(), add_special_tokens=False).ids, 1]
        except UnicodeDecodeError:  # a cut within a character keeps the character
            continue
        want = [(k, a, len(ids[a : a + 4096]), zlib.crc32(struct.pack(f"<{len(ids[a:a + 4096])}I", *ids[a : a + 4096]))) for k, a in enumerate(range(0, len(ids), 4096))]
        assert sorted(got[d]) == want


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "packing"]
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, DATA).columns == docs.columns, name
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_stages_on_edge_rows(spark, edge):
    """Nulls, empty and very long texts, ties, repeats and clashing names: each stage against its own plain version."""
    c = duckdb.connect()
    c.register("documents", edge.select("doc_id", "text", "lang", "source").toArrow())
    want = Counter(r for (r,) in c.sql(f"select doc_id from ({quality.ORACLE_SQL}) where kept").fetchall())
    kept = corpus_pipeline.quality_rules(spark, edge, DATA)
    assert kept.columns == edge.columns and Counter(r.doc_id for r in kept.collect()) == want
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    one = corpus_pipeline.near_duplicates(spark, edge, DATA).collect()
    assert len(one) == len({(name, size) for _, name, size in class_ids(rows)}) and set(one[0].asDict()) == set(edge.columns)
    cut = corpus_pipeline.repeated_passages(spark, edge, DATA)
    assert cut.columns == edge.columns and cut.count() == len(rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut.collect())
    packed = corpus_pipeline.packing(spark, edge, DATA).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(d for d, _ in rows)


def test_two_runs_do_not_disturb_each_other(spark):
    a = corpus_pipeline.run(spark, DATA)
    b = corpus_pipeline.run(spark, DATA)
    assert a.count() == b.count()


def test_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
