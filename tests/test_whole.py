"""Queries over tables that their fixtures lack, against plain versions."""

import json
import random

from kgspark.plans.queries import ORACLES, QUERIES

from .oracle import compare, connect


def test_bracket_parse_whole_texts(spark, tmp_path):
    texts = ["one two three four five", 'he said "no" \\ then \\n left', "two\nlines\r\nand more of them", "a ] b [ c [[d]] 'e'", "nul \0 in it, \\x41 \\u0042", "é 日本語 " * 2000, "\\", '"', "", None]
    spark.createDataFrame([(k, 0, "user", t) for k, t in enumerate(texts)], "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [(r.conv_id, json.loads(r.triple)) for r in QUERIES["bracket_parse"](spark, str(tmp_path)).collect()]
    want = [(k, ["user", "says", t]) for k, t in enumerate(texts) if t] + [(k, ["x", "y, z"]) for k, t in enumerate(texts) if t is not None]
    assert sorted(got) == sorted(want)


def test_benchmark_contained_short_items(spark, tmp_path):
    rng = random.Random(3)
    some = ["alpha", "be", "Gamma", "x", "delta-9", "éta", "in", "thing"]
    docs = [(k, rng.choice([" ", "\n"]).join(rng.choice(some) + rng.choice(["", "s", "."]) for _ in range(rng.randint(1, 40)))) for k in range(60)] + [(60, ""), (61, None), (62, "  ")]
    items = [" ".join(rng.choice(some) for _ in range(n)) for n in range(1, 13) for _ in range(12)] + ["", " ", "\n", "a ", " in", "n", "zzz", None]
    items += [docs[k][1][a : a + n] for k in range(60) for a, n in [(k % 7, 3 + k * 2)]]
    items += [f"none{k} here" for k in range(10_100)] + ["ETA", "pha\nb"]
    for name, rows, key in [("documents", docs, "doc_id"), ("benchmark", list(enumerate(items)), "item_id")]:
        spark.createDataFrame(rows, f"{key} bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}")
        next((tmp_path / name).glob("part*")).rename(tmp_path / f"{name}.parquet")
    assert compare(QUERIES["benchmark_contained"](spark, str(tmp_path)), connect(str(tmp_path)), ORACLES["benchmark_contained"]) > 1000
