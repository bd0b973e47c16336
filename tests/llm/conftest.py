import random

import pytest

DATA = "/root/testdata/sf0.001"


def invented(rng, n, words=400):
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows, odd characters, near copies, shared passages."""
    rng = random.Random(5)
    base = invented(rng, 300)
    words = base.split()
    near = [" ".join(w if i % 97 else "changed" + str(k) for i, w in enumerate(words)) for k in range(1, 5)]
    far = " ".join(w if i % 9 else "other" for i, w in enumerate(words))
    passage = invented(rng, 80)
    many = [invented(rng, 60) + "\n" + passage + "\n" + invented(rng, 70) for _ in range(12)]
    texts = [
        None, "", " \n\t ", "one", "one two", "A b C d E f", base, base, *near, far, *many, invented(rng, 40_000, 3000),
        "line\n" * 200, "é è ß 日本語    İstanbul \U0001f600 don't we'll" * 30, "#*$%&|<> " * 80, "ab " * 500, "x" * 5000, passage, passage.upper(),
        "The MIT License and the Apache license, GNU General Public License mit license", "license mit general public", "\r\n".join(["text with words " * 5] * 30),
    ]
    rows = [(k * 7 % 101, t, ["en", "fr", None, ""][k % 4], ["a", "b", None][k % 3]) for k, t in enumerate(texts)]
    return rows + [rows[6], rows[6], (None, "a null id " * 40, "en", "a"), (None, None, None, None), (rows[8][0], "same id, other text " * 20, "en", "b")]


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(edge_rows(), "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    for name in ("row", "key", "n", "w", "rep", "hub", "part", "root", "n_words", "h", "class_id", "n1", "sequence_id", "base_failed", "value", "path"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs.repartition(3)


def plain(df, *columns):
    out = [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


def both(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))
