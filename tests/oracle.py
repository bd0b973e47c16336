"""Compare a query with its SQL in DuckDB: rows as multisets, columns by name."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, table):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda x: float(f"{x:.6g}") if isinstance(x, float) else x
    return sorted((tuple(clean(r[k]) for k in order) for r in table), key=lambda r: tuple((x is not None, str(type(x)) if not isinstance(x, (int, float)) else "", x) for x in r))


def compare(df, con, sql):
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(want.columns, want.fetchall())
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b, strict=True):
        assert x == y, (x, y)
    return len(a)
