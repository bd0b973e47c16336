"""A knowledge graph over the star schema: predictions, a gold ontology and a relation alignment, in SQL of both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (relation of a prediction, gold relation, score)
ALIGNMENT = [("made by", "brand of", 0.91), ("placed by", "located in", 0.52), ("placed by", "part of", 0.88), ("located in", "part of", 0.87), ("made by", "part of", 0.2)]

PRED_SQL = """
SELECT CAST(s_suppkey * 8 AS BIGINT) AS pred_id, s_name AS subject, 'located_in' AS predicate, n_name AS object FROM supplier JOIN nation ON n_nationkey = (CASE WHEN s_suppkey % 3 = 0 THEN (s_nationkey + 1) % 25 ELSE s_nationkey END)
UNION ALL SELECT CAST(n_nationkey * 8 + 1 AS BIGINT), n_name, 'partOf', r_name FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT CAST(c_custkey * 8 + 2 AS BIGINT), c_name, 'locatedIn', n_name FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT CAST(o_orderkey * 8 + 3 AS BIGINT), CAST(o_orderkey AS VARCHAR(20)), 'placedBy', c_name FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT CAST(p_partkey * 8 + 4 AS BIGINT), p_name, 'madeBy', p_brand FROM part
UNION ALL SELECT CAST(s_suppkey * 8 + 5 AS BIGINT), n_name, 'located_in', s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 7 = 0
UNION ALL SELECT CAST(s_suppkey * 8 + 6 AS BIGINT), s_name, 'delivers to', n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 4 = 1
UNION ALL SELECT CAST(s_suppkey * 8 + 7 AS BIGINT), upper(s_name), 'Located_In', n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 4 = 0
UNION ALL SELECT CAST(p_partkey * 8 + 800000000 AS BIGINT), p_brand, 'madeBy', p_name FROM part WHERE p_partkey % 100 = 0
UNION ALL SELECT CAST(p_partkey * 8 + 800000001 AS BIGINT), p_brand, 'brandOf', p_name FROM part WHERE p_partkey % 50 = 0
UNION ALL SELECT CAST(p_partkey * 8 + 800000002 AS BIGINT), p_brand, 'brand-of', upper(p_name) FROM part WHERE p_partkey % 150 = 0
"""
GOLD_SQL = """
SELECT n_name AS subject, 'part of' AS predicate, r_name AS object FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT upper(s_name), 'Located-In', lower(n_name) FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_name, 'located_in', n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 5 = 0
UNION ALL SELECT p_brand, 'brand of', p_name FROM part WHERE p_partkey % 50 = 0
"""
ALIGN_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', CAST({s} AS DOUBLE))" for a, b, s in ALIGNMENT) + ") AS t(sys, gold_p, score)"


def norm_sql(c: str) -> str:
    """The label form as DuckDB SQL (no look-around)."""
    c = f"trim({c}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    c = f"trim(regexp_replace({c}, '@[a-z]{{2,3}}(-[a-z0-9]+)?$', '', 'i'), '\"''')"
    c = f"regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    c = f"replace(lower(replace(regexp_replace(replace({c}, '&', ' and '), '[_\\-/]+', ' ', 'g'), 'ß', 'ss')), 'ß', 'ss')"
    return f"trim(regexp_replace(regexp_replace({c}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


KG_SQL = f"""pred AS ({PRED_SQL}), gold AS ({GOLD_SQL}), align AS ({ALIGN_SQL}),
pn AS (SELECT *, {norm_sql("subject")} AS s, {norm_sql("predicate")} AS p, {norm_sql("object")} AS o FROM pred),
gn AS (SELECT DISTINCT {norm_sql("subject")} AS s, {norm_sql("predicate")} AS p, {norm_sql("object")} AS o FROM gold)"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders")


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    for t in TABLES:
        sql = sql.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ").replace(f"FROM {t}\n", f"FROM {{{t}}}\n")
    return spark.sql(sql, **{t: df for t, df in names.items() if f"{{{t}}}" in sql})


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, PRED_SQL)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, GOLD_SQL)


def alignment(spark: SparkSession) -> DataFrame:
    return spark.sql(ALIGN_SQL)
