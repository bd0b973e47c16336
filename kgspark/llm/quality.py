"""Quality rules with thresholds learnt from quantile sketches, in DataFrame functions only.

Every text is measured in its own row. Fixed rules (``base_failed``) reject short and
repetitive texts. The others meet adaptive fences: for each metric (a ratio in
thousandths) the rows of a language and source that pass the fixed rules form a
sketch, a histogram whose buckets are exact up to 63 and 1/32 wide above. Such
sketches merge by adding counts, so those of sources make those of languages and of
all, and a group of fewer than ``min_group`` rows is judged by the next wider one.
A row is rejected where a metric exceeds Q3 + 3 * max(Q3 - Q1, least spread).

Defined results: a null text counts as empty (no words, base_failed); null and empty
language or source are one group; repeated rows are judged alike, each on its own.
Sketches are aggregated before they are shuffled, so a hot source costs a few
rows a task; thresholds are joined back by key and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Metric: least spread that counts, in thousandths.
METRICS = {"sym": 40, "dup": 150, "rep": 100}
MIN_GROUP = 100
SPACE = r"[\x20\x09-\x0D]+"
OWN = "__kgspark_"


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts of each text as columns ``__kgspark_<name>``."""

    def c(name: str) -> Column:
        return F.col(OWN + name)

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    out = df.withColumn(OWN + "w", F.array_remove(F.split(text, SPACE), ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn(OWN + "lines", lines).withColumn(OWN + "n_words", F.size(c("w")).cast("bigint"))
    grams = F.transform(
        F.slice(c("w"), F.lit(1), F.greatest(F.size(c("w")) - 2, F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, F.get(c("w"), i + 1), F.get(c("w"), i + 2)).alias("h"), i.alias("i")),
    )
    out = out.withColumn(OWN + "s", F.sort_array(grams))

    def near(x: Column, k: Column) -> Column:
        return F.coalesce(x.h == F.get(c("s"), k - 1).h, F.lit(False)) | F.coalesce(x.h == F.get(c("s"), k + 1).h, F.lit(False))

    out = out.withColumn(OWN + "at", F.sort_array(F.transform(F.filter(c("s"), near), lambda x: x.i)))
    covered = F.transform(c("at"), lambda x, k: F.coalesce(F.least(F.lit(3), x - F.get(c("at"), k - 1)), F.lit(3)))
    return out.withColumns(
        {
            OWN + "word_chars": F.length(F.array_join(c("w"), "")).cast("bigint"),
            OWN + "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint"),
            OWN + "n_lines": F.size(c("lines")).cast("bigint"),
            OWN + "n_dup_lines": (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("bigint"),
            OWN + "n_repeat_words": F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("bigint"),
        }
    ).drop(*(OWN + x for x in ("w", "s", "at", "lines")))


def _measured(df: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    def c(name: str) -> Column:
        return F.col(OWN + name)

    n = F.greatest(c("n_words"), F.lit(1))
    out = measures(df, text_col).withColumns(
        {
            OWN + "base_failed": (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words")),
            OWN + "lang": F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")),
            OWN + "source": F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")),
        }
    )
    ratio = {"sym": (c("n_symbols"), n), "dup": (c("n_dup_lines"), F.greatest(c("n_lines"), F.lit(1))), "rep": (c("n_repeat_words"), n)}
    return out.withColumns({OWN + k: F.floor(1000 * a / b).cast("bigint") for k, (a, b) in ratio.items()})


def bucket(value: Column) -> Column:
    """The sketch bucket of a whole number >= 0: its six leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def fences(measured: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, one fence a metric) of every group of the measured rows."""
    passed = measured.where(~F.col(OWN + "base_failed"))
    stacked = passed.select(
        F.col(OWN + "lang").alias("lang"), F.col(OWN + "source").alias("source"),
        F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bucket(F.col(OWN + m)).alias("bucket")) for m in METRICS))).alias("x"),
    )
    sketch = stacked.groupBy("lang", "source", "x.metric", "x.bucket").count()
    none = F.lit("")
    # Merged sketches of every level in one pass over these few rows.
    wide = sketch.select(
        "metric", "bucket", "count",
        F.explode(F.array(*(F.struct(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source")) for k, (lang, source) in enumerate(((F.col("lang"), F.col("source")), (F.col("lang"), none), (none, none)))))).alias("g"),
    )
    merged = wide.groupBy("g", "metric", "bucket").agg(F.sum("count").alias("n"))
    counts = merged.groupBy("g", "metric").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b"))

    def quantile(quarter: int) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("bigint").alias("at"))
        step = lambda a, x: F.struct((a["sum"] + x.n).alias("sum"), F.when(a["at"].isNull() & (4 * (a["sum"] + x.n) >= quarter * F.col("total")), x.bucket).otherwise(a["at"]).alias("at"))
        return F.aggregate(F.col("b"), start, step, lambda a: a["at"])

    q = counts.withColumns({"q1": quantile(1), "q3": quantile(3)})
    spread = F.create_map(*(F.lit(x) for kv in METRICS.items() for x in kv))
    one = q.withColumn("fence", F.col("q3") + 3 * F.greatest(F.col("q3") - F.col("q1"), spread[F.col("metric")])).groupBy("g").agg(
        F.max("total").alias("total"), *(F.max(F.when(F.col("metric") == m, F.col("fence"))).alias(m) for m in METRICS)
    )
    flat = one.select("g.level", "g.lang", "g.source", "total", *METRICS)
    by_lang = flat.where("level = 1").select("lang", F.struct("total", *METRICS).alias("l"))
    overall = flat.where("level = 2").select(F.struct("total", *METRICS).alias("o"))
    joined = flat.where("level = 0").join(by_lang, "lang").join(F.broadcast(overall))  # one row
    pick = lambda m: F.when(F.col("total") >= min_group, F.col(m)).when(F.col("l.total") >= min_group, F.col(f"l.{m}")).otherwise(F.col(f"o.{m}"))
    return joined.select("lang", "source", *(pick(m).alias("fence_" + m) for m in METRICS))


def judge(measured: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Add ``__kgspark_kept`` to materialised measured rows."""
    limits = fences(measured, min_group)
    limits = limits.select(F.col("lang").alias(OWN + "lang"), F.col("source").alias(OWN + "source"), *(F.col("fence_" + m).alias(OWN + "fence_" + m) for m in METRICS))
    within = F.lit(True)
    for m in METRICS:
        within = within & (F.col(OWN + m) <= F.col(OWN + "fence_" + m))
    return measured.join(limits, [OWN + "lang", OWN + "source"], "left").withColumn(OWN + "kept", ~F.col(OWN + "base_failed") & F.coalesce(within, F.lit(False)))


def quality_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """One row per input row: the counts, base_failed and kept."""
    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    measured = materialize(_measured(slim, "text", "lang", "source").drop("text", "lang", "source"), "quality")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(measured, min_group).select("doc_id", *(F.col(OWN + x).alias(x) for x in names))


def quality_filter(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """The kept rows with their own columns; texts are written once beside their measures."""
    measured = materialize(_measured(df, text_col, lang_col, source_col), "quality")
    return judge(measured, min_group).where(F.col(OWN + "kept")).select(*df.columns)


_VALUE = {"sym": "1000 * n_symbols // greatest(n_words, 1)", "dup": "1000 * n_dup_lines // greatest(n_lines, 1)", "rep": "1000 * n_repeat_words // greatest(n_words, 1)"}

ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), w AS (
  SELECT r, doc_id, lang, source, text, regexp_extract_all(text, '[^ \\t-\\r]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines FROM d
), gram AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM gram) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), m AS (
  SELECT w.r, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered ON covered.r = w.r
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"{x} AS {k}" for k, x in _VALUE.items())} FROM m
), sketch AS (
  SELECT lang, source, metric, (value >> greatest(length(bin(value)) - 6, 0)) << greatest(length(bin(value)) - 6, 0) AS bucket, count(*) AS n
  FROM (UNPIVOT (SELECT lang, source, sym, dup, rep FROM v WHERE NOT base_failed) ON sym, dup, rep INTO NAME metric VALUE value) GROUP BY ALL
), levels AS (
  SELECT level, if(level < 2, lang, '') AS lang, if(level < 1, source, '') AS source, metric, bucket, sum(n) AS n
  FROM sketch, (SELECT unnest([0, 1, 2]) AS level) GROUP BY ALL
), run AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM levels
), q AS (
  SELECT level, lang, source, metric, max(total) AS total, min(bucket) FILTER (WHERE 4 * upto >= total) AS q1, min(bucket) FILTER (WHERE 4 * upto >= 3 * total) AS q3 FROM run GROUP BY ALL
), f AS (
  SELECT *, q3 + 3 * greatest(q3 - q1, CASE metric {" ".join(f"WHEN '{k}' THEN {x}" for k, x in METRICS.items())} END) AS fence FROM q
), pick AS (
  SELECT a.lang, a.source, a.metric, CASE WHEN a.total >= {MIN_GROUP} THEN a.fence WHEN b.total >= {MIN_GROUP} THEN b.fence ELSE c.fence END AS fence
  FROM f a JOIN f b ON b.level = 1 AND b.lang = a.lang AND b.metric = a.metric JOIN f c ON c.level = 2 AND c.metric = a.metric WHERE a.level = 0
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({" AND ".join(f"{k} <= (SELECT fence FROM pick WHERE pick.lang = v.lang AND pick.source = v.source AND metric = '{k}')" for k in METRICS)}, false) AS kept
FROM v
"""
