"""Page layout on tables of words and cells: boxes, bands, lines, sentence islands, sections, header names."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def words_in_boxes(words: DataFrame, boxes: DataFrame, margin: float = 1.0, page: str = "page") -> DataFrame:
    """Words whose centre lies in a box of their page: an equi join on the page with a range residual."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    b = boxes.select(page, "box_id", *(F.col(c).alias("b_" + c) for c in ("x0", "top", "x1", "bottom")))
    inside = (x >= F.col("b_x0") - margin) & (x <= F.col("b_x1") + margin) & (y >= F.col("b_top") - margin) & (y <= F.col("b_bottom") + margin)
    return words.join(b, page).where(inside).drop("b_x0", "b_top", "b_x1", "b_bottom")


def separators(lines: DataFrame, page_width: str = "width") -> DataFrame:
    return lines.where((F.col("x1") - F.col("x0") >= 0.6 * F.col(page_width)) & (F.col("bottom") - F.col("top") <= 3))


def bands(cuts: DataFrame, pages: DataFrame, page: str = "page", at: str = "top", height: str = "height", least: float = 5) -> DataFrame:
    """(page, band_top, band_bottom) between separators, 0 and the page's height; thin ones are left out."""
    bounds = cuts.select(page, F.col(at).cast("double").alias("y")).union(pages.select(page, F.lit(0.0))).union(pages.select(page, F.col(height).cast("double")))
    out = bounds.withColumn("band_bottom", F.lead("y").over(W.partitionBy(page).orderBy("y")))
    return out.where(F.col("band_bottom") - F.col("y") > least).select(page, F.col("y").alias("band_top"), "band_bottom")


def fill_down(df: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """Empty cells take the value above within their table."""
    up = F.last(F.nullif(F.col(column), F.lit("")), ignorenulls=True).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(column, F.coalesce(up, F.col(column)))


def islands(df: DataFrame, group: str, order: str, ends: Column) -> DataFrame:
    """Add island: a new one begins after each row where ``ends`` holds."""
    before = F.sum(ends.cast("int")).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("island", F.coalesce(before, F.lit(0)))


def merge_islands(df: DataFrame, group: str, order: str, text: str, ends: Column, sep: str = " ") -> DataFrame:
    """(group, island, text): lines joined until one ends a sentence."""
    rows = islands(df, group, order, ends).groupBy(group, "island").agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("l"))
    return rows.select(group, "island", F.array_join(F.transform("l", lambda x: x[text]), sep).alias("merged"))


def section_islands(df: DataFrame, group: str, order: str, title: str) -> DataFrame:
    """Add section: titled rows start one, untitled rows continue it."""
    starts = F.sum(F.col(title).isNotNull().cast("int")).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("section", starts)


def _starts_line(top: float, anchor: float | None, tolerance: float) -> bool:
    return anchor is None or abs(top - anchor) > tolerance


def line_groups(tops: list[float], tolerance: float = 3) -> list[int]:
    """Line numbers of words sorted by top: a word further than ``tolerance`` from its line's first word starts another."""
    out, line, anchor = [], -1, None
    for top in tops:
        if _starts_line(top, anchor, tolerance):
            line, anchor = line + 1, top
        out.append(line)
    return out


def text_lines(words: DataFrame, page: str = "page", tolerance: float = 3) -> DataFrame:
    """(page, line, text) of words grouped by height, read in order, so that a line at a time is held; words of one place go by text."""
    known = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c)
    rows = words.select(F.col(page).cast("bigint").alias(page), known("top"), known("x0"), "text").repartition(page)
    ordered = rows.sortWithinPartitions(page, F.rint(F.col("top") * 10), "x0", "text")  # tops to one digit

    def run(batches):
        made: list[tuple] = []
        held: list[tuple] = []
        at: tuple | None = None  # page, line, top of its first word

        def close():
            held.sort(key=lambda w: (w[0] != w[0], w[0]))
            made.append((at[0], at[1], " ".join([w[1] for w in held])))
            held.clear()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in made], pa.int64()), pa.array([r[1] for r in made], pa.int32()), pa.array([r[2] for r in made], pa.string())], [page, "line", "text"])
            made.clear()
            return out

        for batch in batches:
            for p, top, x0, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None or p != at[0]:
                    if at is not None:
                        close()
                    at = p, 0, top
                elif _starts_line(top, at[2], tolerance):
                    close()
                    at = p, at[1] + 1, top
                held.append((x0, text))
            yield rows()
        if at is not None:
            close()
            yield rows()

    return ordered.mapInArrow(run, f"{page} bigint, line int, text string")


def inline_anchors(lines: DataFrame, anchors: DataFrame, page: str = "page") -> DataFrame:
    """(page, band, seq, kind, text): anchors of tables among the text lines of their page and band by height, an anchor before a line of its height.

    lines has page, band, top, text; anchors page, band, top, anchor.
    """
    both = lines.select(page, "band", "top", F.lit("line").alias("kind"), "text").unionByName(anchors.select(page, "band", "top", F.lit("anchor").alias("kind"), F.col("anchor").alias("text")))
    order = W.partitionBy(page, "band").orderBy("top", "kind", "text")
    return both.select(page, "band", (F.row_number().over(order) - 1).alias("seq"), "kind", "text")


def words_outside(words: DataFrame, boxes: DataFrame, key: str, page: str = "page") -> DataFrame:
    """Words in no box of their page."""
    return words.join(words_in_boxes(words, boxes, page=page).select(key).distinct(), key, "left_anti")


def kept_separators(tops: list[float], gap: float = 5) -> list[float]:
    out: list[float] = []
    for top in sorted(tops):
        if not out or top - out[-1] > gap:
            out.append(top)
    return out


def unique_headers(names: list[str]) -> list[str]:
    """Repeated names get _2, _3, ...: the first that no name before has taken."""
    out: list[str] = []
    taken: set[str] = set()
    for name in names:
        free = name
        number = 2
        while free in taken:
            free = f"{name}_{number}"
            number += 1
        taken.add(free)
        out.append(free)
    return out


unique_headers_udf = F.pandas_udf(lambda s: s.map(lambda x: unique_headers(list(x))), T.ArrayType(T.StringType()))
kept_separators_udf = F.pandas_udf(lambda s: s.map(lambda x: kept_separators(list(x))), T.ArrayType(T.DoubleType()))


def pad_row(cells: Column, width: Column) -> Column:
    """Exactly ``width`` cells: cut, or filled with empty ones."""
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), F.lit(1), width)


def table_block(rows: Column) -> Column:
    """A JSON block, one object a line, without keys that start with an underscore."""
    clean = F.transform(rows, lambda m: F.to_json(F.map_filter(m, lambda k, v: ~k.startswith("_"))))
    return F.concat(F.lit("[\n"), F.array_join(clean, ",\n"), F.lit("\n]"))
