"""Places in a total order over a whole table; joins with a vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import checkpointed


#: A written vocabulary is sent to all tasks up to so many rows.
BROADCAST_ROWS = 500_000
SALTS = 64


def are_few(rows: DataFrame) -> bool:
    """Whether a table may be sent to all tasks. Its rows are counted so far, so it should be written already or cheap."""
    return rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def few_rows(written: DataFrame) -> DataFrame:
    """The rows, marked for broadcast if they are few."""
    return F.broadcast(written) if are_few(written) else written


def join_vocabulary(rows: DataFrame, vocabulary: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Rows joined with a vocabulary by its column, of which a few values may hold most rows.

    The rows stay where they are if the vocabulary is small. Else it is copied to SALTS
    places a value, over which the rows of the value are dealt.
    """
    written = checkpointed(vocabulary)
    if are_few(written):
        return rows.join(F.broadcast(written), on, how)
    copies = written.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(copies, [on, "_salt"], how).drop("_salt")


def global_index(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in the order given. Ties are numbered in any order.

    Rows are dealt to ranges of the order and numbered within them; the sizes of the
    ranges, one row each, give the offsets. No task sees more than its range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = checkpointed(ranged.withColumns({"_range": F.spark_partition_id(), "_place": low}))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_before"))  # a row a range
    return placed.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")
