"""Shared helpers: tables, scratch folders on shared storage, Arrow text access."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


scratch_root = shared_folder


_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(paths: list[str]):
    """Within it, the paths of tables that ``materialize`` writes are added to ``paths``."""
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.pop()


def release(spark: SparkSession, paths: list[str], docs: DataFrame) -> None:
    """Delete the scratch tables at ``paths``, unless ``docs`` still reads from the scratch folder."""
    ours = {p.rpartition("/")[2] for p in paths}
    if paths and not any(f.partition("/kgspark/")[2].partition("/")[0] in ours for f in docs.inputFiles()):
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        paths.clear()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/kgspark/{uuid.uuid4().hex}-{tag}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory of this worker to the system: workers are reused, and their heaps would only grow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def mapper(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives memory back when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def given(f: Callable[..., pa.Table], *args: object) -> pa.Table:
    """f(*args) for a group, after which memory is given back."""
    try:
        return f(*args)
    finally:
        give_back()


def total_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a text column (one column-pruned aggregate, no shuffle of text)."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()[0]


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying each value; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # several chunks that could not be combined
            column = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks])
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        wide = pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string()
        column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_chunks(offsets: np.ndarray, most: int = 1 << 18):
    """Document ranges [i, j) of at most ``most`` bytes each; a longer document stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def binary_column(items: list[bytes]) -> pa.Array:
    return pa.array(items, pa.binary())
