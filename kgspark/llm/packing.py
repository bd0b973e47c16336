"""Best-fit packing of tokenised documents with certified bin counts.

1. A map-only pass tokenises whole texts and cuts those longer than a sequence
   into full pieces and a rest. Its rows (a few numbers each) are written once.
2. Full pieces fill a sequence alone. The others are dealt at random to
   partitions of about ``GROUP_ITEMS`` and packed there by best-fit decreasing.
3. Dual-feasible functions bound from below how many bins each partition's
   lengths need. A partition at its bound gives up only its emptiest bin, one
   with a gap gives up that many more; the contents of what was given up meet in
   partitions of the next, sixteen times coarser round, and are packed again.
   A bin once kept is final, so rounds work on ever fewer pieces.

Every input row is packed; repeated ids are separate documents of one id. Null
texts count as empty and are the closing id alone.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from struct import pack

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import PartCoder
from .common import given, mapper, materialize, text_buffers

CAPACITY = 4096
GROUP_ITEMS = 16_384
FAN_IN = 16
#: Words of up to so many characters are tokenised so many at once.
SHORT, TOGETHER = 64, 128


class WordTokenizer:
    """Ids of a tokenizer file whose pieces never contain white space and which has ids for every piece."""

    def __init__(self, path: str):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.parts = PartCoder(self._parts, strip=True)

    def _parts(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each part. Short runs of letters are tokenised many at once, with blanks between them."""
        texts = list(map(bytes.decode, parts))
        words, rest = [], []
        for k, text in enumerate(texts):
            (words if text.isalpha() and len(text) <= SHORT else rest).append(k)
        out = [b""] * len(parts)
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            found = self.tokenizer.encode(" ".join([texts[k] for k in some]), add_special_tokens=False)
            of = found.word_ids  # ascending, from 0
            if not of or of[-1] != len(some) - 1:  # letters that normalise to several pieces
                rest += some
                continue
            ids, edges = pack(f"<{len(of)}I", *found.ids), (4 * np.searchsorted(of, np.arange(len(some) + 1))).tolist()
            for k, a, b in zip(some, edges[:-1], edges[1:], strict=True):
                out[k] = ids[a:b]
        for k in rest:
            ids = self.tokenizer.encode(texts[k], add_special_tokens=False).ids
            out[k] = pack(f"<{len(ids)}I", *ids)
        return out

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        return next(self.parts.documents(data, np.array([0, len(data)]))).tolist()


_OPEN: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _OPEN:
        _OPEN[path] = WordTokenizer(path)
    return _OPEN[path]


def pieces(df: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""

    def run(batches):
        coder, end = word_tokenizer(path), end_id.to_bytes(4, "little")
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for doc, found in zip(ids, coder.parts.documents(*text_buffers(batch.column(1))), strict=True):
                data = found.astype("<u4").tobytes() + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(mapper(run), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: longest first into the fullest bin with room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []  # rooms that some bin has, ascending
    having: dict[int, list[int]] = {}
    made = 0
    for i in order.tolist():
        need = int(lengths[i])
        at = bisect_left(room, need)
        if at == len(room):
            left, where, made = capacity, made, made + 1
        else:
            left = room[at]
            stack = having[left]
            where = stack.pop()
            if not stack:
                del having[left], room[at]
        bins[i], offsets[i] = where, capacity - left
        left -= need
        if left:
            if left not in having:
                insort(room, left)
                having[left] = []
            having[left].append(where)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: the best of dual-feasible functions over thresholds.

    For a threshold t <= capacity/2 lengths over capacity - t count as whole bins and
    those under t as nothing; a second family rounds lengths down to multiples of
    1/(k+1) where that stays feasible.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    # u_t: sum over [t, capacity - t] + capacity * #(> capacity - t)
    total, number = np.cumsum(count * size), np.cumsum(count)
    t = np.arange(1, capacity // 2 + 1)
    value = (total[capacity - t] - total[t - 1]) + capacity * (number[-1] - number[capacity - t])
    best = max(best, int(-(-value.max() // capacity)))
    for k in range(1, 33):  # f_k(x): x if (k+1)x/C is whole, else floor((k+1)x/C)/k
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        value = np.where(whole, size * k, (scaled // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def _pack_group(table: pa.Table, last: bool, capacity: int) -> pa.Table:
    lengths = table.column("length").to_numpy()
    bins, offsets = best_fit_decreasing(lengths, capacity)
    used = int(bins.max()) + 1 if len(bins) else 0
    again = np.zeros(len(lengths), bool)
    if not last and used:
        gap = used - lower_bound(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=used)
        give = min(used, 1 + 8 * gap)
        again = np.isin(bins, np.argsort(fill, kind="stable")[:give])
    return table.append_column("bin", pa.array(bins)).append_column("offset", pa.array(offsets)).append_column("again", pa.array(again))


def _packer(last: bool, capacity: int):
    def run(table: pa.Table) -> pa.Table:
        return given(_pack_group, table, last, capacity)

    return run


def pack_pieces(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to materialised pieces with a column ``row`` that tells them apart; rounds are written as they end."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, grp bigint, bin bigint, offset bigint, again boolean"
    full = items.where(F.col("length") == capacity).select(*columns, (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = items.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_items))
    rest = rest.select(*columns, F.pmod(F.xxhash64("row"), F.lit(groups)).alias("grp"))  # by row: equal rows are dealt as well
    done, round_no = full, 0
    while True:
        last = groups == 1

        packed = materialize(rest.groupBy("grp").applyInArrow(_packer(last, capacity), schema), f"round{round_no}")
        kept = packed.where(~F.col("again")).select(*columns, (F.lit(round_no << 56) + F.col("grp") * (1 << 28) + F.col("bin")).alias("sequence_id"), "offset")
        done = done.unionByName(kept)
        if last:
            return done
        groups, round_no = -(-groups // FAN_IN), round_no + 1
        rest = packed.where("again").select(*columns, F.floor(F.col("grp") / FAN_IN).cast("bigint").alias("grp"))


def pack_documents(df: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row a piece."""
    return pack_pieces(materialize(pieces(df, path, end_id, capacity, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces"), capacity)
