"""Trigram language model in a log-frequency Bloom filter.

Training counts of words, word pairs and triples become levels 1 + floor(log2 count).
For each level up to its own an n-gram is entered into a Bloom filter; a count is read
back by probing levels 1, 2, ... until one is missing, so an n-gram is never
under-counted and over-counted only by false positives. A text's words are followed by
one end token, which also stands before the first word. Probabilities are smoothed:

    P(w)       = (c(w) + 1) / (N + V + 1)
    P(w | v)   = (c(v w) + A * P(w)) / (c(v) + A)
    P(w | u v) = (c(u v w) + B * P(w | v)) / (c(u v) + B)

with counts read from the filter and no count above its context's. A and B are learnt:
the weight that all contexts together give to the lower order is what Good and Turing
give to the unseen, the share of n-grams that occur once.

The filter is built in segments, one a bucket of n-gram hashes, each in its own task.
No n-gram is left out. Up to ``FILTER_BITS`` at 16 bits a byte of text the segments are
broadcast; ordinary text needs less, and a text that needs more only raises false
positives. A larger corpus is kept as stretches of token lists: each asks
the buckets for its distinct n-grams, a bucket counts them, enters all in a segment of the
size that they need and tells each stretch the levels that it reads there, so nothing
is broadcast and false positives stay at 2.4 % or less.

The add-one unigram score ("base") uses exact counts: the buckets tell those of words, or,
with a broadcast filter, the ``HEAD`` most frequent words are broadcast and all others
joined by hash.

Words are told apart by 64-bit hashes, pairs and triples of a bucket by 40 bits, far
below the filter's own errors. Null texts count as empty (the end token alone); a null
id counts as the empty string when rows are held out. Every row of the input gives a
row, and rows are told apart even where ids repeat.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import LOWER, NOT_SPACE, mix, spans_hash, word_spans
from .common import doc_chunks, given, mapper, materialize, text_buffers, total_bytes

FILTER_BITS = 1 << 29
BITS_AN_ENTRY = 8
PROBES = 4
HEAD = 1 << 18
HELD_OUT, FOLDS = 2, 7
BUCKET_BYTES = 1 << 23
FLUSH_BYTES = 1 << 22
END = np.uint64(0x51_7C_C1_B7_27_22_0A_95)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_TRIPLE = np.uint64(0xFF51AFD7ED558CCD)
_LEVEL = 0x9FB21C651E98DF25
_KEY_BITS = 40


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all documents' words and end tokens in order, each document's first index and the total)."""
    low = LOWER[data]
    starts, ends, docs = word_spans(low, offsets, NOT_SPACE)
    words = spans_hash(low, starts, ends)
    n = len(offsets) - 1
    counts = np.bincount(docs, minlength=n)
    edge = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(edge[-1], END, np.uint64)
    out[np.arange(len(words)) + docs] = words
    return out, edge


def ngrams(words: np.ndarray, edge: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, triple) that ends at each token, as hashes cut to the bucket's and ``_KEY_BITS`` bits."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[edge[:-1]] = END
    duo = mix(before * _PAIR + words)
    first = np.empty_like(words)
    first[1:] = duo[:-1]
    first[edge[:-1]] = END
    shift = np.uint64(65 - buckets.bit_length() - _KEY_BITS)
    return duo >> shift << shift, mix(first * _TRIPLE + words) >> shift << shift


def _packed(keys: np.ndarray, buckets: int) -> bytes:
    """The ``_KEY_BITS`` bits below the bucket's, five bytes a key."""
    low = (keys >> np.uint64(65 - buckets.bit_length() - _KEY_BITS)) & np.uint64((1 << _KEY_BITS) - 1)
    return low.view(np.uint8).reshape(-1, 8)[:, : _KEY_BITS // 8].tobytes()


def _unpacked(data: bytes, bucket: int, buckets: int) -> np.ndarray:
    wide = np.zeros((len(data) * 8 // _KEY_BITS, 8), np.uint8)
    wide[:, : _KEY_BITS // 8] = np.frombuffer(data, np.uint8).reshape(-1, _KEY_BITS // 8)
    bits = buckets.bit_length() - 1
    return (wide.view(np.uint64).ravel() | np.uint64(bucket << _KEY_BITS)) << np.uint64(64 - bits - _KEY_BITS)


def _sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def filter_bits(size: int) -> int:
    """Bits of the filter for so many bytes of text, a power of two."""
    return min(FILTER_BITS, 1 << max(20, (16 * size).bit_length()))


def buckets_for(size: int) -> int:
    """A power of two of buckets, so that each counts about ``BUCKET_BYTES`` of text."""
    n = 8
    while n * BUCKET_BYTES < size and n < filter_bits(size) >> 9:
        n *= 2
    return n


def places(keys: np.ndarray, level: int, buckets: int, size: int) -> np.ndarray:
    """Bit positions within the whole filter of ``size`` bits, PROBES a key; a key's bits all lie in its bucket's segment."""
    bits = np.uint64(size // buckets - 1)
    h = mix(keys + np.uint64(level * _LEVEL & (1 << 64) - 1))
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    base = bucket_of(keys, buckets).astype(np.uint64) * (bits + np.uint64(1))
    return base[:, None] + ((a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) & bits)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]  # 1 + floor(log2 c)


def kept(counts: list[np.ndarray], room: int) -> list[np.ndarray]:
    """Which n-grams of each order a filter of a fixed size would hold (the model's holds all): all if there is room, else those of the lowest counts are left out, high orders first."""
    t = 1
    while True:
        for least in ((1 if t < 16 else t - 15, t, t), (1 if t < 16 else t - 15, t, t + 1)):
            some = [c >= k for c, k in zip(counts, least, strict=True)]
            if sum(int(levels(c[x]).sum()) for c, x in zip(counts, some, strict=True)) <= room:
                return some
        t += 1


def segment(keys: np.ndarray, counts: np.ndarray, bucket: int, buckets: int, whole: int) -> bytes:
    size = whole // buckets
    bits = np.zeros(size, bool)
    top = levels(counts)
    for level in range(1, int(top.max(initial=0)) + 1):
        bits[(places(keys[top >= level], level, buckets, whole) - np.uint64(bucket * size)).ravel().astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def read_counts(bits: np.ndarray, keys: np.ndarray, buckets: int, top: int) -> np.ndarray:
    """Counts as their level's middle (1, 3, 6, 12, ...; 0 if absent), by repeated membership probes up to level ``top``."""
    level, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
    for k in range(1, top + 1):
        at = places(keys[left], k, buckets, 8 * len(bits))
        for probe in range(PROBES):  # most absent keys leave at the first probe
            hit = (bits[(at[:, probe] >> np.uint64(3)).astype(np.int64)] >> (at[:, probe] & np.uint64(7)).astype(np.uint8)) & 1 == 1
            left, at = left[hit], at[hit]
        if not len(left):
            break
        level[left] = k
    return np.where(level > 1, 1.5 * np.exp2(level - 1.0), level.astype(np.float64))


_ORDERS = ("word", "pair", "triple")
_PART = "bucket int, " + ", ".join(f"{o}s binary, {o}_counts binary" for o in _ORDERS)
_PART_NAMES = ["bucket", *(n for o in _ORDERS for n in (o + "s", o + "_counts"))]
#: Levels of counts that 64-bit numbers can have.
_LEVELS = 64


def _count(buckets: int):
    """Map side: counts of a stretch of training text, a row a bucket."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in _PART_NAMES]
        parts = []
        for order in range(3):
            keys, counts = np.unique(np.concatenate([h[order] for h in held]), return_counts=True)
            parts.append((keys, counts.astype(np.uint32), np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))))
        for b in np.flatnonzero(sum(np.diff(p[2]) for p in parts)).tolist():
            cols[0].append(b)
            for i, (keys, counts, cut) in enumerate(parts):
                some = keys[cut[b] : cut[b + 1]]
                cols[1 + 2 * i].append(_packed(some, buckets) if i else some.tobytes())
                cols[2 + 2 * i].append(counts[cut[b] : cut[b + 1]].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int32(), *[pa.binary()] * 6], strict=True)], names=_PART_NAMES)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            train = pa.array([not held_out(x) for x in batch.column(0).to_pylist()], pa.bool_())
            data, offsets = text_buffers(batch.column(1).filter(train))
            for i, j in doc_chunks(offsets, 1 << 18):
                words, edge = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held.append((words, *ngrams(words, edge, buckets)))
                size += int(offsets[j] - offsets[i])
                if size >= FLUSH_BYTES:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _merge(buckets: int, whole: int):
    """Reduce side: exact word counts of a bucket, its segment of the filter, and how often its n-grams occur."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, counts = [], []
        for i, order in enumerate(_ORDERS):
            parts = [_unpacked(x.as_py(), bucket, buckets) if i else np.frombuffer(x.as_py(), np.uint64) for x in table.column(order + "s")]
            times = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column(order + "_counts")]).astype(np.int64)
            k, c = _sum_by_key(np.concatenate(parts), times)
            keys.append(k)
            counts.append(c)
        part = segment(np.concatenate(keys), np.concatenate(counts), bucket, buckets, whole)
        often = np.stack([np.bincount(levels(c), weights=w, minlength=_LEVELS + 1) for c in counts for w in (np.ones(len(c)), c)])
        n = len(keys[0])
        zero = np.zeros(1, np.int64)
        return pa.table({
            "bucket": pa.array([bucket] * (n + 1), pa.int32()), "segment": pa.array([part] + [None] * n, pa.binary()), "often": pa.array([often.tobytes()] + [None] * n, pa.binary()),
            "word": pa.array(np.concatenate([zero, keys[0].view(np.int64)])), "n": pa.array(np.concatenate([zero, counts[0]])),
        })

    return run


def learn_weight(number: np.ndarray, total: np.ndarray, singles: float) -> float:
    """The A for which contexts (``number`` of them, ``total`` occurrences, by level) give the lower order the weight of ``singles`` tokens."""
    some = number > 0
    mean, total = total[some] / number[some], total[some]
    low, high = 1e-3, 1e7
    for _ in range(60):
        middle = (low * high) ** 0.5
        low, high = (middle, high) if (total * middle / (mean + middle)).sum() < singles else (low, middle)
    return low


class Model:
    """A trained model: totals and frequent words on the driver, exact word counts as a table."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        spark = df.sparkSession
        docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        text_bytes = total_bytes(docs)
        self.docs, self.buckets, whole = docs, buckets_for(text_bytes), filter_bits(text_bytes)
        self.spread = 16 * text_bytes >= FILTER_BITS  # the filter stays with its buckets, and n-grams go there
        if self.spread:
            return
        parts = docs.mapInArrow(mapper(_count(self.buckets)), _PART)
        merge = _merge(self.buckets, whole)
        merged = materialize(parts.groupBy("bucket").applyInArrow(lambda t: given(merge, t), "bucket int, segment binary, often binary, word bigint, n bigint"), "lm")
        self.words = merged.where("segment is null").select("word", "n")
        total = self.words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types")).first()
        bits = np.zeros(whole // 8, np.uint8)
        size = whole // 8 // self.buckets
        often = np.zeros((6, _LEVELS + 1))  # for each order, n-grams and their occurrences by level
        for row in merged.where("segment is not null").select("bucket", "segment", "often").toLocalIterator():  # FILTER_BITS in all
            bits[row.bucket * size : (row.bucket + 1) * size] = np.frombuffer(row.segment, np.uint8)
            often += np.frombuffer(row.often, np.float64).reshape(often.shape)
        self.top = int(np.flatnonzero(often[::2].sum(axis=0)).max(initial=0))
        self.learn(often, total.tokens, total.types)
        head = self.words.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
        keys, counts = head.column("word").to_numpy().view(np.uint64), head.column("n").to_numpy()
        order = np.argsort(keys)
        self.shared = spark.sparkContext.broadcast((bits, keys[order], counts[order]))

    def learn(self, often: np.ndarray, total: int, types: int) -> None:
        """often: for each order, n-grams and their occurrences by level."""
        self.tokens, self.types = total, types
        self.weights = (learn_weight(often[0], often[1], often[2, 1]), learn_weight(often[2], often[3], often[4, 1]))


def _probabilities(edge: np.ndarray, single: np.ndarray, ends: float, duo: np.ndarray, trio: np.ndarray, norm: float, weights: tuple[float, float]) -> np.ndarray:
    """Of each token, from the counts of it, and of the pair and the triple that end at it; ends: how often the end token occurs."""
    starts, inner = edge[:-1], np.ones(len(single), bool)
    inner[starts] = False
    seen, seen_duo = np.empty(len(single)), np.zeros(len(single))
    seen[1:], seen_duo[1:] = single[:-1], duo[:-1]
    seen[starts] = ends
    p = (single + 1.0) / norm
    p = (np.minimum(duo, seen) + weights[0] * p) / (seen + weights[0])
    return np.where(inner, (np.minimum(trio, seen_duo) + weights[1] * p) / (seen_duo + weights[1]), p)  # the first word has no pair before it


_STRETCH = "ids binary, nulls binary, flags binary, edge binary, kinds binary, places binary"
_ASKED = "stretch bigint, " + _PART
_TOLD = "stretch bigint, bucket int, words binary, pairs binary, triples binary, often binary, tokens bigint, types bigint"


def _stretches(batches):
    """Rows (doc_id, text, train, wanted) as token lists of about ``FLUSH_BYTES`` of text: each distinct word once, and the number of each token's word."""

    def row(held):
        words = np.concatenate([h[0] for h in held])
        kinds, places = np.unique(words, return_inverse=True)
        edge = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[1]) for h in held]))]).astype(np.int64)
        ids = pa.concat_arrays([h[2] for h in held])
        flags = np.concatenate([h[3] for h in held])
        small = places.astype(np.uint16 if len(kinds) <= 1 << 16 else np.uint32).tobytes()
        values = [ids.fill_null(0).to_numpy().tobytes(), np.asarray(ids.is_null()).tobytes(), flags.tobytes(), edge.tobytes(), kinds.tobytes(), pa.compress(small, codec="zstd", asbytes=True)]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=["ids", "nulls", "flags", "edge", "kinds", "places"])

    held, size = [], 0
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        flags = np.array([t + 2 * w for t, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], np.uint8)
        for i, j in doc_chunks(offsets, 1 << 18):
            held.append((*tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), batch.column(0).slice(i, j - i), flags[i:j]))
            size += int(offsets[j] - offsets[i]) + 8 * (j - i)
            if size >= FLUSH_BYTES:
                yield row(held)
                held, size = [], 0
    if held:
        yield row(held)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words ascending, number of each token's word, first token of each document, flags) of a stretch."""
    kinds, edge = np.frombuffer(row["kinds"], np.uint64), np.frombuffer(row["edge"], np.int64)
    kind = np.uint16 if len(kinds) <= 1 << 16 else np.uint32
    places = np.frombuffer(pa.decompress(row["places"], decompressed_size=int(edge[-1]) * np.dtype(kind).itemsize, codec="zstd"), kind)
    return kinds, places, edge, np.frombuffer(row["flags"], np.uint8)


def _gaps(keys: np.ndarray, buckets: int) -> bytes:
    """Ascending keys of a bucket in four bytes each where the gaps allow it, else five."""
    low = (keys >> np.uint64(65 - buckets.bit_length() - _KEY_BITS)) & np.uint64((1 << _KEY_BITS) - 1)
    gap = np.diff(low, prepend=np.uint64(0))
    return b"\4" + gap.astype(np.uint32).tobytes() if int(gap.max(initial=0)) < 1 << 32 else b"\5" + _packed(keys, buckets)


def _from_gaps(data: bytes, bucket: int, buckets: int) -> np.ndarray:
    if data[0] == 5:
        return _unpacked(data[1:], bucket, buckets)
    low = np.cumsum(np.frombuffer(data, np.uint32, offset=1).astype(np.uint64), dtype=np.uint64)
    return (low | np.uint64(bucket << _KEY_BITS)) << np.uint64(65 - buckets.bit_length() - _KEY_BITS)


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _loosened(data: bytes):
    return pa.decompress(data[4:], decompressed_size=int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)


def _ask(buckets: int):
    """A row a stretch and bucket: its distinct n-grams, and how often each occurs in training documents."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                kinds, places, edge, flags = _opened(row)
                words = kinds[places]
                train = np.repeat(flags & 1, np.diff(edge)).astype(np.float64)
                cols: list[list] = [[] for _ in range(6)]
                cuts = []
                for order, keys in enumerate((words, *ngrams(words, edge, buckets))):
                    keys, at = np.unique(keys, return_inverse=True)
                    counts = np.bincount(at, weights=train, minlength=len(keys)).astype(np.uint32)
                    cut = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
                    cuts.append((keys, counts, cut))
                some = np.flatnonzero(sum(np.diff(c[2]) for c in cuts)).tolist()
                for order, (keys, counts, cut) in enumerate(cuts):
                    for b in some:
                        mine = keys[cut[b] : cut[b + 1]]
                        cols[2 * order].append(_gaps(mine, buckets) if order else mine.tobytes())
                        cols[2 * order + 1].append(_squeezed(counts[cut[b] : cut[b + 1]].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([row["stretch"]] * len(some), pa.int64()), pa.array(some, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=["stretch", *_PART_NAMES])

    return run


def _tell(buckets: int):
    """A bucket's answer to each stretch: exact counts of words, levels of pairs and triples read from a filter with room for all, none left out."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        out: list[list] = []
        summed, often, whole = [], [], 0
        for i, order in enumerate(_ORDERS):
            parts = [_from_gaps(x, bucket, buckets) if i else np.frombuffer(x, np.uint64) for x in table.column(order + "s").to_pylist()]
            times = np.concatenate([np.frombuffer(_loosened(x), np.uint32) for x in table.column(order + "_counts").to_pylist()]).astype(np.int64)
            k, c = _sum_by_key(np.concatenate(parts), times)
            k, c = k[c > 0], c[c > 0]
            summed.append((k, c, parts))
            often += [np.bincount(levels(c), weights=w, minlength=_LEVELS + 1) for w in (np.ones(len(c)), c)]
            whole += int(levels(c).sum()) if i else 0
        size = 1 << max(10, (BITS_AN_ENTRY * whole).bit_length())
        keys, counts = (np.concatenate([s[j] for s in summed[1:]]) for j in (0, 1))
        bits = np.frombuffer(segment(keys, counts, 0, 1, size), np.uint8)
        top = int(levels(counts).max(initial=0))
        for i, (k, c, parts) in enumerate(summed):
            answers = []
            for asked in parts:
                if i:
                    answers.append(_squeezed(levels(read_counts(bits, asked, 1, top)).astype(np.uint8).tobytes()))
                else:
                    at = np.minimum(np.searchsorted(k, asked), max(len(k) - 1, 0))
                    answers.append(_squeezed((np.where(k[at] == asked, c[at], 0) if len(k) else np.zeros(len(asked), np.int64)).tobytes()))
            out.append([*answers, None])
        n = table.num_rows
        told = {"stretch": pa.array([*table.column("stretch").to_pylist(), None], pa.int64()), "bucket": pa.array([bucket] * (n + 1), pa.int32())}
        told |= {o + "s": pa.array(x, pa.binary()) for o, x in zip(_ORDERS, out, strict=True)}
        return pa.table(told | {
            "often": pa.array([None] * n + [np.stack(often).tobytes()], pa.binary()),
            "tokens": pa.array([None] * n + [int(summed[0][1].sum())], pa.int64()), "types": pa.array([None] * n + [len(summed[0][0])], pa.int64()),
        })

    return run


_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _scored(buckets: int, total: int, types: int, weights: tuple[float, float]):
    """Scores of a stretch's wanted documents from what all buckets told it."""

    def run(stretch: pa.Table, told: pa.Table) -> pa.Table:
        row = stretch.to_pylist()[0]
        kinds, places, edge, flags = _opened(row)
        told = told.sort_by("bucket")
        get = lambda name, kind: np.concatenate([np.frombuffer(_loosened(x), kind) for x in told.column(name).to_pylist()])
        middle = lambda level: np.where(level > 1, 1.5 * np.exp2(level - 1.0), level.astype(np.float64))
        exact = get("words", np.int64)
        words, norm = kinds[places], float(total + types + 1)
        duo, trio = (middle(get(n, np.uint8)[np.unique(k, return_inverse=True)[1]]) for n, k in zip(("pairs", "triples"), ngrams(words, edge, buckets), strict=True))
        single = middle(levels(exact))
        p = _probabilities(edge, single[places], single[np.searchsorted(kinds, END)], duo, trio, norm, weights)
        ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["nulls"], bool))
        out = pa.table({
            "doc_id": ids, "held_out": pa.array([held_out(x) for x in ids.to_pylist()], pa.bool_()), "n_tokens": np.diff(edge),
            "n_known": np.add.reduceat((exact > 0).astype(np.int64)[places], edge[:-1]), "train_tokens": np.full(len(ids), total, np.int64),
            "base_score": np.add.reduceat(np.log10((exact + 1.0) / norm)[places], edge[:-1]), "score": np.add.reduceat(np.log10(p), edge[:-1]),
        })
        return out.filter(pa.array(flags >= 2))

    return run


def _by_buckets(model: Model, docs: DataFrame | None) -> DataFrame:
    """Scores where the filter is too large to be sent to all: n-grams go to their buckets' segments and their counts come back.

    docs: rows (doc_id, text) to score, or None for the model's own.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) != HELD_OUT
    rows = model.docs.select("doc_id", "text", fold.alias("train"), F.lit(docs is None).alias("wanted"))
    if docs is not None:
        rows = rows.unionByName(docs.select("doc_id", "text", F.lit(False).alias("train"), F.lit(True).alias("wanted")))
    stretches = materialize(rows.mapInArrow(mapper(_stretches), _STRETCH).withColumn("stretch", F.monotonically_increasing_id()), "lm-stretches")
    asked = stretches.mapInArrow(mapper(_ask(model.buckets)), _ASKED)
    tell = _tell(model.buckets)
    told = materialize(asked.groupBy("bucket").applyInArrow(lambda t: given(tell, t), _TOLD), "lm-told")
    often, total, types = np.zeros((6, _LEVELS + 1)), 0, 0
    for row in told.where("stretch is null").select("often", "tokens", "types").toLocalIterator():
        often += np.frombuffer(row.often, np.float64).reshape(often.shape)
        total, types = total + row.tokens, types + row.types
    model.learn(often, total, types)
    score = _scored(model.buckets, total, types, model.weights)
    answers = told.where("stretch is not null").select("stretch", "bucket", "words", "pairs", "triples")
    return stretches.groupBy("stretch").cogroup(answers.groupBy("stretch")).applyInArrow(lambda a, b: given(score, a, b), _SCORED)


def score_documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and model scores of each row's whole text."""
    if model.spread:
        return _by_buckets(model, df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    shared, buckets, total, types, top, (a_weight, b_weight) = model.shared, model.buckets, model.tokens, model.types, model.top, model.weights

    def run(batches):
        bits, head, head_counts = shared.value
        norm = float(total + types + 1)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = text_buffers(batch.column(1))
            rows: list[list] = [[], [], [], [], []]
            tail_words, tail_counts = [], []
            for i, j in doc_chunks(offsets, 1 << 18):
                words, edge = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                keys, word_at = np.unique(words, return_inverse=True)
                single = read_counts(bits, keys, buckets, top)
                duo_keys, triples = ngrams(words, edge, buckets)
                pair_keys, duo_at = np.unique(duo_keys, return_inverse=True)
                duo, trio = read_counts(bits, pair_keys, buckets, top)[duo_at], read_counts(bits, triples, buckets, top)
                p = _probabilities(edge, single[word_at], single[np.searchsorted(keys, END)], duo, trio, norm, (a_weight, b_weight))
                at = np.minimum(np.searchsorted(head, keys), max(len(head) - 1, 0))
                known = head[at] == keys if len(head) else np.zeros(len(keys), bool)
                exact = np.where(known, head_counts[at], 0) if len(head) else np.zeros(len(keys), np.int64)
                base, sure = np.log10(exact + 1.0)[word_at], known[word_at]
                rows[0] += np.diff(edge).tolist()
                rows[1] += np.add.reduceat(sure.astype(np.int64), edge[:-1]).tolist()
                rows[2] += np.add.reduceat(base, edge[:-1]).tolist()
                rows[3] += np.add.reduceat(np.log10(p), edge[:-1]).tolist()
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    rare, times = np.unique(words[a:b][~sure[a:b]], return_counts=True)
                    tail_words.append(rare.view(np.int64))
                    tail_counts.append(times)
            out = pa.array([held_out(x) for x in ids], pa.bool_())
            lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int32), pa.array(np.concatenate(part) if part else np.zeros(0, np.int64), pa.int64())) for part in (tail_words, tail_counts)]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), out, *(pa.array(c, k) for c, k in zip(rows, kinds, strict=False)), *lists], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "times"])

    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = docs.mapInArrow(mapper(run), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rare array<bigint>, times array<bigint>")
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(model.words, "word").groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    joined = scored.drop("rare", "times").join(found, "row", "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total + types + 1)))).alias("base_score"), "score",
    )


def lm_score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows that are not held out and score all rows."""
    model = Model(df, id_col, text_col)
    return _by_buckets(model, None) if model.spread else score_documents(df, model, id_col, text_col)
