"""Removal of long strings that occur earlier, by a logarithmic family of suffix arrays.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts earlier
(in a smaller document id, or in the same document before). All strings are judged
on the input, and none reaches across documents.

Only prefixes of LENGTH bytes matter, so a suffix array here is an array of suffix
starts sorted by a 64-bit hash of that prefix: suffixes with one prefix stand
together, which is what the merge scan needs. Each match that the hashes report is
compared byte by byte; should two prefixes share a hash, its bucket is redone with
the bytes themselves as keys.

The suffix space is split so that equal prefixes meet: of the ANCHOR-byte strings
inside a prefix the one with the least hash is its anchor, which depends on the
prefix alone, so neighbouring suffixes share anchors (about one in 35 bytes is one)
and equal prefixes have the same. Steps:

1. anchors: documents are dealt to parts; a part lists the anchors it has, once each.
2. shared: a bucket of anchors takes the parts as batches; each batch's sorted array
   is merge-scanned against the levels of the index so far, then becomes a level, and
   levels of like size merge. What two parts have is told to both.
3. candidates: a part sorts the suffixes at shared anchors (and those it repeats
   itself), settles all but the first of each there and sends the firsts, with text.
4. matches: a bucket takes suffixes in document order as batches of a second index
   family with the same levels; those that an earlier batch has are matched.
5. A part merges the spans and cuts its documents.

A passage that a third of all documents hold thus leaves a part once, not once a
document. Parts and buckets have bounded size by the number chosen from the bytes
that there are; no step gathers a group of documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import mix, rolling, window_min
from .common import doc_chunks, given, text_buffers, total_bytes

LENGTH = 100
ANCHOR = 32
PART_BYTES = 1 << 21
BUCKET_BYTES = 1 << 23
#: From so many buckets on they widen, up to so many times.
FEW_BUCKETS, WIDEST = 32, 8
STEP_BYTES = 1 << 21
BATCH_SUFFIXES = 1 << 16
CHUNK_BYTES = 1 << 18
OWN = "__kgspark_"


class LevelIndex:
    """A logarithmic family: sorted arrays of keys with values, doubling in size from the last to the first."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, keys: np.ndarray) -> np.ndarray:
        """The value of each of the sorted keys in some level, or -1."""
        found = np.full(len(keys), -1, np.int64)
        for have, values in self.levels:
            at = np.searchsorted(have, keys)
            at[at == len(have)] = 0
            hit = have[at] == keys
            found[hit] = values[at[hit]]
        return found

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """A batch of new sorted keys becomes a level; levels no larger than what follows them merge."""
        while len(keys) and self.levels and len(self.levels[-1][0]) <= len(keys):
            have, old = self.levels.pop()
            keys, values = np.concatenate([have, keys]), np.concatenate([old, values])
            order = np.argsort(keys, kind="stable")  # two sorted runs: a merge
            keys, values = keys[order], values[order]
        if len(keys):
            self.levels.append((keys, values))


class Runs:
    """The suffixes of some documents, grouped by anchor: runs of neighbouring starts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
        self.data, self.offsets = data, offsets
        keys, docs, starts, counts = [], [], [], []
        width = length - anchor + 1
        for i, j in doc_chunks(offsets, CHUNK_BYTES):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if len(part) < length:
                continue
            h = mix(rolling(part, anchor))
            low = np.uint64((1 << max(20, len(part).bit_length())) - 1)
            least = window_min((h & ~low) | np.arange(len(h), dtype=np.uint64), width) & low  # the leftmost of equals
            doc = np.repeat(np.arange(j - i), np.diff(at))[: len(least)]
            inside = np.flatnonzero(np.arange(len(least)) + length <= at[doc + 1])
            if not len(inside):
                continue
            a = least[inside].astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (inside[1:] != inside[:-1] + 1)]))
            keys.append(mix(h[a[new]]))  # anchors have small hashes; mixed again they spread evenly
            docs.append(doc[inside[new]] + i)
            starts.append(inside[new] - at[doc[inside[new]]])
            counts.append(np.diff(np.append(new, len(inside))))
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        self.keys, self.docs, self.starts, self.counts = join(keys, np.uint64), join(docs, np.int64), join(starts, np.int64), join(counts, np.int64)


def _expand(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(firsts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def _prefix_hashes(data: np.ndarray, firsts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the prefixes at firsts[i], firsts[i] + 1, ...; runs ascend in ``data``, where they may overlap."""
    out = np.empty(int(counts.sum()), np.uint64)
    done, i = 0, 0
    while i < len(firsts):
        j = int(np.searchsorted(firsts, firsts[i] + CHUNK_BYTES))
        j = max(j, i + 1)
        a, b = int(firsts[i]), int(firsts[j - 1] + counts[j - 1] + length - 1)
        h = rolling(data[a:b], length)
        n = int(counts[i:j].sum())
        out[done : done + n] = h[_expand(firsts[i:j] - a, counts[i:j])]
        done, i = done + n, j
    return mix(out)


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> bool:
    """Whether data[a[i]:][:length] equals data[b[i]:][:length] for all i, in bounded steps."""
    span = np.arange(length)
    for i in range(0, len(a), 1 << 15):
        if (data[a[i : i + (1 << 15), None] + span] != data[b[i : i + (1 << 15), None] + span]).any():
            return False
    return True


def _ends(at: np.ndarray, to: np.ndarray, length: int) -> np.ndarray:
    """Of matches at[i] -> to[i], the first and last of each stretch that moves in step: their prefixes cover the others'."""
    if not len(at):
        return np.zeros(0, np.int64)
    cut = (at[1:] != at[:-1] + 1) | (to[1:] != to[:-1] + 1)
    far = np.arange(len(at)) % max(1, length // 2) == 0
    return np.flatnonzero(np.concatenate([[True], cut]) | np.concatenate([cut, [True]]) | far)


def repeats(data: np.ndarray, firsts: np.ndarray, counts: np.ndarray, length: int, batch: int = BATCH_SUFFIXES) -> np.ndarray:
    """For every suffix of the runs, in the order given, whether an earlier one has its prefix.

    Batches of runs are sorted into suffix arrays, scanned against the index family and added to it.
    """
    at = _expand(firsts, counts)
    hashes = _prefix_hashes(data, firsts, counts, length)
    again = np.zeros(len(at), bool)
    first_of = np.arange(len(at))
    index = LevelIndex()
    for i in range(0, len(at), batch):
        keys = hashes[i : i + batch]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        lead = np.concatenate([[True], keys[1:] != keys[:-1]])
        heads = np.flatnonzero(lead)
        known = index.scan(keys[heads])
        own = order[heads] + i
        source = np.where(known >= 0, known, own)
        first_of[order + i] = np.repeat(source, np.diff(np.append(heads, len(keys))))
        index.add(keys[heads[known < 0]], own[known < 0])
    moved = np.flatnonzero(first_of != np.arange(len(at)))
    again[moved] = True
    check = moved[_ends(at[moved], at[first_of[moved]], length)]
    if not _same(data, at[check], at[first_of[check]], length):  # two prefixes with one hash
        seen: dict[bytes, None] = {}
        raw = data.tobytes()
        for k, p in enumerate(at.tolist()):
            text = raw[p : p + length]
            again[k] = text in seen
            seen[text] = None
    return again


def _sorted_part(table: pa.Table, id_col: str, text_col: str) -> pa.Table:
    """Rows in document order: ids ascending, nulls first, ties by text; the same whenever a part is read."""
    keys = pa.table({"i": table.column(id_col), "t": table.column(text_col)})
    order = pa.compute.sort_indices(keys, sort_keys=[("i", "ascending"), ("t", "ascending")], null_placement="at_start")
    return table.take(order)


def _spans(docs: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring repeated starts as (document, first byte, end byte)."""
    if not len(docs):
        return docs, starts, starts
    new = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.append(new[1:], len(docs)) - 1
    return docs[new], starts[new], starts[last] + length


_WIDE = "part bigint, bucket bigint, keys binary, ids binary, nulls binary, docs binary, starts binary, counts binary, text binary, span_docs binary, span_starts binary, span_ends binary"
_BINARY = [x.split()[0] for x in _WIDE.split(", ")][2:]


def _row(part: int, bucket: int, **values: np.ndarray) -> dict:
    return {"part": part, "bucket": bucket} | {k: v.tobytes() for k, v in values.items()}


def _wide(rows: list[dict]) -> pa.Table:
    return pa.table({k: pa.array([r.get(k) for r in rows], pa.int64() if k in ("part", "bucket") else pa.binary()) for k in ["part", "bucket", *_BINARY]})


class _Steps:
    """The functions of the five steps; they are sent to workers with their settings."""

    def __init__(self, id_col: str, text_col: str, length: int, buckets: int):
        self.id_col, self.text_col, self.length, self.buckets = id_col, text_col, length, buckets
        self.anchor = max(4, min(ANCHOR, length // 3))

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)

    def _open(self, table: pa.Table) -> tuple[pa.Table, Runs]:
        table = _sorted_part(table, self.id_col, self.text_col)
        return table, Runs(*text_buffers(table.column(self.text_col)), self.length, self.anchor)

    def anchors(self, key, table: pa.Table) -> pa.Table:
        _, runs = self._open(table)
        keys = np.unique(runs.keys)
        cut = np.searchsorted(self.bucket(keys), np.arange(self.buckets + 1))
        some = np.flatnonzero(cut[1:] > cut[:-1])
        return pa.table({"part": pa.array([key[0].as_py()] * len(some), pa.int64()), "bucket": pa.array(some), "keys": pa.array([keys[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary())})

    def shared(self, table: pa.Table) -> pa.Table:
        parts = table.column("part").to_pylist()
        order = sorted(range(len(parts)), key=parts.__getitem__)
        lists = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")]
        index, hits = LevelIndex(), []
        for k in order:
            known = index.scan(lists[k]) >= 0
            hits.append(lists[k][known])
            fresh = lists[k][~known]
            index.add(fresh, np.zeros(len(fresh), np.int64))
        both = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.uint64)
        out: list[tuple[int, bytes]] = []
        for k in order if len(both) else ():
            at = np.searchsorted(both, lists[k])
            at[at == len(both)] = 0
            mine = lists[k][both[at] == lists[k]]
            if len(mine):
                out.append((parts[k], mine.tobytes()))
        return pa.table({"part": pa.array([x[0] for x in out], pa.int64()), "keys": pa.array([x[1] for x in out], pa.binary())})

    def candidates(self, key, table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _wide([])
        table, runs = self._open(table)
        shared = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_py(), np.uint64) for x in told.column("keys"))]))
        at = np.minimum(np.searchsorted(shared, runs.keys), max(len(shared) - 1, 0))
        outside = shared[at] == runs.keys if len(shared) else np.zeros(len(runs.keys), bool)
        _, inverse, times = np.unique(runs.keys, return_inverse=True, return_counts=True)
        use = np.flatnonzero(outside | (times[inverse] > 1))
        keys, docs, starts, counts, outside = runs.keys[use], runs.docs[use], runs.starts[use], runs.counts[use], outside[use]
        firsts = runs.offsets[docs] + starts
        again = repeats(runs.data, firsts, counts, self.length)
        run_of = np.repeat(np.arange(len(use)), counts)
        part = key[0].as_py()
        rows = []
        if again.any():
            spans = _spans(docs[run_of[again]], (_expand(starts, counts))[again], self.length)
            rows.append(_row(part, part % self.buckets, span_docs=spans[0].astype(np.int32), span_starts=spans[1], span_ends=spans[2]))
        send = np.flatnonzero(outside & (np.bincount(run_of[~again], minlength=len(use)) > 0))
        ids = table.column(self.id_col)
        nulls = np.asarray(ids.is_null())
        values = ids.fill_null(0).to_numpy()
        where = self.bucket(keys[send])
        send = send[np.argsort(where, kind="stable")]
        cut = np.searchsorted(np.sort(where), np.arange(self.buckets + 1))
        for b in np.flatnonzero(cut[1:] > cut[:-1]):
            s = send[cut[b] : cut[b + 1]]
            text = runs.data[_expand(firsts[s], counts[s] + self.length - 1)]
            rows.append(_row(part, int(b), keys=keys[s], ids=values[docs[s]].astype(np.int64), nulls=nulls[docs[s]], docs=docs[s].astype(np.int32), starts=starts[s], counts=counts[s].astype(np.uint16), text=text))
        return _wide(rows)

    def matches(self, key, table: pa.Table) -> pa.Table:
        own = table.column("span_docs").is_valid()
        out = table.filter(own).select(["part", "bucket", "span_docs", "span_starts", "span_ends"]).to_pylist()
        table = table.filter(pa.compute.invert(own))
        if table.num_rows:
            get = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)])
            keys, ids, nulls, docs, starts, counts = get("keys", np.uint64), get("ids", np.int64), get("nulls", bool), get("docs", np.int32), get("starts", np.int64), get("counts", np.uint16).astype(np.int64)
            parts = np.repeat(table.column("part").to_numpy(), [len(x.as_py()) // 4 for x in table.column("docs")])
            text, _ = text_buffers(table.column("text"))
            sizes = counts + self.length - 1
            firsts = np.cumsum(sizes) - sizes
            steps = -(-len(text) // STEP_BYTES)  # equal prefixes have one anchor, so slices of keys can go one by one
            found = []
            for k in range(steps):
                some = np.flatnonzero(keys % np.uint64(steps) == np.uint64(k))
                order = some[np.lexsort((starts[some], docs[some], parts[some], ids[some], ~nulls[some]))]
                mine = text[_expand(firsts[order], sizes[order])]
                again = repeats(mine, np.cumsum(sizes[order]) - sizes[order], counts[order], self.length)
                run_of = order[np.repeat(np.arange(len(order)), counts[order])[again]]
                found.append(_spans(parts[run_of] << 32 | docs[run_of], _expand(starts[order], counts[order])[again], self.length))
            whose, first, end = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(whose, kind="stable")  # a row a part, however many parts and steps there are
            whose, first, end = whose[order], first[order], end[order]
            cut = np.flatnonzero(np.diff(whose >> 32, prepend=-1))
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(whose)], strict=False):
                out.append(_row(int(whose[i] >> 32), 0, span_docs=(whose[i:j] & 0xFFFFFFFF).astype(np.int32), span_starts=first[i:j], span_ends=end[i:j]))
        return _wide(out).select(["part", "span_docs", "span_starts", "span_ends"])

    def removed(self, table: pa.Table, spans: pa.Table):
        """The part's rows in order, their bytes and offsets, and a mask of removed bytes."""
        table = _sorted_part(table, self.id_col, self.text_col)
        data, offsets = text_buffers(table.column(self.text_col))
        get = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_py(), kind) for x in spans.column(name))])
        docs = get("span_docs", np.int32)
        step = np.zeros(len(data) + 1, np.int32)
        np.add.at(step, offsets[docs] + get("span_starts", np.int64), 1)
        np.add.at(step, offsets[docs] + get("span_ends", np.int64), -1)
        return table, data, offsets, np.cumsum(step)[:-1] > 0

    def digest(self, table: pa.Table, spans: pa.Table) -> pa.Table:
        table, data, offsets, gone = self.removed(table, spans)
        rows: list[list] = [[], [], [], []]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            mask = gone[a:b]
            rows[0].append(b - a)
            rows[1].append(int(mask.sum()))
            rows[2].append(int((np.diff(mask.astype(np.int8), prepend=0) == 1).sum()))
            rows[3].append(hashlib.sha256(data[a:b][~mask].tobytes()).hexdigest())
        return pa.table({"doc_id": table.column(self.id_col).cast(pa.int64()), **{k: pa.array(v, t) for k, v, t in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), rows, (pa.int64(),) * 3 + (pa.string(),), strict=True)}})

    def cut(self, table: pa.Table, spans: pa.Table) -> pa.Table:
        """Texts without what was removed; a character of which bytes would stay is kept whole."""
        table, data, offsets, gone = self.removed(table, spans)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        if len(lead):
            gone = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(data))))
        texts, was_null = [], table.column(self.text_col).is_null().to_pylist()
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            texts.append(None if was_null[k] else data[a:b][~gone[a:b]].tobytes().decode())
        table = table.set_column(table.schema.get_field_index(self.text_col), self.text_col, pa.array(texts, pa.string()))
        return table.drop_columns([OWN + "part"])


def dealt(size: int) -> tuple[int, int]:
    """Parts and buckets for so many bytes of text: a part may send a row to each bucket, so buckets widen with the text."""
    wide = min(max(BUCKET_BYTES, size // FEW_BUCKETS), WIDEST * BUCKET_BYTES)
    return max(1, -(-size // PART_BYTES)), max(1, -(-size // wide))


def _plan(df: DataFrame, id_col: str, text_col: str, length: int):
    parts, buckets = dealt(total_bytes(df, f"`{text_col}`"))
    steps = _Steps(id_col, text_col, length, buckets)
    docs = df.withColumn(OWN + "part", F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(parts)).cast("bigint"))
    grouped = docs.groupBy(OWN + "part")
    listed = grouped.applyInArrow(lambda key, t: given(steps.anchors, key, t), "part bigint, bucket bigint, keys binary")
    told = listed.groupBy("bucket").applyInArrow(lambda t: given(steps.shared, t), "part bigint, keys binary")
    sent = grouped.cogroup(told.groupBy("part")).applyInArrow(lambda key, a, b: given(steps.candidates, key, a, b), _WIDE)
    spans = sent.groupBy("bucket").applyInArrow(lambda key, t: given(steps.matches, key, t), "part bigint, span_docs binary, span_starts binary, span_ends binary")
    return steps, docs, grouped, spans.groupBy("part")


def suffix_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per input row.

    Null texts count as empty, null ids come before all others, rows of one id are
    separate documents in the order of their texts.
    """
    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    steps, _, grouped, spans = _plan(slim, "doc_id", "text", length)
    return grouped.cogroup(spans).applyInArrow(lambda a, b: given(steps.digest, a, b), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The input's rows and columns with repeated bytes cut from the text (null texts stay null, texts may become empty)."""
    steps, docs, grouped, spans = _plan(df, id_col, text_col, length)
    return grouped.cogroup(spans).applyInArrow(lambda a, b: given(steps.cut, a, b), docs.drop(OWN + "part").schema)
