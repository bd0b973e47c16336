"""Near-duplicates by ProbMinHash: weighted word shingles, banding, exact verification.

A text's bag holds its five-word shingles (A-Z lowered, words between ASCII white
space), each weighted by how often it occurs; a text of one to four words is one
shingle. Two texts are linked where the probability Jaccard similarity of their bags
is 0.8 or more (for bags without repeats that is the Jaccard similarity). A class is
a connected component of links, named by its smallest document id.

1. One map pass: bag digest and ProbMinHash signature. The elements of a bag arrive
   by Poisson processes whose rate is their weight; an arrival picks a register, which
   keeps its first. An element stops once its clock is past the last register's.
2. Rows of one bag collapse to a node, so copies never meet in a bucket.
3. Bands of registers are bucket keys; nodes of one bucket are to be told apart or linked.
   A bucket of at most ``SMALL`` nodes is compared within, pair by pair.
4. In a larger one each node is compared, bag by bag, with the most popular node (whose
   buckets hold the most nodes), and links form classes by label propagation.
   Nodes of a larger bucket outside its largest class are compared with ``HUBS`` of that
   class. This settles almost all of a group of copies, in linear work.
5. What is left, buckets that still hold several classes, goes through an exact join
   across classes on rare shingles (``_apart``), linked nodes included, listed
   only where prefixes of several classes share them. So each pair of
   one bucket is in one class, or has been compared, or can't be similar enough.

Banding itself misses a link of similarity 0.8 about 3 times in a million. Shingles and
bags are told apart by 64 and twice 64 bits of content hash.

Null and empty texts have an empty bag and are one class (equal copies); null ids
are never a class's name unless it has no other; repeated rows are one class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import LOWER, NOT_SPACE, mix, spans_hash, word_spans
from .common import doc_chunks, given, mapper, materialize, text_buffers

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Nodes of a bucket that are compared pair by pair; more go by hubs and the exact join, with the same result.
SMALL = 64
HUBS = 16
#: Shingles go to slices by their first bits. Counters order the exact join (shingles of one counter by value); seats tell
#: what several classes share (of two shingles of a seat one may be listed in vain). Both bound what is broadcast (4 MB each).
SLICE_BITS, COUNTER_BITS, SEAT_BITS = 8, 20, 25
SLICES = 1 << SLICE_BITS
STRETCH = 1 << 20
OWN = "__kgspark_"
_C = [np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64)) for k in range(64)]
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def bags(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, their counts, first index of each document) with shingles ascending within a document."""
    low, n = LOWER[data], len(offsets) - 1
    starts, ends, docs = word_spans(low, offsets, NOT_SPACE)
    h = spans_hash(low, starts, ends)
    of = np.bincount(docs, minlength=n)
    at = np.concatenate([[0], np.cumsum(of)])
    keys, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) >= words:
        last = len(h) - words + 1
        acc = np.zeros(last, np.uint64)
        for k in range(words):
            acc += h[k : k + last] * _C[k]
        fits = docs[:last] == docs[words - 1 :]
        keys, owner = acc[fits], docs[:last][fits]
    short = np.flatnonzero((of > 0) & (of < words))
    if len(short):
        own = np.array([int(sum(int(h[at[d] + k]) * int(_C[k]) for k in range(of[d]))) + int(of[d]) & (1 << 64) - 1 for d in short.tolist()], np.uint64)
        keys, owner = np.concatenate([keys, own]), np.concatenate([owner, short])
    keys = mix(keys)
    order = np.argsort(keys, kind="stable")
    order = order[np.argsort(owner[order].astype(np.int16 if n < 32768 else np.int64), kind="stable")]
    keys, owner = keys[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(keys)))
    return keys[new], counts, np.searchsorted(owner[new], np.arange(n + 1))


def digests(keys: np.ndarray, counts: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each bag."""
    out = []
    for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys * np.uint64(salt | 1) + counts.astype(np.uint64) * _GOLD), dtype=np.uint64)])
        out.append((total[edge[1:]] - total[edge[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(keys: np.ndarray, counts: np.ndarray, edge: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers (documents x m) as 32-bit names of the element that came first."""
    n = np.diff(edge)
    docs = len(n)
    owner = np.repeat(np.arange(docs), n)
    first = np.full(docs * m, np.inf)
    burst = np.maximum(1, 4 * m // np.maximum(n, 1))[owner]  # small bags need many arrivals of each element
    rate = counts.astype(np.float64)
    clock, made = np.zeros(len(keys)), np.zeros(len(keys), np.uint64)
    active = np.arange(len(keys))
    slots, times, who = [], [], []
    while len(active):
        some = burst[active]
        who_now = np.repeat(active, some)
        stop = np.cumsum(some)
        within = (np.arange(stop[-1]) - np.repeat(stop - some, some)).astype(np.uint64)
        h = mix(keys[who_now] + (made[who_now] + within + np.uint64(1)) * _GOLD)
        gap = -np.log(((h >> np.uint64(16)).astype(np.float64) + 0.5) * 2.0**-48) / rate[who_now]
        if len(who_now) > len(active):
            run = np.cumsum(gap)
            t = clock[who_now] + run - np.repeat(run[stop - some] - gap[stop - some], some)
        else:
            t = clock[active] + gap
        slot = owner[who_now] * m + ((h & np.uint64(0xFFFF)) * np.uint64(m) >> np.uint64(16)).astype(np.int64)
        early = np.flatnonzero(t < first[slot])
        np.minimum.at(first, slot[early], t[early])
        slots.append(slot[early])
        times.append(t[early])
        who.append(who_now[early])
        clock[active] = t[stop - 1]
        made[active] += some.astype(np.uint64)
        last = first.reshape(docs, m).max(axis=1)
        active = active[clock[active] < last[owner[active]]]
    out = np.zeros(docs * m, np.uint32)
    if slots:
        slot, t, w = np.concatenate(slots), np.concatenate(times), np.concatenate(who)
        won = t == first[slot]
        out[slot[won]] = (mix(keys[w[won]] ^ _GOLD) >> np.uint64(32)).astype(np.uint32)
    return out.reshape(docs, m)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact similarity of bags a (counts x) and b (counts y); shingles ascend."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    if int(x.max()) == 1 and int(y.max()) == 1:
        return len(i) / (len(a) + len(b) - len(i))
    p, q = x[i].astype(np.float64), y[j].astype(np.float64)
    only_a, only_b = x.sum() - p.sum(), y.sum() - q.sum()
    kinds, times = np.unique(np.stack([p, q]), axis=1, return_counts=True)
    total = 0.0
    for u, v, n in zip(kinds[0].tolist(), kinds[1].tolist(), times.tolist(), strict=True):
        total += n / (only_a / u + only_b / v + np.maximum(p / u, q / v).sum())
    return total


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return keys.tobytes() if not len(counts) or int(counts.max()) == 1 else keys.tobytes() + counts.astype(np.uint32).tobytes() + b"\1"


def _unpack(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    if len(bag) % 8 == 0:
        keys = np.frombuffer(bag, np.uint64)
        return keys, np.ones(len(keys), np.uint32)
    n = (len(bag) - 1) // 12
    return np.frombuffer(bag, np.uint64, n), np.frombuffer(bag, np.uint32, n, 8 * n)


def _stretches(offsets: np.ndarray):
    for i, j in doc_chunks(offsets, 1 << 19):
        for k in range(i, j, 2048):
            yield k, min(k + 2048, j)


def _sign(batches, column: int):
    for batch in batches:
        data, offsets = text_buffers(batch.column(column))
        n1, n2, sig = [], [], []
        for i, j in _stretches(offsets):
            keys, counts, edge = bags(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            a, b = digests(keys, counts, edge)
            n1.append(a)
            n2.append(b)
            sig.append(signatures(keys, counts, edge).view(np.int32))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        flat = join([x.ravel() for x in sig], np.int32)
        lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, REGISTERS, dtype=np.int32), pa.array(flat))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(join(n1, np.int64)), pa.array(join(n2, np.int64)), lists], names=[*batch.schema.names, OWN + "n1", OWN + "n2", OWN + "sig"])


def _bag(batches):
    """Rows (rep, pop, digest, text) with the packed bag in place of the text."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(3))
        out = []
        for i, j in _stretches(offsets):
            keys, counts, edge = bags(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            out += [_pack(keys[a:b], counts[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["rep", "pop", "digest", "bag"])


def _verify(batches):
    for whole in batches:
        for i in range(0, whole.num_rows, 512):
            batch = whole.slice(i, 512)
            keep = [probability_jaccard(*_unpack(a), *_unpack(b)) >= SIMILARITY for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["rep", "hub"]).filter(pa.array(keep, pa.bool_()))


def _exhaust(batches):
    """Links of sets whose rows come one after the other; a link that joins nothing new is left out."""

    def links(group: list[tuple[int, bytes]]):
        of = [_unpack(b) for _, b in group]
        whole = [len(b) % 8 == 0 for _, b in group]
        root = list(range(len(group)))
        for j in range(1, len(group)):
            for i in range(j):
                if root[i] == root[j]:
                    continue
                few, many = sorted((len(of[i][0]), len(of[j][0])))
                if whole[i] and whole[j] and few < SIMILARITY * many:
                    continue
                if probability_jaccard(*of[i], *of[j]) >= SIMILARITY:
                    old, new = root[j], root[i]
                    root = [new if r == old else r for r in root]
                    yield group[j][0], group[i][0]

    held: list[tuple[int, bytes]] = []
    last = None
    for batch in batches:
        out: list[tuple[int, int]] = []
        for s, rep, bag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s != last:
                out += links(held)
                held, last = [], s
            held.append((rep, bag))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["rep", "hub"])
    out = list(links(held))
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["rep", "hub"])


def signed(df: DataFrame, text_col: str) -> DataFrame:
    """The rows (text_col a string) with a row number, digests and signature, written once."""
    column = df.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    out = df.mapInArrow(mapper(lambda batches: _sign(batches, column)), f"{schema}, {OWN}n1 bigint, {OWN}n2 bigint, {OWN}sig array<int>")
    return materialize(out.withColumn(OWN + "row", F.monotonically_increasing_id()), "signed")


def _packed_slices(flush, add):
    """A mapper: rows of each stretch of about ``STRETCH`` shingles, one a slice of shingles. add(row): arrays held of a bag."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(add(row))
                size += len(held[-1][0])
                if size >= STRETCH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _sliced(keys: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """Ascending 64-bit keys and their values as one row a slice."""
    cut = np.searchsorted(keys >> np.uint64(64 - SLICE_BITS), np.arange(SLICES + 1, dtype=np.uint64))
    some = np.flatnonzero(np.diff(cut))
    columns = [pa.array([v[cut[k] : cut[k + 1]].tobytes() for k in some.tolist()], pa.binary()) for v in (keys, *values)]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *columns], names=["slice", "keys", "x", "y"][: 2 + len(values)])


def _tally(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    places, counts = np.unique(np.concatenate([h[0] for h in held]) >> np.uint64(64 - COUNTER_BITS), return_counts=True)
    return _sliced(places << np.uint64(64 - COUNTER_BITS), counts.astype(np.uint32))


def _tallied(table: pa.Table) -> pa.Table:
    """How often the shingles of a slice's counters occur."""
    size = 1 << COUNTER_BITS - SLICE_BITS
    total = np.zeros(size, np.int64)
    for keys, counts in zip(table.column("keys").to_pylist(), table.column("x").to_pylist(), strict=True):
        total[(np.frombuffer(keys, np.uint64) >> np.uint64(64 - COUNTER_BITS) & np.uint64(size - 1)).astype(np.int64)] += np.frombuffer(counts, np.uint32)
    return pa.table({"slice": table.column("slice").slice(0, 1), "bits": pa.array([np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()], pa.binary())})


def _prefix(bag: bytes, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, bool, np.ndarray]:
    """(shingles of the bag's prefix from rare to frequent, weight left at each, all weight, whether none repeats, the shingle before each)."""
    keys, weights = _unpack(bag)
    order = np.lexsort((keys, often[(keys >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]))
    keys, weights = keys[order], weights[order].astype(np.int64)
    total = int(weights.sum())
    left = total - np.cumsum(weights) + weights
    n = int((5 * left >= 4 * total).sum())
    return keys[:n], left[:n], total, int(weights.max(initial=1)) == 1, np.roll(keys, 1)[:n]


def _low_high(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, low, high = keys[order], low[order], high[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)


def _roots_of(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    roots = np.concatenate([h[1] for h in held])
    return _sliced(*_low_high(np.concatenate([h[0] for h in held]), roots, roots))


def _met(table: pa.Table) -> pa.Table:
    """A bit for the shingles of a slice that prefixes of several classes have (and for what shares their bit)."""
    get = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
    keys, low, high = _low_high(get("keys", np.uint64), get("x", np.int64), get("y", np.int64))
    bits = np.zeros(1 << SEAT_BITS - SLICE_BITS, bool)
    bits[(keys[low < high] >> np.uint64(64 - SEAT_BITS) & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return pa.table({"slice": table.column("slice").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _whole(slices: DataFrame, size: int, kind) -> np.ndarray:
    """The slices' arrays one after the other, zero where there is none."""
    out = np.zeros((SLICES, size // SLICES), kind)
    for row in slices.toLocalIterator():
        out[row.slice] = np.frombuffer(row.bits, kind)
    return out.ravel()


def _prefixes(often, seats):
    """Rows (rep, root, bag) to those shingles of each bag's prefix that prefixes of other classes have as well."""

    def run(batches):
        counts, bits = often.value, seats.value
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for rep, root, bag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, left, total, plain, before = _prefix(bag, counts)
                at = keys >> np.uint64(64 - SEAT_BITS)
                some = np.flatnonzero(bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1)
                for x, v in zip(out, (keys[some].view(np.int64), [rep] * len(some), [root] * len(some), left[some], [total] * len(some), [plain] * len(some), [None if k == 0 else v for k, v in zip(some.tolist(), before[some].view(np.int64).tolist(), strict=True)]), strict=True):
                    x.extend(v)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["token", "rep", "root", "left", "total", "plain", "before"])

    return run


def _ranked(held: DataFrame) -> DataFrame:
    """(token, rep, root, left, total, plain, before) where prefixes of several classes meet. held: rep, root, bag."""
    share = held.sparkSession.sparkContext.broadcast
    bits = "slice bigint, bits binary"
    tally = held.select("bag").mapInArrow(mapper(_packed_slices(_tally, lambda row: (_unpack(row[0])[0],))), "slice bigint, keys binary, x binary")
    often = share(_whole(tally.groupBy("slice").applyInArrow(lambda t: given(_tallied, t), bits), 1 << COUNTER_BITS, np.uint32))

    def prefix(row):
        keys = _prefix(row[1], often.value)[0]
        return keys, np.full(len(keys), row[0], np.int64)

    roots = held.select("root", "bag").mapInArrow(mapper(_packed_slices(_roots_of, prefix)), "slice bigint, keys binary, x binary, y binary")
    seats = share(_whole(roots.groupBy("slice").applyInArrow(lambda t: given(_met, t), bits), 1 << SEAT_BITS - 3, np.uint8))
    return materialize(held.mapInArrow(mapper(_prefixes(often, seats)), "token bigint, rep bigint, root bigint, left bigint, total bigint, plain boolean, before bigint"), "prefixes")


def _apart(members: DataFrame, bag: DataFrame) -> DataFrame:
    """Verified (rep, hub) pairs of different roots, all there are. members: rep, root.

    Shingles are ordered from rare to frequent, and only those that prefixes of several classes have are listed. If P and Q are the shares of the two bags' weights that lie on
    common shingles, the similarity is at most P Q / (P + Q - P Q): each of its terms is at most
    1 / (1/p + (1 - Q)/q), a concave function of the shares p and q of one shingle. So 0.8 needs 1/P + 1/Q <= 2.25,
    hence P, Q >= 0.8, and from the first common shingle on both bags must have that much left. In bags without
    repeats the common number itself is bounded by what either has left. Pairs meet at such shingles and are
    compared exactly.
    """
    held = materialize(members.join(bag, "rep").select("rep", "root", "bag"), "held")
    ranked = _ranked(held)
    a, b = ranked.alias("a"), ranked.alias("b")
    near = a.join(b, F.expr(
        "a.token = b.token and a.root < b.root and not coalesce(a.before = b.before, false) and 9 * a.left * b.left >= 4 * (a.total * b.left + b.total * a.left) and (not (a.plain and b.plain) or least(a.left, b.left) * 9 >= (a.total + b.total) * 4)"
    ))
    near = near.select(F.col("a.rep").alias("hub"), F.col("b.rep").alias("rep")).distinct()
    full = near.join(bag, "rep").join(bag.select(F.col("rep").alias("hub"), F.col("bag").alias("other")), "hub").select("rep", "hub", "bag", "other")
    return full.mapInArrow(mapper(_verify), "rep bigint, hub bigint")


def _checked(asked: DataFrame, bag: DataFrame, tag: str) -> DataFrame:
    """The (rep, hub) pairs that are similar enough, written."""
    other = bag.select(F.col("rep").alias("hub"), F.col("bag").alias("other"))
    full = asked.select("rep", "hub").distinct().join(bag, "rep").join(other, "hub").select("rep", "hub", "bag", "other")
    return materialize(full.mapInArrow(mapper(_verify), "rep bigint, hub bigint"), tag)


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, root) after more links, which may have nodes that roots lack."""
    known = roots.unionByName(links.select("rep", F.col("rep").alias("root"))).unionByName(links.select(F.col("hub").alias("rep"), F.col("hub").alias("root")))
    known = materialize(known.groupBy("rep").agg(F.min("root").alias("root")), "known")
    of = lambda c: known.select(F.col("rep").alias(c), F.col("root").alias(c + "_root"))
    upper = components(links.join(of("rep"), "rep").join(of("hub"), "hub").select(F.col("rep_root").alias("rep"), F.col("hub_root").alias("hub")).where("rep <> hub"))
    upper = upper.select(F.col("rep").alias("root"), F.col("root").alias("upper"))
    return materialize(known.join(upper, "root", "left").select("rep", F.coalesce("upper", "root").alias("root")), "roots")


def _split(crowd: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, rep, root) of the buckets that hold several classes."""
    named = materialize(crowd.join(roots, "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root")), "crowd")
    several = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return named.join(several.select("key"), "key")


def _roots(rows: DataFrame, text_col: str, reps: DataFrame) -> DataFrame:
    """(rep, root) of every node with a link. rows: row number, text, digests, signature."""
    nodes = rows.join(reps.select(F.col("rep").alias(OWN + "row")), OWN + "row", "left_semi")
    sig = F.col(OWN + "sig")
    keys = F.array(*(F.xxhash64(F.lit(b), F.slice(sig, b * ROWS + 1, ROWS)) for b in range(BANDS)))
    spread = nodes.select(F.col(OWN + "row").alias("rep"), F.explode(keys).alias("key"))
    sizes = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(spread.join(sizes, "key"), "buckets")
    popular = shared.groupBy(F.col("rep").alias(OWN + "row")).agg(F.sum("n").alias("pop"))
    actives = nodes.join(popular, OWN + "row").select(F.col(OWN + "row").alias("rep"), "pop", F.col(OWN + "n1").alias("digest"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed_bag = actives.mapInArrow(mapper(_bag), "rep bigint, pop bigint, digest bigint, bag binary")
    bag = materialize(signed_bag, "bags")
    sets = shared.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("rep")).alias("members")).select("members")
    sets = materialize(sets.distinct().withColumn("s", F.monotonically_increasing_id()), "sets")
    listed = sets.select("s", F.explode("members").alias("rep")).join(bag.select("rep", "bag"), "rep").select("s", "rep", "bag")
    links = materialize(listed.repartition("s").sortWithinPartitions("s").mapInArrow(mapper(_exhaust), "rep bigint, hub bigint"), "small")
    crowd = shared.where(F.col("n") > SMALL).select("key", "rep")
    if crowd.isEmpty():
        return components(links)
    about = bag.select("rep", "pop", "digest")
    hubs = crowd.join(about, "rep").groupBy("key").agg(F.max(F.struct("pop", "digest", "rep")).alias("h"))  # ties by content: the same hubs however rows are dealt
    asked = crowd.join(hubs.select("key", F.col("h.rep").alias("hub")), "key").where("rep <> hub")
    roots = components(links.unionByName(_checked(asked, bag.select("rep", "bag"), "starred")))
    split = materialize(_split(crowd, roots), "split")
    if split.isEmpty():
        return roots
    largest = split.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"))
    sides = materialize(split.join(largest.where("m.n > 1").select("key", F.col("m.root").alias("main")), "key"), "sides")
    ranked = sides.where("root = main").join(about, "rep").groupBy("key").agg(F.array(*(F.min(F.struct(F.xxhash64("digest", F.lit(i)).alias("o"), "rep"))["rep"] for i in range(HUBS))).alias("hubs"))
    asked = sides.where("root <> main").select("key", "rep").join(ranked, "key").select("rep", F.explode(F.array_distinct("hubs")).alias("hub"))
    roots = _merged(roots, _checked(asked, bag.select("rep", "bag"), "drawn"))
    members = materialize(_split(crowd, roots).select("rep", "root").distinct(), "members")
    if members.isEmpty():
        return roots
    return _merged(roots, materialize(_apart(members, bag.select("rep", "bag")), "apart"))


def components(links: DataFrame) -> DataFrame:
    """(rep, root) of every node with a link; the root is the component's smallest node."""
    edges = materialize(links.select("rep", "hub").union(links.select("hub", "rep")).distinct(), "edges")
    labels = materialize(edges.groupBy("rep").agg(F.min("hub").alias("m")).select("rep", F.least("rep", "m").alias("root")), "labels0")
    round_no = 0
    while True:  # labels only fall, and halve their distance to the end of a chain
        round_no += 1
        near = edges.join(labels.select(F.col("rep").alias("hub"), "root"), "hub").groupBy("rep").agg(F.min("root").alias("near"))
        told = labels.join(near, "rep").select("rep", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jumped = told.join(labels.select(F.col("rep").alias("root"), F.col("root").alias("up")), "root").select("rep", F.least("root", "up").alias("root"), "old")
        new = materialize(jumped, f"labels{round_no}")
        labels = new.select("rep", "root")
        if new.where("root <> old").isEmpty():
            return labels


def classes(rows: DataFrame, text_col: str) -> DataFrame:
    """(row number, root) of every signed row."""
    digest = [OWN + "n1", OWN + "n2"]
    reps = materialize(rows.groupBy(*digest).agg(F.min(OWN + "row").alias("rep")), "reps")
    roots = _roots(rows, text_col, reps)
    named = reps.join(roots, "rep", "left").select(*digest, F.coalesce("root", "rep").alias("root"))
    return rows.select(OWN + "row", *digest).join(named, digest).select(OWN + "row", "root")


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size), one row per input row; class_id is the smallest id of the class."""
    slim = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = signed(slim, "text")
    member = materialize(rows.select(OWN + "row", "doc_id").join(classes(rows, "text"), OWN + "row").select("doc_id", "root"), "members")
    named = member.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return member.join(named, "root").select("doc_id", "class_id", "class_size")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class with its own columns: the one of the smallest id (nulls last)."""
    rows = signed(df, text_col)
    of = rows.select(OWN + "row", F.col(f"`{id_col}`").alias(OWN + "id")).join(classes(rows, text_col), OWN + "row")
    keep = of.groupBy("root").agg(F.min(F.struct(F.col(OWN + "id").isNull(), OWN + "id", OWN + "row"))[OWN + "row"].alias(OWN + "row"))
    return rows.join(keep, OWN + "row", "left_semi").select(*df.columns)
