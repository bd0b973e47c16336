"""Vectorised byte kernels: rolling hashes, window minima, word bounds and word hashes.

Hashes of windows are 64-bit polynomials modulo 2**64 with an odd base, those of spans
sums of keyed bytes; both are finished by a bijective mixer. They depend on content
alone, never on position or process. A polynomial collides on Thue-Morse strings for
every base, so nothing takes equal window hashes for equal bytes without comparing.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64 (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """Unmixed polynomial hash of every k-byte window, by doubling."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    cur, m, out, length = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if k & m:
            if out is None:
                out, length = cur, m
            else:
                tail = cur[length:]
                out = out[: len(tail)] * np.uint64(pow(BASE, m, 1 << 64)) + tail
                length += m
        if 2 * m > k:
            return out[: len(data) - k + 1]
        cur = cur[:-m] * np.uint64(pow(BASE, m, 1 << 64)) + cur[m:]
        m *= 2


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    cur, m = values, 1
    while 2 * m <= w:
        cur = np.minimum(cur[:-m], cur[m:])
        m *= 2
    if m < w:
        cur = np.minimum(cur[: len(values) - w + 1], cur[w - m : w - m + len(values) - w + 1])
    return cur


def expand(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (count numbers) of each pair, one after the other."""
    stops = np.cumsum(counts)
    return np.repeat(firsts - (stops - counts), counts) + np.arange(stops[-1] if len(stops) else 0)


_BYTE_KEYS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_PLACE_KEYS = np.zeros(0, np.uint64)
_MOST_PLACES = 1 << 20


def _place_keys(n: int) -> np.ndarray:
    global _PLACE_KEYS
    if len(_PLACE_KEYS) < n:
        _PLACE_KEYS = mix(np.arange(1, (1 << max(12, (n - 1).bit_length())) + 1, dtype=np.uint64))
    return _PLACE_KEYS


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of data[s:e] for each span, independent of where it lies.

    A byte's key times the key of its place within the span, both pseudo-random, summed.
    Different strings share a hash with the probability of a random 64-bit value; it is
    no proof of equality, so whoever needs identity compares the bytes.
    """
    sizes = ends - starts
    stops = np.cumsum(sizes)
    total = int(stops[-1]) if len(stops) else 0
    if not total:
        return mix(np.zeros(len(starts), np.uint64))
    within = np.arange(total) - np.repeat(stops - sizes, sizes)
    longest = int(sizes.max())
    places = _place_keys(longest)[within] if longest <= _MOST_PLACES else mix(within.astype(np.uint64) + np.uint64(1))
    whole = total == len(data) and int(starts[0]) == 0 and bool((starts[1:] == ends[:-1]).all())
    places *= _BYTE_KEYS[data if whole else data[expand(starts, sizes)]]
    prefix = np.zeros(total + 1, np.uint64)
    np.cumsum(places, out=prefix[1:])
    return mix(prefix[stops] - prefix[stops - sizes] + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def same_spans(data: np.ndarray, starts: np.ndarray, others: np.ndarray, sizes: np.ndarray, step: int = 1 << 20) -> bool:
    """Whether data[s:s + n] equals data[o:o + n] for all spans, in steps of bounded size."""
    move = np.flatnonzero(starts != others)
    starts, others, sizes = starts[move], others[move], sizes[move]
    stops, i = np.cumsum(sizes), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(stops, stops[i] - sizes[i] + step, side="right")))
        if not np.array_equal(data[expand(starts[i:j], sizes[i:j])], data[expand(others[i:j], sizes[i:j])]):
            return False
        i = j
    return True


#: Bytes of words as in ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is lowered: 0-9, a-z and all of >= 0x80.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
#: Bytes that are not white space in ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[0x20] = NOT_SPACE[0x09:0x0E] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
    """(starts, ends, document) of maximal runs of bytes of ``kind`` within each document."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = kind[data]
    starts = np.flatnonzero(np.diff(inside) == 1)
    ends = np.flatnonzero(np.diff(inside) == -1)
    cuts = offsets[1:-1]
    if len(cuts) and len(starts):  # a run that crosses a document's end becomes two
        at = np.searchsorted(starts, cuts, side="left") - 1
        cross = cuts[(at >= 0) & (starts[np.maximum(at, 0)] < cuts) & (ends[np.maximum(at, 0)] > cuts)]
        if len(cross):
            cross = np.unique(cross)
            starts, ends = np.sort(np.concatenate([starts, cross])), np.sort(np.concatenate([ends, cross]))
    docs = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, docs
