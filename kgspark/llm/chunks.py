"""Text cut into parts that tokenise independently, each distinct part coded once.

Bounds are found on UTF-8 bytes with array operations: before ASCII white space
that follows a character which is surely no white space, and after a leading
run of Latin letters that ASCII other than a letter follows. Tokenisers whose
pieces are runs of letters, runs of others, or white space (with at most one
blank before a run) never build a piece across such a bound. Equal parts of a
stretch meet by a 64-bit hash and are compared byte by byte; codes are memoised by
the bytes themselves, boundedly.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .bytesops import same_spans, spans_hash
from .common import doc_chunks

_SPACE = np.zeros(256, bool)
_SPACE[0x20] = _SPACE[0x09:0x0E] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True
_ASCII_OTHER = np.zeros(256, bool)
_ASCII_OTHER[:0x80] = ~_ASCII_LETTER[:0x80]
_LEAD2 = np.zeros(256, bool)
_LEAD2[0xC3:0xE0] = True
_LEAD3 = np.zeros(256, bool)
_LEAD3[0xE0] = _LEAD3[0xE4:0xF0] = True
_LEAD4 = np.zeros(256, bool)
_LEAD4[0xF0:0xF5] = True
_LATIN_LEAD = np.zeros(256, bool)
_LATIN_LEAD[0xC3:0xC9] = True  # U+00C0 to U+023F

MAX_CACHED = 250_000
#: A longer part is coded each time that a stretch has it, and not kept.
LONG_PART = 256
#: Parts that are looked up, and coded if need be, at once.
BLOCK = 1 << 14


def bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted starts of parts, document starts among them, and the end of the data."""
    n = len(data)
    space = _SPACE[data]
    ends = ~space & (data < 0x80)  # by index: the byte is the last of a character that is no white space
    if n and int(data.max()) >= 0x80:
        ends[1:] |= _LEAD2[data[:-1]] & (data[1:] >= 0x80)
        ends[2:] |= _LEAD3[data[:-2]] & (data[2:] >= 0x80) & (data[1:-1] >= 0x80)
        ends[3:] |= _LEAD4[data[:-3]] & (data[3:] >= 0x80)
    cut = np.zeros(n + 1, bool)
    cut[1:n] = ends[:-1] & space[1:]
    letter = _ASCII_LETTER[data]
    latin = np.flatnonzero(_LATIN_LEAD[data[:-1]]) if n else np.zeros(0, np.int64)
    latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7) | (data[latin] != 0xC3)]  # the signs for times and divide
    latin = latin[(data[latin] != 0xC4) | (data[latin + 1] != 0xB0)]  # in lower case it ends in a mark
    letter[latin] = letter[latin + 1] = True
    fresh = np.zeros(n + 1, bool)  # a leading run may start here
    fresh[offsets[:-1]] = True
    fresh[1:n] |= space[:-1]
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    stops = stops[fresh[starts] & (stops < n)]
    cut[stops[_ASCII_OTHER[data[stops]]]] = True
    cut[offsets] = True
    return np.flatnonzero(cut)


class PartCoder:
    """Codes texts by ``code(parts) -> little-endian unsigned 32-bit ids of each``, parts and ids as bytes."""

    def __init__(self, code: Callable[[list[bytes]], list[bytes]], strip: bool, most: int = MAX_CACHED):
        self.code, self.strip, self.most = code, strip, most
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _block(self, parts: list[bytes]) -> list[bytes]:
        out = list(map(self.new.get, parts))
        unknown = [k for k, value in enumerate(out) if value is None]
        fresh = []
        for k in unknown:
            out[k] = self.old.get(parts[k])
            if out[k] is None:
                fresh.append(k)
        if fresh:
            for k, value in zip(fresh, self.code([parts[k] for k in fresh]), strict=True):
                out[k] = value
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new.update([(parts[k], out[k]) for k in unknown if len(parts[k]) <= LONG_PART])
        return out

    def _codes(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        out = []
        for i in range(0, len(starts), BLOCK):
            out += self._block([raw[a:b] for a, b in zip(starts[i : i + BLOCK].tolist(), ends[i : i + BLOCK].tolist(), strict=True)])
        return out

    def documents(self, data: np.ndarray, offsets: np.ndarray, most: int = 1 << 19):
        """Yield the ids of each document in order, as uint32 arrays."""
        for i, j in doc_chunks(offsets, most):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            cuts = bounds(part, at)
            starts, ends = cuts[:-1], cuts[1:]
            if not len(starts):
                yield from (np.zeros(0, np.uint32) for _ in range(j - i))
                continue
            hashes = spans_hash(part, starts, ends)
            order = np.argsort(hashes)  # np.unique would sort stably, which takes longer
            fresh = np.append(True, np.diff(hashes[order]) != 0)
            first, inverse = order[fresh], np.empty(len(order), np.int64)
            inverse[order] = np.cumsum(fresh) - 1
            alike = first[inverse]
            if not ((ends - starts) == (ends - starts)[alike]).all() or not same_spans(part, starts, starts[alike], ends - starts):
                first = inverse = np.arange(len(starts))  # two parts share a hash: each is looked up by its bytes
            starts, ends = starts[first], ends[first]
            if self.strip:  # leading ASCII white space has no code
                text = np.flatnonzero(~_SPACE[part])
                starts = np.minimum(np.append(text, len(part))[np.searchsorted(text, starts)], ends)
            codes = self._codes(part.tobytes(), starts, ends)
            table = np.frombuffer(b"".join(codes), "<u4")
            sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
            base = np.cumsum(sizes) - sizes
            n = sizes[inverse]
            stop = np.cumsum(n)
            ids = table[np.repeat(base[inverse] - (stop - n), n) + np.arange(stop[-1])]
            edge = np.append(0, stop)[np.searchsorted(cuts[:-1], at)] if len(stop) else np.zeros(j - i + 1, np.int64)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                yield ids[a:b]
