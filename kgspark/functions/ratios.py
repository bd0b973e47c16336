"""Sequence ratios of many pairs at once: the blocks of difflib's matcher by arrays over pairs, after bounds that cost one matrix product."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np

#: Longer strings go to difflib itself; places of a block are packed into 6 bits.
LONG = 64
BLOCK = 1024
PAIRS = 1 << 15


class Coder:
    """Characters of one side as small numbers; 0 stands for all others, ``end`` for places past the end on that side."""

    def __init__(self, texts: list[str]):
        self.points = np.unique(np.array(list(set("".join(texts))), dtype="U1").view(np.uint32)) if any(texts) else np.zeros(0, np.uint32)
        self.end = len(self.points) + 1
        self.kind = np.uint8 if self.end < 255 else np.uint32

    def codes(self, texts: list[str], fill: int) -> np.ndarray:
        """(place, text) with ``fill`` past the end."""
        lengths = np.array([len(x) for x in texts])
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.searchsorted(self.points, flat)
        known = self.points[np.minimum(at, len(self.points) - 1)] == flat if len(self.points) else np.zeros(len(flat), bool)
        out = np.full((len(texts), max(lengths.max(initial=0), 1)), fill, self.kind)
        out[np.arange(out.shape[1]) < lengths[:, None]] = np.where(known, at + 1, 0)
        return np.ascontiguousarray(out.T)

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """(text, character): how often, characters of the other side alone left out."""
        width, n = codes.shape
        place = codes.astype(np.int64) + np.arange(n) * (self.end + 1)
        return np.bincount(place.ravel(), minlength=n * (self.end + 1)).reshape(n, self.end + 1)[:, 1 : self.end]


class Block:
    def __init__(self, coder: Coder, texts: list[str], fill: int):
        self.texts, self.lengths = texts, np.array([len(x) for x in texts])
        self.codes = coder.codes(texts, fill)
        self.counts = coder.counts(self.codes)

    @property
    def low(self) -> int:
        return int(self.lengths[0])

    @property
    def high(self) -> int:
        return int(self.lengths[-1])


def blocks(coder: Coder, texts: list[str], fill: int) -> list[Block]:
    """Texts by length, so many a block and none much longer than the block's first; the empty one is left out."""
    ordered, out, start = sorted((x for x in texts if x), key=len), [], 0
    for k in range(1, len(ordered) + 1):
        if k == len(ordered) or k - start == BLOCK or 10 * len(ordered[k]) > 11 * len(ordered[start]) + 10:
            out.append(Block(coder, ordered[start:k], fill))
            start = k
    return out


def common_characters(a: Block, b: Block) -> np.ndarray:
    """(text of a, text of b): how many characters both have, each as often as the rarer."""
    total = np.zeros((len(a.texts), len(b.texts)), np.float32)
    for level in range(1, int(min(a.counts.max(initial=0), b.counts.max(initial=0))) + 1):
        x, y = a.counts >= level, b.counts >= level
        both = x.any(axis=0) & y.any(axis=0)
        total += x[:, both].astype(np.float32) @ y[:, both].astype(np.float32).T
    return total


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in a, start in b, length) of each pair's longest common block, the first in a, then in b."""
    n = a.shape[1]
    run, best, at = np.zeros(b.shape, np.uint8), np.zeros(n, np.uint16), np.zeros(n, np.int64)
    rank = (63 - np.arange(len(b), dtype=np.uint16))[:, None]
    for i in range(len(a)):
        same = (b == a[i]).view(np.uint8)
        now = np.empty_like(run)
        now[0] = same[0]
        np.multiply(run[:-1] + np.uint8(1), same[1:], out=now[1:])
        run = now
        top = ((run.astype(np.uint16) << 6) | rank).max(axis=0)
        better = (top >> 6) > (best >> 6)
        best, at = np.where(better, top, best), np.where(better, i, at)
    size = (best >> 6).astype(np.int64)
    return at - size + 1, 63 - (best & 63).astype(np.int64) - size + 1, size


def matched(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, need: np.ndarray, end: int) -> np.ndarray:
    """Characters in the matcher's blocks of each pair (columns of a and b); pairs that cannot reach ``need`` may count less."""
    found = np.zeros(len(la), np.int64)
    pair, a0, a1, b0, b1 = np.arange(len(la)), np.zeros_like(la), la, np.zeros_like(lb), lb
    first = True
    while len(pair):
        if first:
            x, y = a, b
        else:
            i, j = np.arange((a1 - a0).max())[:, None], np.arange((b1 - b0).max())[:, None]
            x = np.where(i < a1 - a0, a[np.minimum(a0 + i, len(a) - 1), pair], a.dtype.type(0))
            y = np.where(j < b1 - b0, b[np.minimum(b0 + j, len(b) - 1), pair], b.dtype.type(end))
        first = False
        i, j, size = _longest(x, y)
        np.add.at(found, pair, size)
        i, j = i + a0, j + b0
        some = size > 0
        pair, a0, a1, b0, b1 = (np.concatenate([u[some], v[some]]) for u, v in ((pair, pair), (a0, i + size), (i, a1), (b0, j + size), (j, b1)))
        room = np.minimum(a1 - a0, b1 - b0)
        most = found + np.bincount(pair, weights=np.maximum(room, 0), minlength=len(la)).astype(np.int64)
        open_ = (room > 0) & (most >= need)[pair]
        pair, a0, a1, b0, b1 = (u[open_] for u in (pair, a0, a1, b0, b1))
    return found


def alike(a: Block, b: Block, threshold: float, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text of a, text of b, ratio) in parts, of all pairs with a ratio of at least ``threshold``; what difflib gives for them."""
    both = a.lengths[:, None] + b.lengths
    left, right = np.nonzero(2 * common_characters(a, b) >= threshold * both - 1e-9)
    if max(a.high, b.high) > LONG:
        matcher = SequenceMatcher()
        ratios = np.zeros(len(left))
        by_right = np.argsort(right, kind="stable")
        for k, at in enumerate(by_right):
            if k == 0 or right[at] != right[by_right[k - 1]]:
                matcher.set_seq2(b.texts[right[at]])
            matcher.set_seq1(a.texts[left[at]])
            ratios[at] = matcher.ratio()
        parts = [(left, right, ratios)]
    else:
        parts = []
        for k in range(0, len(left), PAIRS):
            u, v = left[k : k + PAIRS], right[k : k + PAIRS]
            la, lb = a.lengths[u], b.lengths[v]
            need = np.ceil(threshold * (la + lb) / 2 - 1e-9)
            m = matched(a.codes[:, u], la, b.codes[:, v], lb, need, end)
            parts.append((u, v, 2.0 * m / (la + lb)))
    for u, v, ratio in parts:
        good = ratio >= threshold
        if good.any():
            yield u[good], v[good], ratio[good]
