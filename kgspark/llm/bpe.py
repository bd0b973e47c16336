"""Byte-level BPE by a lazily determinised finite-state transducer.

The rank table is compiled into a transducer over bytes. A state is the last
token that was emitted and the bytes still undecided. A merge table has the
property that a token sequence is the encoding of its bytes exactly when every
neighbouring pair of its tokens is the encoding of *their* bytes, so the last
token of each prefix is unique. A byte is read, the last token of the longer
prefix is found, and all tokens on which every possible continuation agrees are
emitted; continuations are the pending suffixes that still are prefixes of a
token, so lookahead is bounded by the longest token. States and transitions are
made when first taken, and dropped together once there are ``MAX_STATES``.

Most pieces are words that come once and would make states that no other piece
meets. Pieces of up to ``SHORT`` bytes run on the transducer as it is before it is
determinised: its states are tokens, its moves the tokens that can follow. The
path to a place is unique, so trying longer tokens first and going back where no
token follows reads no place twice.

Decoding streams token bytes through an incremental UTF-8 decoder.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .chunks import PartCoder
from .common import mapper, text_buffers

MAX_STATES = 200_000
MAX_PAIRS = 1_000_000
SHORT = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Bytes in, token ids out; one instance serves any number of strings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.size = {v: len(k) for k, v in ranks.items()}
        self.prefixes = {k[:i] for k in ranks for i in range(1, len(k))}
        #: what a token can begin with: its rank if it is a token, else -1
        self.heads = dict.fromkeys(self.prefixes, -1) | ranks
        self._pairs: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        #: (last emitted token, undecided bytes, last token of each prefix, cuts of each prefix as bits,
        #: where a token that reaches past the bytes can start)
        self.states: list[tuple] = [(-1, b"", (), (1,), ())]
        self.index: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self.delta: dict[int, tuple[int, tuple[int, ...]]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Plain merging by lowest rank; only for pairs of tokens, which are short."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def follows(self, a: int, b: int) -> bool:
        """Whether token b can stand after token a (-1: the start) in an encoding."""
        key = ((a + 1) << 32) | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= MAX_PAIRS:
                self._pairs.clear()
            both = [b] if a < 0 else [a, b]
            known = self._pairs[key] = self.merge(b"".join(self.bytes_of[x] for x in both)) == both
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, pending, last, cuts, starts = self.states[state]
        pending += bytes((byte,))
        n = len(pending)
        ranks, pairs, size = self.ranks, self._pairs, self.size
        token, going = None, []
        for i in (*starts, n - 1):
            tail = pending[i:]
            if token is None and (found := ranks.get(tail)) is not None:
                ahead = last[i - 1] if i else before
                fits = pairs.get((ahead + 1) << 32 | found)
                if self.follows(ahead, found) if fits is None else fits:
                    token = found
            if tail in self.prefixes:
                going.append(i)
        if token is None:
            raise ValueError("the rank table lacks a byte")
        common = cuts[n - size[token]] | 1 << n
        last += (token,)
        cuts += (common,)
        for j in going:
            common &= cuts[j]
        cut = common.bit_length() - 1
        out: tuple[int, ...] = ()
        if cut:
            at = cut
            while at:
                out = (last[at - 1], *out)
                at -= size[last[at - 1]]
            before, pending, last = out[-1], pending[cut:], last[cut:]
            cuts, going = tuple([c >> cut for c in cuts[cut:]]), [j - cut for j in going]
        key = (before, pending)
        to = self.index.get(key)
        if to is None:
            to = self.index[key] = len(self.states)
            self.states.append((before, pending, last, cuts, tuple(going)))
        return to, out

    def walk(self, piece: bytes) -> list[int]:
        """The encoding by the transducer before it is determinised."""
        heads, pairs, size, n = self.heads, self._pairs, self.size, len(piece)
        out: list[int] = []
        untried: list[list[int]] = []
        at, before = 0, -1
        while at < n:
            here = []  # tokens that start here, the longest last
            for end in range(at + 1, n + 1):
                found = heads.get(piece[at:end])
                if found is None:
                    break
                if found >= 0:
                    here.append(found)
            while True:
                if here:
                    token = here.pop()
                    fits = pairs.get((before + 1) << 32 | token)
                    if self.follows(before, token) if fits is None else fits:
                        break
                elif out:
                    at -= size[out.pop()]
                    before, here = out[-1] if out else -1, untried.pop()
                else:
                    raise ValueError("the rank table lacks a byte")
            out.append(token)
            untried.append(here)
            at, before = at + size[token], token
        return out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) <= SHORT:
            return self.walk(piece)
        if len(self.states) > MAX_STATES:
            self._reset()
        out: list[int] = []
        state, delta = 0, self.delta
        for byte in piece:
            key = state << 8 | byte
            move = delta.get(key)
            if move is None:
                move = delta[key] = self._step(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        _, pending, last, _, _ = self.states[state]
        tail, at = [], len(pending)
        while at:
            tail.append(last[at - 1])
            at -= self.size[last[at - 1]]
        return out + tail[::-1]


class ByteBpe:
    """Encoder and streaming decoder for a rank file and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.parts = PartCoder(lambda parts: list(map(self._part, parts)), strip=False)
        self.vocabulary = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.vocabulary[v] = k

    def _part(self, part: bytes) -> bytes:
        ids = [i for piece in self.pattern.findall(part.decode()) for i in self.transducer.encode(piece.encode())]
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        return next(self.parts.documents(data, np.array([0, len(data)]))).tolist()

    def decode_stream(self, ids: Iterable[int], block: int = 4096) -> Iterator[str]:
        """Text as soon as its bytes are complete; ids may cut a character anywhere."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        of, ids = self.vocabulary.__getitem__, iter(ids)
        while held := list(islice(ids, block)):
            yield machine.decode(b"".join(map(of, held)))
        yield machine.decode(b"", final=True)


_OPEN: dict[tuple[str, str], ByteBpe] = {}


def bpe(path: str, pattern: str) -> ByteBpe:
    """One encoder a worker process and rank file."""
    if (path, pattern) not in _OPEN:
        _OPEN[path, pattern] = ByteBpe(load_ranks(path), pattern)
    return _OPEN[path, pattern]


def bpe_digest(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text, decode it again, and return the digests of both.

    One row per input row; a null text counts as empty and has no tokens. Map-only:
    a worker holds one Arrow batch, the rank table and bounded memos.
    """

    def run(batches):
        coder = bpe(path, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in coder.parts.documents(*text_buffers(batch.column(1))):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                sha = hashlib.sha256()
                for text in coder.decode_stream(ids.tolist()):
                    sha.update(text.encode())
                text_sha.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(mapper(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
