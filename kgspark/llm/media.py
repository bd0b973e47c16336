"""Media columns: documents' bytes kept as raw 8-bit video in an ISO base media file.

The writer stores a payload as frames of 192 bytes (16 x 12 grey samples) of a
`raw ` video track. The reader walks nested boxes by their headers, decodes the
sample tables, and reports codec, duration and key-frame byte ranges without
touching a sample. Truncated, looping or undersized boxes raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapper

UNIT = 192
FRAMES_PER_CHUNK = 256
TIMESCALE = 600
FRAME_TICKS = 25
#: Boxes that hold other boxes, and the bytes of their own before the first child.
NESTED = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def pad(payload: bytes, unit: int = UNIT) -> bytes:
    """Append bytes 32 up to a positive multiple of ``unit``."""
    return payload + b" " * (max(1, -(-len(payload) // unit)) * unit - len(payload))


def write_media(payload: bytes, unit: int = UNIT, key_every: int = 1) -> bytes:
    """A file whose samples are ``payload`` cut into ``unit`` bytes; its length must be a multiple."""
    if not payload or len(payload) % unit:
        raise ValueError(f"payload of {len(payload)} bytes is no positive multiple of {unit}")
    frames = len(payload) // unit
    chunks = -(-frames // FRAMES_PER_CHUNK)
    last = frames - (chunks - 1) * FRAMES_PER_CHUNK
    ticks = frames * FRAME_TICKS
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    runs = [(1, FRAMES_PER_CHUNK, 1)] if chunks > 1 else []
    if not runs or last != FRAMES_PER_CHUNK:
        runs.append((chunks, last, 1))
    entry = _box(
        b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 16,
        struct.pack(">HHIIIH", 16, 12, 0x480000, 0x480000, 0, 1), b"\0" * 32, struct.pack(">Hh", 8 + 32, -1),
    )
    keys = [] if key_every == 1 else [_full(b"stss", struct.pack(f">I{-(-frames // key_every)}I", -(-frames // key_every), *range(1, frames + 1, key_every)))]

    def moov(first: int) -> bytes:
        places = [first + i * FRAMES_PER_CHUNK * unit for i in range(chunks)]
        wide = places[-1] >= 1 << 32
        table = _box(
            b"stbl", _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, frames, FRAME_TICKS)), *keys,
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", unit, frames)),
            _full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *places)),
        )
        media = _box(
            b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0)),
            _full(b"hdlr", b"\0" * 4, b"vide", b"\0" * 12, b"bytes\0"),
            _box(b"minf", _full(b"vmhd", b"\0" * 8, flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
        )
        track = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, ticks), b"\0" * 16, _MATRIX, struct.pack(">II", 16 << 16, 12 << 16), flags=7)
        header = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), b"\0" * 10, _MATRIX, b"\0" * 24, struct.pack(">I", 2))
        return _box(b"moov", header, _box(b"trak", track, media))

    size = len(moov(0))
    head = len(payload) + 8 >= 1 << 32
    start = len(ftyp) + size + (16 if head else 8)
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if head else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return b"".join([ftyp, moov(start), mdat, payload])


def walk(data: bytes, start: int = 0, end: int | None = None, depth: int = 0):
    """Yield (path depth, kind, body start, body end) of every box, parents before children."""
    end = len(data) if end is None else end
    if depth > 16:
        raise ValueError("boxes nest too deep")
    while start < end:
        if end - start < 8:
            raise ValueError(f"{end - start} stray bytes at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError(f"cut box header at {start}")
            (size,), body = struct.unpack_from(">Q", data, body), start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has size {size}, {end - start} bytes are left")
        yield depth, kind, body, start + size
        if kind in NESTED:
            yield from walk(data, body + NESTED[kind], start + size, depth + 1)
        start += size


def read_tables(data: bytes) -> list[dict]:
    """One dict a track: codec, timescale, duration, sample count, byte ranges of samples and key frames."""
    tracks: list[dict] = []
    for _, kind, a, b in walk(data):
        if kind == b"trak":
            tracks.append({})
        if not tracks:
            continue
        t = tracks[-1]
        if kind == b"hdlr":
            t["handler"] = data[a + 8 : a + 12].decode("latin-1")
        elif kind == b"mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
        elif kind == b"stsd":
            t["codec"] = data[a + 12 : a + 16].decode("latin-1") if struct.unpack_from(">I", data, a + 4)[0] else ""
        elif kind == b"stts":
            (n,) = struct.unpack_from(">I", data, a + 4)
            t["stts"] = list(struct.iter_unpack(">II", data[a + 8 : a + 8 + 8 * n]))
        elif kind == b"stss":
            (n,) = struct.unpack_from(">I", data, a + 4)
            t["keys"] = struct.unpack_from(f">{n}I", data, a + 8)
        elif kind == b"stsc":
            (n,) = struct.unpack_from(">I", data, a + 4)
            t["stsc"] = list(struct.iter_unpack(">III", data[a + 8 : a + 8 + 12 * n]))
        elif kind == b"stsz":
            fixed, n = struct.unpack_from(">II", data, a + 4)
            t["count"], t["fixed"] = n, fixed
            t["sizes"] = None if fixed else struct.unpack_from(f">{n}I", data, a + 12)
        elif kind in (b"stco", b"co64"):
            (n,) = struct.unpack_from(">I", data, a + 4)
            t["places"] = struct.unpack_from(f">{n}{'I' if kind == b'stco' else 'Q'}", data, a + 8)
    for t in tracks:
        t["ranges"], t["key_ranges"] = _ranges(t)
    return tracks


def _ranges(t: dict) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Merged byte ranges of all samples in sample order, and those of the key frames."""
    places, runs, count = t.get("places", ()), t.get("stsc", ()), t.get("count", 0)
    keys = t.get("keys")
    marked = None if keys is None else set(keys)
    whole: list[list[int]] = []
    sync: list[list[int]] = []

    def put(into: list[list[int]], a: int, b: int) -> None:
        if into and into[-1][1] == a:
            into[-1][1] = b
        elif b > a:
            into.append([a, b])

    sample, run = 0, 0
    for chunk, at in enumerate(places, 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= chunk:
            run += 1
        n = min(runs[run][1] if runs else 0, count - sample)
        if t["fixed"] and marked is None:  # every sample is a key frame of one size
            put(whole, at, at + n * t["fixed"])
            put(sync, at, at + n * t["fixed"])
        else:
            for i in range(sample, sample + n):
                size = t["fixed"] or t["sizes"][i]
                put(whole, at, at + size)
                if marked is None or i + 1 in marked:
                    put(sync, at, at + size)
                at += size
        sample += n
    if sample != count:
        raise ValueError(f"chunks hold {sample} samples, the size table has {count}")
    return [tuple(x) for x in whole], [tuple(x) for x in sync]


def read_payload(data: bytes, track: dict) -> bytes:
    out = b"".join(data[a:b] for a, b in track["ranges"])
    if len(out) != sum(b - a for a, b in track["ranges"]):
        raise ValueError("samples lie past the end of the file")
    return out


def feature(track: dict) -> str:
    """Codec, duration in seconds and key-frame byte ranges, as text."""
    seconds = track["duration"] / track["timescale"] if track.get("timescale") else 0.0
    ranges = ",".join(f"{a}-{b}" for a, b in track["key_ranges"])
    return f"{track['codec'].strip()};{seconds:.6f}s;{track['count']};{ranges}"


def media_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as media, read it back, and describe both.

    One row per input row, in any order; repeated ids give repeated rows. A null
    or empty text is one frame of blanks. Map-only: memory is one text and its
    file at a time, whatever the table's size.
    """

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0), []
            for value in batch.column(1):
                raw = (value.as_py() or "").encode()
                media = write_media(pad(raw))
                track = read_tables(media)[0]
                back = read_payload(media, track)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(track)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(mapper(run), schema)
