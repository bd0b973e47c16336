"""Suffix-array dedup, BPE, packing and media columns against plain versions."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from .conftest import DATA, both, edge_rows, plain

from kgspark.llm import bpe, chunks, media, packing, suffix_dedup


def removed(rows, length=100):
    """Brute force: rows in order (nulls first, ties by text); a byte goes if a string over it has started before."""
    seen, out = set(), []
    for d, t in sorted(((d, t) for d, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_suffix_edges(edge):
    want = both([r[:5] for r in removed(edge_rows())])
    assert plain(suffix_dedup.suffix_digest(edge), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_suffix_many_parts(spark, edge, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 1 << 15)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1 << 16)
    want = both([r[:5] for r in removed(edge_rows())])
    assert plain(suffix_dedup.suffix_digest(edge), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_suffix_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = both([r[:5] for r in removed([(r.doc_id, r.text) for r in docs.collect()])])
    assert plain(suffix_dedup.suffix_digest(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_suffix_dedup_keeps_columns(edge):
    out = suffix_dedup.suffix_dedup(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    ascii_rows = {(r[0], r[5].decode()) for r in removed(edge_rows()) if r[5].isascii()}
    got = {(r.doc_id, r.text or "") for r in out.collect() if (r.text or "").isascii()}
    assert got == ascii_rows


def test_suffix_rows_of_a_bucket(monkeypatch):
    """A bucket tells each part once, however many steps it takes, and buckets widen with the text."""
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 1 << 11)
    rng = np.random.default_rng(2)
    passages = [rng.integers(97, 123, 300).astype(np.uint8) for _ in range(40)]
    table = pa.table({"doc_id": pa.array(range(80)), "text": [p.tobytes().decode() for p in passages] * 2})
    steps = suffix_dedup._Steps("doc_id", "text", 100, 1)
    rows = []
    for part in range(8):
        mine, runs = steps._open(table.slice(part * 10, 10))
        firsts = runs.offsets[runs.docs] + runs.starts
        text = runs.data[suffix_dedup._expand(firsts, runs.counts + 99)]
        ids = mine.column("doc_id").to_numpy()[runs.docs]
        rows.append(suffix_dedup._row(part, 0, keys=runs.keys, ids=ids, nulls=np.zeros(len(ids), bool), docs=runs.docs.astype(np.int32), starts=runs.starts, counts=runs.counts.astype(np.uint16), text=text))
    got = steps.matches((0,), suffix_dedup._wide(rows)).to_pylist()
    assert [r["part"] for r in got] == [4, 5, 6, 7]
    for r in got:
        gone = np.zeros((10, 300), bool)
        for d, a, b in zip(*(np.frombuffer(r[c], k).tolist() for c, k in (("span_docs", np.int32), ("span_starts", np.int64), ("span_ends", np.int64))), strict=True):
            gone[d, a:b] = True
        assert gone.all()
    parts, buckets = suffix_dedup.dealt(10 << 30)
    assert parts == 5120 and buckets == 160 and suffix_dedup.dealt(100 << 20) == (50, 13)


def test_level_index_is_logarithmic():
    index, rng = suffix_dedup.LevelIndex(), np.random.default_rng(0)
    known = {}
    for batch in range(64):
        keys = np.unique(rng.integers(0, 1 << 60, 100, dtype=np.uint64))
        index.add(keys, np.full(len(keys), batch))
        known |= dict.fromkeys(keys.tolist(), batch)
    assert len(index.levels) <= 8
    some = np.array(sorted(known), np.uint64)
    assert index.scan(some).tolist() == [known[k] for k in some.tolist()]
    assert (index.scan(some + np.uint64(1)) == -1).sum() >= len(some) - 1


def test_empty(spark, edge):
    none = edge.limit(0)
    assert suffix_dedup.suffix_digest(none).count() == 0
    assert bpe.bpe_digest(none, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    assert packing.pack_documents(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert media.media_digest(none).count() == 0


def library():
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("which", ["edge", "table"])
def test_bpe(spark, edge, which):
    docs = edge if which == "edge" else spark.read.parquet(f"{DATA}/documents.parquet")
    lib = library()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = lib.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = bpe.bpe_digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert plain(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == both(want)


def test_coders_tell_texts_with_polynomial_collisions_apart():
    from tokenizers import Tokenizer

    path, lib = public_tokenizers.path("word_bpe_49k.json"), library()
    words, coder, word_lib = packing.WordTokenizer(path), bpe.bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), Tokenizer.from_file(path)
    for n in (1024, 2048, 4096):
        for flip in (0, 1):
            text = "".join("ab"[bin(i).count("1") + flip & 1] for i in range(n))
            assert coder.encode(text) == lib.encode_ordinary(text)
            assert words.encode(text) == word_lib.encode(text, add_special_tokens=False).ids
    for text in ("hello <|endoftext|> there", "a<|startoftext|><|endoftext|>b", "<|ENDOFTEXT|>", "don't<|endoftext|>'s"):
        assert words.encode(text) == word_lib.encode(text, add_special_tokens=False).ids


def test_coder_without_a_hash(monkeypatch):
    """If all parts shared one hash, their bytes would still tell them apart."""
    monkeypatch.setattr(chunks, "spans_hash", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    coder, lib = bpe.ByteBpe(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN), library()
    for text in ("one two three two one", "été, 12 été\n", ""):
        assert coder.encode(text) == lib.encode_ordinary(text)


def test_bpe_random_bytes_and_streams():
    coder, lib, rng = bpe.bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), library(), random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("aeiou tnsr\n'.,1é日\U0001f600　ß") for _ in range(rng.randint(0, 60)))
        ids = coder.encode(text)
        assert ids == lib.encode_ordinary(text)
        assert "".join(coder.decode_stream(ids, block=1)) == text


def test_bpe_words_that_come_once():
    """They make no states; both forms of the transducer give the library's ids, at all lengths."""
    coder, lib, rng = bpe.ByteBpe(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN), library(), random.Random(4)
    machine = coder.transducer
    text = " ".join("".join(rng.choice(["th", "ing", "er", "tion", "q", "é", "日"]) for _ in range(rng.randint(2, 6))) for _ in range(3000))
    assert coder.encode(text) == lib.encode_ordinary(text)
    assert len(machine.states) == 1
    for n in (*range(1, 90), 1000, 5000):
        for letters in ("aeioutnsr", "ab", "x", "né日"):
            word = "".join(rng.choice(letters) for _ in range(n))
            assert machine.walk(word.encode()) == machine.encode(word.encode()) == lib.encode_ordinary(word)
    assert len(machine.states) > 1


def test_words_are_tokenised_together():
    from tokenizers import Tokenizer

    class Counting:
        def __init__(self, inner):
            self.inner, self.calls = inner, 0

        def encode(self, *args, **kwargs):
            self.calls += 1
            return self.inner.encode(*args, **kwargs)

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(6)
    lib, words = Tokenizer.from_file(path), packing.WordTokenizer(path)
    words.tokenizer = Counting(words.tokenizer)
    once = ["".join(rng.choice(["th", "ing", "er", "tion", "q", "é", "ß", "日"]) for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = "  ".join(once) + "\n12 don't, " + "x" * 500 + " E\u0301te\u0301"
    assert words.encode(text) == lib.encode(text, add_special_tokens=False).ids
    assert words.tokenizer.calls < 100
    every = [chr(c) for c in range(0x110000) if chr(c).isalpha()]  # some become several pieces
    for some in (every, ["a" + c + "b" for c in rng.sample(every, 20_000)]):
        text = " ".join(some)
        assert words.encode(text) == lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("which", ["edge", "table"])
def test_packing(spark, edge, which):
    from tokenizers import Tokenizer

    docs = edge if which == "edge" else spark.read.parquet(f"{DATA}/documents.parquet")
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    want, total = [], 0
    for r in docs.select("doc_id", "text").collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want.append((r.doc_id, k, a, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    out = packing.pack_documents(docs, path)
    rows = out.collect()
    assert both([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]) == both(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= packing.lower_bound(np.array([w[3] for w in want])) + 1


def test_packing_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 64)
    rng = np.random.default_rng(1)
    lengths = np.concatenate([rng.integers(1, 4097, 1500), rng.integers(1, 400, 1500)]).tolist()
    items = spark.createDataFrame([(k, 0, 0, int(n), k) for k, n in enumerate(lengths)], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint").withColumn("row", F.col("doc_id"))
    rows = packing.pack_pieces(items, group_items=64).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    fill = defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096
    assert len(fill) <= packing.lower_bound(np.array(lengths)) * 1.02 + 1


def test_packing_equal_rows(spark, monkeypatch):
    """Rows that are equal in all columns are dealt to all partitions."""
    monkeypatch.setattr(packing, "GROUP_ITEMS", 64)
    docs = spark.range(2000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    rows = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(rows) == 2000 and len({(r.sequence_id, r.offset) for r in rows}) == 2000 and len({r.sequence_id for r in rows}) == 1


def test_lower_bound_is_sound():
    rng = random.Random(2)
    for _ in range(60):
        lengths = np.array([rng.randint(1, 20) for _ in range(rng.randint(1, 9))])
        best = len(lengths)

        def search(i, rooms, best):
            if len(rooms) >= best:
                return best
            if i == len(lengths):
                return len(rooms)
            for k, room in enumerate(rooms):
                if room >= lengths[i]:
                    best = min(best, search(i + 1, [*rooms[:k], room - lengths[i], *rooms[k + 1 :]], best))
            return min(best, search(i + 1, [*rooms, 20 - lengths[i]], best))

        assert packing.lower_bound(lengths, 20) <= search(0, [], best + 1)


def test_media(edge):
    rows = {r.doc_id: r for r in media.media_digest(edge).collect()}
    assert media.media_digest(edge).count() == edge.count()
    for d, t, *_ in edge_rows():
        if d is None or sum(1 for x in edge_rows() if x[0] == d) > 1:
            continue
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = rows[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r.media_bytes > r.payload_bytes and r.feature.startswith("raw;")


def test_media_keyframes_and_damage():
    payload = bytes(range(192)) * 1000
    data = media.write_media(payload, key_every=300)
    track = media.read_tables(data)[0]
    assert media.read_payload(data, track) == payload
    assert [b - a for a, b in track["key_ranges"]] == [192] * 4 and track["count"] == 1000
    assert data[track["key_ranges"][1][0] :][:192] == payload[300 * 192 : 301 * 192]
    for cut in (len(data) - 1, 40):
        with pytest.raises(ValueError):
            list(media.walk(data[:cut]))
    with pytest.raises(ValueError):
        media.write_media(b"abc")
