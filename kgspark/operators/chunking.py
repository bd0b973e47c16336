"""Chunks of documents: baseline windows in SQL functions, structure-aware chunks a document at a time."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import sections_of
from ..functions.text import BULLET, bind, collapse, newlines, sentences, strip

#: Chunks leave a task's worker after so many characters of documents.
PART_LETTERS = 1 << 20
CHUNK = "chunk_id string, section_id string, section_title string, chunk_type string, text string, span_start int, span_end int, merged boolean"


def windows(items: Column, size: int, overlap: int) -> Column:
    """Sliding windows of an array; the last ones may be shorter."""
    step = max(1, size - overlap)

    def cut(a: Column) -> Column:
        starts = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.least(i + size, F.size(a)).alias("end"), F.slice(a, i + 1, F.lit(size)).alias("items")))

    return bind(items, cut)  # else the items would be made again for every window


def sentence_windows(df: DataFrame, text: str = "text", size: int = 4, overlap: int = 1) -> DataFrame:
    """The rows exploded to (chunk_ix, start_sentence, end_sentence, chunk)."""
    return _numbered(df, windows(sentences(F.col(text)), size, overlap), "start_sentence", "end_sentence", lambda x: F.array_join(x["items"], " "))


def groups(df: DataFrame, items: Column, size: int, sep: str = "\n") -> DataFrame:
    """Tumbling groups of an array."""
    return _numbered(df, windows(items, size, 0), "start_item", "end_item", lambda x: F.array_join(x["items"], sep))


def _numbered(df: DataFrame, wins: Column, start: str, end: str, text) -> DataFrame:
    return df.select("*", F.posexplode(wins).alias("chunk_ix", "_w")).select("*", F.col("_w.start").alias(start), F.col("_w.end").alias(end), text(F.col("_w")).alias("chunk")).drop("_w")


def char_windows(df: DataFrame, text: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Slices of characters, trimmed; blank ones are left out and the rest numbered."""
    step = max(1, size - overlap)
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(starts, lambda i: F.struct(i.alias("start_char"), F.least(i + size, n).alias("end_char"), strip(F.substring(F.col(text), i + 1, F.lit(size))).alias("chunk")))
    return df.select("*", F.posexplode(F.filter(parts, lambda p: p.chunk != "")).alias("chunk_ix", "_w")).select("*", "_w.*").drop("_w")


def pack_by_length(lines: list[str], most: int, overlap: int = 1) -> list[list[str]]:
    """Runs of lines of at most ``most`` characters with their separators; each run starts ``overlap`` lines before the last's end.

    A run has at least its first line. Where runs end follows from prefix sums, by bisection.
    """
    upto = [0, *accumulate(len(x) + 1 for x in lines)]
    out, start = [], 0
    while start < len(lines):
        stop = max(start + 1, bisect_right(upto, upto[start] + most + 1) - 1)
        out.append(lines[start:stop])
        start = len(lines) if stop == len(lines) else max(start + 1, stop - max(0, overlap))
    return out


def _prefix(title: str) -> str:
    return f"SECTION_TITLE: {title or 'Untitled Section'}\nCONTENT:\n"


_TEXTUAL = {"section_bullets", "section_prose"}
_POOR_TITLE = re.compile(r"\b(footer|header|caption|metamodel view|title)\b")
_POOR_TEXT = re.compile(r"\b(caption|metamodel view)\b")


def _split_long(prefix: str, units: list[str], sep: str, most: int) -> list[str]:
    whole = prefix + sep.join(units)
    if len(whole) <= most:
        return [whole]
    return [prefix + sep.join(g) for g in pack_by_length(units, max(200, most - len(prefix)))]


def section_chunks(number: int, section: dict, size: int, overlap: int, bullets: int, rows: int, most: int) -> list[dict]:
    title, prefix, out = section["title"], _prefix(section["title"]), []

    def add(kind: str, text: str, a: int, b: int) -> None:
        out.append({"section_id": f"sec_{number:04d}", "section_title": title, "chunk_type": kind, "text": text, "span_start": a, "span_end": b, "merged": False})

    for t in section["tables"]:
        body = [x for x in t["lines"] if x.strip()]
        if len(body) <= rows:
            add("table_json", prefix + "\n".join(body), t["start_line"], t["end_line"])
        else:
            for a in range(0, len(body), rows):
                add("table_rows", prefix + "\n".join(body[a : a + rows]), a, min(a + rows, len(body)))
    lines = [x.strip() for x in section["content"] if x.strip()]
    marked = [x for x in lines if re.match(BULLET, x)]
    if 2 * len(marked) > len(lines):
        for a in range(0, len(marked), bullets):
            part = marked[a : a + bullets]
            for text in _split_long(prefix, part, "\n", most):
                add("section_bullets", text, a, a + len(part))
    elif lines:
        flat = " ".join(" ".join(lines).split())
        units = [s for s in re.split(r"(?<=[.!?])\s+", flat) if s]
        for a in range(0, len(units), max(1, size - overlap)):
            part = units[a : a + size]
            for text in _split_long(prefix, part, " ", most):
                add("section_prose", text, a, a + len(part))
    return out


def _joined(left: dict, right: dict) -> dict:
    a, b = left["text"].strip(), right["text"].strip()
    if left["section_id"] == right["section_id"]:
        b = b.removeprefix(_prefix(right["section_title"])).lstrip() if b.startswith(_prefix(right["section_title"])) else b
    return left | {"text": "\n".join(x for x in (a, b) if x), "merged": True}


class _Merger:
    """The rules by which short chunks join, for a least and a most length."""

    def __init__(self, least: int, most: int):
        self.least, self.room = least, most + max(120, int(0.35 * most))

    @staticmethod
    def size(chunk: dict) -> int:
        return len(chunk["text"].strip())

    def short(self, chunk: dict) -> bool:
        return chunk["chunk_type"] in _TEXTUAL and self.size(chunk) < self.least

    def join(self, left: dict, right: dict) -> dict | None:
        """Both as one chunk with what describes the left one, or None if they must stay apart."""
        textual = {left["chunk_type"], right["chunk_type"]} <= _TEXTUAL
        if not textual or left["section_id"] != right["section_id"] or self.size(left) + self.size(right) + 1 > self.room:
            return None
        return _joined(left, right)

    def poor(self, chunk: dict) -> bool:
        body = chunk["text"].removeprefix(_prefix(chunk["section_title"])).strip().lower()
        return self.short(chunk) and bool(_POOR_TITLE.search(chunk["section_title"].strip().lower()) or _POOR_TEXT.search(body))


def merge_short(chunks: list[dict], least: int, most: int) -> list[dict]:
    """Short text chunks join the one before, else, once, the one after, of their section; poor ones that stay short go.

    First each short chunk is offered to what stands before it; in the result a short
    one waits for its successor.
    """
    if least <= 0:
        return chunks
    rules = _Merger(least, most)

    offered: list[dict] = []
    for chunk in chunks:
        one = rules.join(offered[-1], chunk) if offered and rules.short(chunk) else None
        if one is None:
            offered.append(chunk)
        else:
            offered[-1] = one
    settled: list[dict] = []
    waiting: dict | None = None
    for chunk in [*offered, None]:
        one = rules.join(waiting, chunk) if waiting and chunk else None
        if one:
            settled.append(one)
            waiting = None
            continue
        if waiting:
            settled.append(waiting)
        waiting = chunk if chunk and rules.short(chunk) else None
        if chunk and not waiting:
            settled.append(chunk)
    return [c for c in settled if not rules.poor(c)]


def document_chunks(doc_id: str, text: str, size: int = 4, overlap: int = 1, bullets: int = 6, rows: int = 25, most: int = 1000, least: int = 120) -> list[dict]:
    chunks = [c for k, s in enumerate(sections_of(text)) for c in section_chunks(k, s, size, overlap, bullets, rows, most)]
    return [c | {"chunk_id": f"{doc_id}::chunk_{k:05d}"} for k, c in enumerate(merge_short(chunks, least, most))]


def adaptive_chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(id, chunk_ix, chunk fields) of each document's structure-aware chunks; documents are independent."""

    kinds = dict(df.dtypes)
    fields = pa.schema([("chunk_ix", pa.int32()), *((f.split()[0], {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[f.split()[1]]) for f in CHUNK.split(", "))])

    def run(batches):
        for batch in batches:
            ids, names, texts = batch.columns
            rows: list[dict] = []
            places: list[int] = []
            letters = 0
            for k in range(len(batch)):  # texts one by one, rows by so many letters: a batch's texts and chunks are not held as objects
                text = texts[k].as_py()
                made = document_chunks(names[k].as_py(), text, **settings)
                rows += [c | {"chunk_ix": i} for i, c in enumerate(made)]
                places += [k] * len(made)
                letters += len(text or "")
                if rows and (letters >= PART_LETTERS or k == len(batch) - 1):
                    table = pa.Table.from_pylist(rows, fields).combine_chunks()
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(places)), *(c.chunk(0) for c in table.columns)], [id_col, *fields.names])
                    rows, places, letters = [], [], 0

    return df.select(id_col, F.col(id_col).cast("string").alias("_name"), text_col).mapInArrow(run, f"{id_col} {kinds[id_col]}, chunk_ix int, {CHUNK}")


def chunk_lines(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.replace(strip(F.col("text")), F.lit("\n"), F.lit(" ")).alias("value"))


def marked_up(title: Column, body: Column) -> Column:
    """A one-section document in the marked form that the adaptive chunker reads."""
    return F.concat(F.lit("[SECTION_START]\nTITLE: "), title, F.lit("\nCONTENT:\n"), newlines(body), F.lit("\n[SECTION_END]"))


def chunk_stats(chunks: DataFrame, text: str = "chunk") -> DataFrame:
    n = F.length(text)
    return chunks.agg(F.count("*").alias("chunks"), F.round(F.avg(n), 6).alias("avg_chars"), F.max(n).cast("bigint").alias("max_chars"), F.min(n).cast("bigint").alias("min_chars"))


__all__ = ["adaptive_chunks", "char_windows", "chunk_lines", "chunk_stats", "collapse", "document_chunks", "groups", "marked_up", "merge_short", "pack_by_length", "sentence_windows", "windows"]
