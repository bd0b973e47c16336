"""Parsers of model output and literal files, as pandas functions where SQL has no counterpart."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIPLES = "array<array<string>>"
_TRIPLES = T.ArrayType(T.ArrayType(T.StringType()))


def literal_triples(c: Column, strip: bool = True) -> Column:
    """Triples of a list literal in JSON or single-quoted form; the slow parser runs only where the fast one fails.

    The fast one keeps white space within strings; so does the slow one unless ``strip``.
    """
    fast = F.from_json(c, TRIPLES, {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})
    return F.coalesce(fast, F.when(fast.isNull() & c.isNotNull(), _literal(c) if strip else _literal_raw(c)))


def _strings(text: str, strip: bool) -> list[list[str]] | None:
    try:
        value = ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None
    if not isinstance(value, (list, tuple)):
        return []
    return [[str(x).strip() if strip else str(x) for x in t] for t in value if isinstance(t, (list, tuple))]


@F.pandas_udf(_TRIPLES)
def _literal(values: pd.Series) -> pd.Series:
    return values.map(lambda t: _strings(t, True))


@F.pandas_udf(_TRIPLES)
def _literal_raw(values: pd.Series) -> pd.Series:
    return values.map(lambda t: _strings(t, False))


def bracket_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of balanced square brackets in the order in which they close."""
    opened, out = [], []
    for at, sign in enumerate(text):
        if sign == "[":
            opened.append(at)
        elif sign == "]" and opened:
            out.append((opened.pop(), at + 1))
    return out


def completion_triples(text: str) -> list[list[str]]:
    """Three-string lists found anywhere in a completion. Lists that mix kinds keep their length, inner lists joined."""
    out = []
    for a, b in bracket_spans(text):
        try:
            items = ast.literal_eval(text[a:b])
            plain = [isinstance(x, str) for x in items]
            if len(items) == 3 and all(plain):
                if not {"", "_"} & set(items):
                    out.append(items)
            elif items and len({type(x) for x in items}) > 1:
                out.append([", ".join(x) if isinstance(x, list) else x for x in items])
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
    return [[x if isinstance(x, str) else str(x) for x in t] for t in out]


@F.pandas_udf(_TRIPLES)
def parse_completion(values: pd.Series) -> pd.Series:
    return values.map(lambda t: completion_triples(t or ""))


def entities(c: Column) -> Column:
    """The first bracketed list of strings; null without brackets, empty if it can't be read."""
    inner = F.regexp_extract(c, r"\[[^\]]*\]", 0)
    read = F.from_json(inner, "array<string>", {"allowSingleQuotes": "true"})
    return F.when(inner != "", F.coalesce(read, F.array().cast("array<string>")))


def sections_of(text: str) -> list[dict]:
    """Sections of marked-up text; without marks the non-blank lines are one untitled section."""
    found: list[dict] = []
    now: dict | None = None
    content = table = False
    lines = (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")

    def close(at: int) -> None:
        nonlocal now
        if now is not None:
            found.append(now | {"end_line": at})
        now = None

    for at, raw in enumerate(lines):
        line = raw.strip()
        if now is None:
            if line == "[SECTION_START]":
                now = {"title": "", "content": [], "tables": [], "start_line": at}
                content = table = False
            continue
        if table:
            if line == "[TABLE_JSON_END]":
                table = False
                now["tables"][-1]["end_line"] = at
            else:
                now["tables"][-1]["lines"].append(raw)
        elif line == "[SECTION_END]":
            close(at)
        elif line.startswith("TITLE:"):
            now["title"] = line[6:].strip() or now["title"]
        elif line == "[TABLE_JSON_START]":
            table = True
            now["tables"].append({"lines": [], "start_line": at, "end_line": at})
        elif line == "CONTENT:":
            content = True
        elif content:
            now["content"].append(raw)
    close(len(lines) - 1)
    if not found:
        return [{"title": "Untitled Section", "content": [x for x in lines if x.strip()], "tables": [], "start_line": 0, "end_line": len(lines) - 1}]
    return found


STAGE_SCHEMA = "index bigint, doc_id string, chunk_id string, section_title string, input_text string, oie array<array<string>>, schema_definition map<string,string>, schema_canonicalization array<array<string>>, schema_canonicalizaiton array<array<string>>, useful_triplets array<array<string>>"


def to_literal(triples: list[list[str]]) -> str:
    return json.dumps(triples, ensure_ascii=False)
