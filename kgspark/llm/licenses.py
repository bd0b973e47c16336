"""Licence scans by template markup.

A template is plain wording with optional regions (``<<beginOptional>>`` to
``<<endOptional>>``, nested at will) and replaceable ones
(``<<var;max=N;match=REGEX>>``: up to N words, each matching REGEX). It compiles to
a non-deterministic automaton over words whose subset states are made when first
met. A text is accepted where some run of its words is read from the first word of
the template to an accepting state, so mandatory wording must stand exactly, in
order and without gaps.

Beside the templates, three phrases are always counted ("base").
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytesops import LOWER, WORD, word_spans
from .common import doc_chunks, mapper, text_buffers

PHRASES = {"mit": (b"mit", b"license"), "apache": (b"apache", b"license"), "gpl": (b"general", b"public", b"license")}
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARK = re.compile(r"<<(beginOptional|endOptional|var)((?:;[^;>]*)*)>>")
_O, _E = "<<beginOptional>>", "<<endOptional>>"

TEMPLATES = {
    "Apache-2.0": f"licensed under the apache license {_O}version {_O}2.0{_E}{_E} {_O}the license you may not use {_O}this file{_E} except in compliance with the license{_E}",
    "GPL": f"{_O}this <<var;max=4>> is {_E}{_O}free software you can redistribute it and or modify it{_E} {_O}licensed{_E}{_O}released{_E} under the {_O}terms of the{_E} gnu {_O}lesser{_E}{_O}affero{_E} general public license {_O}as published by the free software foundation{_E} {_O}either{_E} {_O}version <<var;max=2;match=[0-9]+>>{_E} {_O}or any later version{_E}",
    "MIT-notice": f"{_O}released{_E}{_O}licensed{_E}{_O}distributed{_E} under the {_O}terms of the{_E} mit license",
    "MIT": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    f"the above copyright notice and this permission notice {_O}including the next paragraph{_E} shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the <<var;max=8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "ISC": f"permission to use copy modify and {_O}or{_E} distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "BSD": f"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {_O}1{_E} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer {_O}2{_E} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "CC-BY-NC": f"licensed under {_O}a{_E} {_O}the{_E} {_O}creative commons{_E} {_O}attribution noncommercial{_E}{_O}cc by nc{_E} <<var;max=2;match=[0-9]>> {_O}international{_E} {_O}license{_E}",
}


class Template:
    """One automaton; ``scan`` gives whether words hold it and the best share of its mandatory words.

    The share is that of the longest way from the template's beginning that some run of
    words goes, in mandatory words; 1 if it is held.
    """

    def __init__(self, name: str, markup: str, max_states: int = 50_000):
        self.name, self.max_states = name, max_states
        #: Transitions of state i: list of (literal or compiled pattern or None for any, target), and empty moves.
        self.moves: list[list[tuple[object, int]]] = [[]]
        self.skips: list[set[int]] = [set()]
        self.done = [0]  # mandatory words read on the way
        at, opens, last, mandatory = 0, [], 0, 0
        for mark in [*_MARK.finditer(markup), None]:
            for word in _WORDS.findall(markup[last : mark.start() if mark else None].lower().encode()):
                at, mandatory = self._new(at, word, mandatory + (not opens)), mandatory + (not opens)
            if mark is None:
                break
            last = mark.end()
            if mark[1] == "beginOptional":
                opens.append(at)
            elif mark[1] == "endOptional":
                self.skips[opens.pop()].add(at)
            else:
                how = dict(x.partition("=")[::2] for x in mark[2].split(";") if x)
                match = re.compile(how["match"].encode()) if "match" in how else None
                start = at
                steps = [at := self._new(at, match, mandatory) for _ in range(int(how.get("max", 1)))]
                for s in (start, *steps[:-1]):
                    self.skips[s].add(steps[-1])
        self.accept, self.mandatory = at, max(1, mandatory)
        self.sets: dict[frozenset[int], int] = {}
        self.by_id: list[frozenset[int]] = []
        self.delta: dict[tuple[int, bytes], int] = {}
        self.start = self._close({0})
        self.dead = frozenset()
        begins = [m for s in self.start for m, _ in self.moves[s]]
        #: Words that can begin it; None if it begins with a replaceable region or may be empty.
        self.first = set(begins) if begins and all(isinstance(m, bytes) for m in begins) and self.accept not in self.start else None

    def _new(self, at: int, on: object, done: int) -> int:
        self.moves.append([])
        self.skips.append(set())
        self.done.append(done)
        self.moves[at].append((on, len(self.moves) - 1))
        return len(self.moves) - 1

    def _close(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def step(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        key = (states, word)
        to = self.delta.get(key)
        if to is None:
            if len(self.delta) >= self.max_states:
                self.delta.clear()
            hit = {t for s in states for on, t in self.moves[s] if on is None or on == word or (not isinstance(on, bytes) and on.fullmatch(word))}
            to = self.delta[key] = self._close(hit) if hit else self.dead
        return to

    def scan(self, words: list[bytes]) -> tuple[bool, float]:
        best = 0
        for i, word in enumerate(words):
            if self.first is not None and word not in self.first:
                continue
            states, j = self.start, i
            while states:
                if self.accept in states:
                    return True, 1.0
                best = max(best, max(self.done[s] for s in states))
                if j == len(words):
                    break
                states, j = self.step(states, words[j]), j + 1
        return False, best / self.mandatory


def compile_templates(templates: dict[str, str] | None = None) -> list[Template]:
    return [Template(k, v) for k, v in (templates or TEMPLATES).items()]


def scan_words(words: list[bytes], templates: list[Template]) -> tuple[list[int], set[str], set[str], float]:
    """(starts of base phrases, base labels, the templates' labels, score)."""
    starts, base = [], set()
    for label, phrase in PHRASES.items():
        for i, w in enumerate(words):
            if w == phrase[0] and tuple(words[i : i + len(phrase)]) == phrase:
                starts.append(i)
                base.add(label)
    own, score = set(), 0.0
    for t in templates:
        hit, share = t.scan(words)
        score = max(score, share)
        if hit:
            own.add(t.name)
    return starts, base, own, score


def license_scan(df: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: base counts, labels and score. Null texts count as empty.

    Map-only. Words are counted with array operations; only texts that hold a word
    with which a phrase or template begins are cut into words.
    """

    def run(batches):
        compiled = compile_templates(templates)
        begins = {p[0] for p in PHRASES.values()}.union(*(t.first or () for t in compiled))
        anchors = re.compile(b"|".join(sorted(map(re.escape, begins))) if all(t.first is not None for t in compiled) else b"")
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            rows = []
            for i, j in doc_chunks(offsets):
                part, at = LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
                counts = np.bincount(word_spans(part, at, WORD)[2], minlength=j - i)
                raw = part.tobytes()
                for k in range(j - i):
                    text = raw[at[k] : at[k + 1]]
                    starts, base, own, score = [], set(), set(), 0.0
                    if anchors.search(text):
                        starts, base, own, score = scan_words(_WORDS.findall(text), compiled)
                    rows.append((int(counts[k]), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), score))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(mapper(run), schema)
