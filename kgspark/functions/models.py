"""Completion and embedding as batched functions, with deterministic offline stand-ins.

A completer maps a list of prompts to a list of answers, an embedder a list of texts to
unit vectors. Both run once an Arrow batch; a client is made once a worker process by its
factory and serves all later tasks there.
"""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import judge_label


class Completer(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


def rule_completer() -> Completer:
    """Offline stand-in: reads the last paragraph of the prompt, three words a sentence make a triple."""

    def run(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            parts = [re.findall(r"\w+", s) for s in re.split(r"[.!?\n]+", p.rpartition("\n\n")[2])]
            out.append("Triplets: " + repr([[w[0], w[1], w[-1]] for w in parts if len(w) >= 3]))
        return out

    return run


def hashing_embedder(dim: int = 64) -> Embedder:
    """Offline stand-in: signed hashed word counts, L2-normalised; empty texts are zero vectors."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for k, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                out[k, h % dim] += 1 if h & 0x8000_0000 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return run


def entity_completer() -> Completer:
    """Offline stand-in for entities: the distinct capitalised words of the prompt's last paragraph, in order."""

    def run(prompts: list[str]) -> list[str]:
        return ["Entities: " + repr(list(dict.fromkeys(re.findall(r"\b[A-Z]\w+", p.rpartition("\n\n")[2])))) for p in prompts]

    return run


def retried(factory: Callable[[], Completer], attempts: int = 2, wait: float = 0.5, double: bool = False, default: str | None = None, pause: float = 0.0) -> Callable[[], Completer]:
    """A completer that asks prompt by prompt and repeats a failed call after ``wait`` seconds (doubled each time if ``double``).

    After the last attempt the error is raised, or ``default`` is the answer. ``pause`` seconds between calls limit the rate.
    """

    def make() -> Completer:
        model = factory()

        def ask(prompt: str) -> str:
            for attempt in range(attempts):
                try:
                    return model([prompt])[0]
                except Exception:
                    if attempt + 1 == attempts and default is None:
                        raise
                    time.sleep(wait * (2**attempt if double else 1))
            return default

        def run(prompts: list[str]) -> list[str]:
            out = []
            for k, p in enumerate(prompts):
                if k and pause:
                    time.sleep(pause)
                out.append(ask(p))
            return out

        return run

    return make


def is_api_model(name: str) -> bool:
    """Models are called over an API exactly if their name holds "gpt"."""
    return "gpt" in name


def routed(name: str, api: Callable[[str], Completer], local: Callable[[str], Completer], prepend: str = "") -> Callable[[], Completer]:
    """The factory of a named model: an API client, or a local model whose answers begin with ``prepend``."""

    def make() -> Completer:
        if is_api_model(name):
            return api(name)
        model = local(name)
        return lambda prompts: [prepend + a for a in model(prompts)]

    return make


_CLIENTS: dict[str, Callable] = {}


def client(key: str, factory: Callable[[], Callable]) -> Callable:
    """The worker's one client for a factory; ``key`` tells factories apart."""
    if key not in _CLIENTS:
        _CLIENTS[key] = factory()
    return _CLIENTS[key]


def _mapped(df: DataFrame, column: str, out: str, kind: str, arrow: pa.DataType, call: Callable) -> DataFrame:
    at = df.columns.index(column)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    key = hashlib.sha256(cloudpickle.dumps(call)).hexdigest()

    def run(batches):
        model = client(key, call)
        for batch in batches:
            values = model([x or "" for x in batch.column(at).to_pylist()])
            values = values if isinstance(values, list) else [v.tolist() for v in values]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, f"{schema}, `{out}` {kind}")


def complete(df: DataFrame, prompt: str, out: str, factory: Callable[[], Completer] = rule_completer) -> DataFrame:
    return _mapped(df, prompt, out, "string", pa.string(), factory)


def embed(df: DataFrame, text: str, out: str, factory: Callable[[], Embedder] = hashing_embedder) -> DataFrame:
    return _mapped(df, text, out, "array<float>", pa.list_(pa.float32()), factory)


def embed_distinct(df: DataFrame, text: str, out: str, factory: Callable[[], Embedder] = hashing_embedder) -> DataFrame:
    """Like embed, with one model call a distinct text."""
    return df.join(embed(df.select(text).distinct(), text, out, factory), text, "left")


def judge(rows: DataFrame, message: str, out: str, factory: Callable[[], Completer], attempts: int = 3, pause: float = 0.0) -> DataFrame:
    """Add the label that a model gives to each message: three tries, waits of 1 and 2 seconds, UNSUPPORTED if all fail."""
    asked = complete(rows, message, "_raw", retried(factory, attempts, 1.0, double=True, default="UNSUPPORTED", pause=pause))
    return asked.withColumn(out, judge_label(F.col("_raw"))).drop("_raw")


def read_template(path: str) -> str:
    """A prompt template or few-shot file, read on the driver; names in braces are filled by ``prompt``."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def prompt(template: str, **values) -> F.Column:
    """A template with {names} filled from columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts) if p or i % 2))
