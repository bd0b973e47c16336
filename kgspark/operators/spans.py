"""Span scores of predicted against reference triples: exact, partial, strict and type schemes per slot.

Within an entry every prediction is scored against every reference, and the assignment
of the highest mean F1 is taken; what has no partner is scored against nothing. The words
of two slots are aligned by their longest common runs. The reference's words are one
span; each run of the prediction is a span over the same places, words before a run that
begins the reference or after one that ends it belong to that run, and other words of the
prediction are spans of their own beside it. Where two slots find nothing in each other,
they are compared crosswise, which finds switched roles with the wrong type. Word
splitting is on letters and digits.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import drop_qualifier, normalize_span

SLOTS = ("SUB", "PRED", "OBJ")
SCHEMES = ("strict", "exact", "partial", "ent_type")
COUNTS = ("correct", "incorrect", "partial", "missed", "spurious")


def words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def common_runs(ref: list[str], cand: list[str]) -> list[tuple[int, int, int]]:
    """(place in cand, place in ref, length) of common runs, the longest first, each word used once."""
    left_ref, left_cand = set(range(len(ref))), set(range(len(cand)))
    out: list[tuple[int, int, int]] = []
    for size in range(min(len(ref), len(cand)), 0, -1):
        for c in range(len(cand) - size + 1):
            if not left_cand.issuperset(range(c, c + size)):
                continue
            for r in range(len(ref) - size + 1):
                if ref[r : r + size] == cand[c : c + size] and left_ref.issuperset(range(r, r + size)):
                    out.append((c, r, size))
                    left_ref -= set(range(r, r + size))
                    left_cand -= set(range(c, c + size))
                    break
    return out


def slot_spans(ref: list[str], cand: list[str]) -> tuple[tuple[int, int] | None, list[tuple[int, int]], bool]:
    """(span of the reference, spans of the prediction, whether anything was found), as half-open places on one line."""
    runs = sorted(common_runs(ref, cand))
    whole = (0, len(ref)) if ref else None
    used = {k for c, _, n in runs for k in range(c, c + n)}
    before = after = 0
    if runs and runs[0][1] == 0:
        before = runs[0][0]
    if runs and runs[-1][1] + runs[-1][2] == len(ref):
        after = len(cand) - runs[-1][0] - runs[-1][2]
    spans = []
    for k, (_, r, n) in enumerate(runs):
        spans.append((r - (before if k == 0 else 0), r + n + (after if k == len(runs) - 1 else 0)))
    loose = [k for k in range(before, len(cand) - after) if k not in used]
    at = len(ref) + after + 1  # beside the reference
    for k, c in enumerate(loose):
        if k and loose[k - 1] == c - 1:
            spans[-1] = (spans[-1][0], at + 1)
        else:
            at += 1
            spans.append((at, at + 1))
        at += 1
    return whole, spans, bool(runs)


def outcomes(ref: tuple[int, int] | None, spans: list[tuple[int, int]], same: bool) -> dict[str, dict[str, int]]:
    """Counts of each scheme for one reference span and the prediction's; ``same``: their types agree."""
    out = {s: dict.fromkeys(COUNTS, 0) for s in SCHEMES}

    def add(**kinds: str) -> None:
        for scheme, kind in kinds.items():
            out[scheme][kind] += 1

    met = False
    for span in spans:
        if ref is None or span[1] <= ref[0] or span[0] >= ref[1]:
            add(strict="spurious", exact="spurious", partial="spurious", ent_type="spurious")
            continue
        met = True
        kind = "correct" if same else "incorrect"
        if span == ref:
            add(strict=kind, exact="correct", partial="correct", ent_type=kind)
        else:
            add(strict="incorrect", exact="incorrect", partial="partial", ent_type=kind)
    if ref is not None and not met:
        add(strict="missed", exact="missed", partial="missed", ent_type="missed")
    return out


def slot_counts(ref: list[list[str]], cand: list[list[str]]) -> list[dict[str, dict[str, int]]]:
    """For each slot of the reference, the counts of each scheme."""
    found = [slot_spans(r, c) for r, c in zip(ref, cand, strict=True)]
    with_slot = [0, 1, 2]
    for i, j in ((0, 2), (0, 1), (1, 2)):  # subject and object, subject and predicate, predicate and object
        if found[i][2] or found[j][2]:
            continue
        crossed = slot_spans(ref[i], cand[j]), slot_spans(ref[j], cand[i])
        if crossed[0][2] or crossed[1][2]:
            found[i], found[j] = crossed
            with_slot[i], with_slot[j] = j, i
            break
    return [outcomes(span, spans, with_slot[k] == k) for k, (span, spans, _) in enumerate(found)]


def rates(scheme: str, c: dict[str, int]) -> tuple[float, float, float]:
    """Precision, recall and F1; the partial and type schemes give half for a partial match."""
    gained = c["correct"] + (0.5 * c["partial"] if scheme in ("partial", "ent_type") else 0.0)
    actual, possible = c["correct"] + c["incorrect"] + c["partial"] + c["spurious"], c["correct"] + c["incorrect"] + c["partial"] + c["missed"]
    p, r = gained / actual if actual else 0.0, gained / possible if possible else 0.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def pair_score(slots: list[dict[str, dict[str, int]]]) -> float:
    """Mean F1 of the four schemes over all slots of a pair."""
    total = {s: {c: sum(slot[s][c] for slot in slots) for c in COUNTS} for s in SCHEMES}
    return sum(rates(s, total[s])[2] for s in SCHEMES) / len(SCHEMES)


def assign(score: list[list[float]]) -> list[int]:
    """For each row the column of a best assignment, or -1, by the Hungarian method on a padded square."""
    rows, cols = len(score), len(score[0]) if score else 0
    n = max(rows, cols)
    cost = [[-score[i][j] if i < rows and j < cols else 0.0 for j in range(n)] for i in range(n)]
    u, v, match, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while match[j0]:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    now = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if now < least[j]:
                        least[j], way[j] = now, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * rows
    for j in range(1, n + 1):
        if match[j] <= rows and j <= cols:
            out[match[j] - 1] = j - 1
    return out


def entry_pairs(reference: list[list[str]], predicted: list[list[str]]) -> list[list[dict[str, dict[str, int]]]]:
    """The slots' counts of each chosen pair of one entry; the shorter side is filled up with empty triples."""
    return word_pairs([[words(x) for x in t] for t in reference], [[words(x) for x in t] for t in predicted])


def word_pairs(refs: list[list[list]], cands: list[list[list]]) -> list[list[dict[str, dict[str, int]]]]:
    """The same from words; only which of them are equal matters."""
    n = max(len(refs), len(cands))
    none: list[list[str]] = [[], [], []]
    refs, cands = refs + [none] * (n - len(refs)), cands + [none] * (n - len(cands))
    pairs = [[slot_counts(r, c) for r in refs] for c in cands]
    chosen = assign([[pair_score(p) for p in row] for row in pairs]) if n else []
    return [pairs[i][j] for i, j in enumerate(chosen)]


def paired_lines(predicted: DataFrame, gold: DataFrame, key: str = "line_ix", max_length_diff: int | None = None) -> DataFrame:
    """(key, predicted, gold): lines of both, without those whose prediction has an item that is not three strings, or whose lengths differ by more."""
    both = predicted.select(key, F.col("triples").alias("predicted")).join(gold.select(key, F.col("triples").alias("gold")), key)
    good = F.forall("predicted", lambda t: (F.size(t) == 3) & ~F.exists(t, lambda e: e.isNull()))
    out = both.where(good)
    return out if max_length_diff is None else out.where(F.abs(F.size("predicted") - F.size("gold")) <= max_length_diff)


def plain_letters(c: F.Column) -> F.Column:
    """Latin letters without their marks, by a translation of those of Unicode's Latin-1 and Latin Extended-A blocks."""
    marked = [chr(k) for k in range(0xC0, 0x180) if len(unicodedata.normalize("NFKD", chr(k))[0]) == 1 and unicodedata.normalize("NFKD", chr(k))[0].isascii()]
    return F.translate(c, "".join(marked), "".join(unicodedata.normalize("NFKD", x)[0] for x in marked))


def span_triple(triple: F.Column) -> F.Column:
    """The three parts in the scorer's form; the object without one bracketed end."""
    form = lambda x: plain_letters(normalize_span(x))
    return F.array(form(triple[0]), form(triple[1]), drop_qualifier(form(triple[2])))


def pattern(reference: list[list[str]], predicted: list[list[str]]) -> str:
    """An entry with its words numbered by first occurrence; entries of one pattern have the same scores."""
    numbers: dict[str, int] = {}
    number = lambda triples: [[[numbers.setdefault(w, len(numbers)) for w in words(x)] for x in t] for t in triples]
    return json.dumps([number(reference), number(predicted)], separators=(",", ":"))


def span_scores(entries: DataFrame, reference: str, predicted: str) -> DataFrame:
    """(scheme, slot, counts, possible, actual, precision, recall, f1): sums of counts and means of the chosen pairs' rates; slot ALL joins the three.

    Entries are counted by pattern, and each pattern is scored once.
    """
    schema = "array<struct<scheme:string,slot:string," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"

    def patterns(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pattern(r, p) for r, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.string())], ["pattern"])

    @F.pandas_udf(schema)
    def score(told: pd.Series) -> pd.Series:
        def one(text):
            out = []
            for pair in word_pairs(*json.loads(text)):
                for s in SCHEMES:
                    whole = {c: sum(slot[s][c] for slot in pair) for c in COUNTS}
                    out += [{"scheme": s, "slot": name} | counts for name, counts in [("ALL", whole), *zip(SLOTS, (slot[s] for slot in pair), strict=True)]]
            return out

        return pd.Series([one(x) for x in told])

    counted = entries.select(reference, predicted).mapInArrow(patterns, "pattern string").groupBy("pattern").agg(F.count("*").alias("n"))
    both = counted.select("n", F.explode(score("pattern")).alias("x")).select("n", "x.*")
    gained = F.col("correct") + F.when(F.col("scheme").isin("partial", "ent_type"), 0.5 * F.col("partial")).otherwise(0.0)
    both = both.withColumns({"actual": F.col("correct") + F.col("incorrect") + F.col("partial") + F.col("spurious"), "possible": F.col("correct") + F.col("incorrect") + F.col("partial") + F.col("missed")})
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = both.withColumns({"p": zero(F.try_divide(gained, "actual")), "r": zero(F.try_divide(gained, "possible"))}).withColumn("f", zero(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))))
    mean = lambda c, name: F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 6).alias(name)
    return both.groupBy("scheme", "slot").agg(*(F.sum(F.col(c) * F.col("n")).alias(c) for c in (*COUNTS, "possible", "actual")), mean("p", "precision"), mean("r", "recall"), mean("f", "f1"))
