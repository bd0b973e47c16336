"""Column functions for labels, sentences, table headers, prompts and similarities. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SECTION_MARKS = ("[SECTION_START]", "[SECTION_END]", "[TABLE_JSON_START]", "[TABLE_JSON_END]")
BULLET = r"^\s*([-*•]|\d+\.)\s+"


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with ``value`` evaluated once a row, however often f uses it, also inside of lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def collapse(c: Column) -> Column:
    """White space runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_label(c: Column) -> Column:
    """Language tags, quotes, camel case, acronyms, signs and case reduced to lower-case words."""
    c = F.btrim(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"(?i)@[a-z]{2,3}(-[a-z0-9]+)?$", ""), F.lit("\"'"))
    c = F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", " ")
    c = F.regexp_replace(c, r"(?<=[A-Z])(?=[A-Z][a-z])", " ")
    c = F.regexp_replace(F.replace(c, F.lit("&"), F.lit(" and ")), r"[_\-/]+", " ")
    return collapse(F.regexp_replace(F.lower(F.replace(c, F.lit("ß"), F.lit("ss"))), r"[^a-z0-9\s]", " "))


def normalize_span(c: Column) -> Column:
    """Label form of the span scorer: camel case split, lower case, underscores to blanks."""
    return collapse(F.replace(F.lower(F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2")), F.lit("_"), F.lit(" ")))


def drop_qualifier(c: Column) -> Column:
    """Without one trailing bracketed qualifier."""
    return F.regexp_replace(c, r"\s*\([^()]*\)$", "")


def sentences(c: Column) -> Column:
    return F.filter(F.split(collapse(c), r"(?<=[.!?])\s+"), lambda s: s != "")


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def normalize_text(c: Column) -> Column:
    """Lines trimmed; blank ones and section marks dropped."""
    lines = F.transform(F.split(newlines(c), "\n"), strip)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.isin(*SECTION_MARKS)), "\n")


def section_prefix(title: Column) -> Column:
    return F.concat(F.lit("SECTION_TITLE: "), F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled Section")), F.lit("\nCONTENT:\n"))


def is_bullet(c: Column) -> Column:
    return c.rlike(BULLET)


def clean_cell(c: Column) -> Column:
    return collapse(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))


def normalize_header(c: Column, index: Column) -> Column:
    low = F.lower(clean_cell(c))
    return F.replace(F.regexp_replace(F.when(low == "", F.concat(F.lit("column_"), index.cast("string"))).otherwise(low), r"[^a-z0-9_ ]", ""), F.lit(" "), F.lit("_"))


def fix_spaced_word(c: Column) -> Column:
    """A lone capital joins the word after it; white space is Unicode's."""
    return F.regexp_replace(c, r"\b([A-Z])[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+([a-z][a-zA-Z]+)\b", "$1$2")


def local_name(c: Column) -> Column:
    return F.regexp_extract(c, r"[^#/:]+$", 0)


def looks_like_title(c: Column) -> Column:
    words = F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))
    return (F.length(c) <= 120) & ~c.endswith(".") & ~c.rlike(r"^(-|•|o )") & words.between(1, 12)


def token_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = token_set(a), token_set(b)
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(both, F.size(F.array_union(x, y))), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(c: Column) -> Column:
    norm = F.sqrt(dot(c, c))
    return F.transform(c, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def definitions(c: Column) -> Column:
    """Map of the lines ``name: text``; the line "Answer" is skipped, a later line of a name wins."""
    lines = F.filter(F.split(c, "\n"), lambda x: x.contains(":"))
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substring(x, F.locate(":", x) + 1, F.length(x))).alias("value"))
    pairs = F.filter(F.transform(lines, pair), lambda x: (x.key != "Answer") & (x.key != "") & (x.value != ""))
    placed = F.sort_array(F.transform(pairs, lambda x, i: F.struct(x.key.alias("key"), i.alias("i"), x.value.alias("value"))))
    last = bind(placed, lambda s: F.filter(s, lambda x, i: ~F.coalesce(F.get(s, i + 1).key == x.key, F.lit(False))))
    return F.map_from_entries(F.transform(F.sort_array(F.transform(last, lambda x: F.struct(x.i, x.key, x.value))), lambda x: F.struct(x.key, x.value)))


def choice_list(candidates: Column) -> Column:
    """Lettered choices from structs (relation, definition), and the way out."""
    lines = F.transform(candidates, lambda x, i: F.concat(F.char(65 + i), F.lit(". '"), x.relation, F.lit("': "), x.definition, F.lit("\n")))
    return F.concat(F.array_join(lines, ""), F.char(F.size(candidates) + 65), F.lit(". None of the above.\n"))


def choice(candidates: Column, answer: Column) -> Column:
    """The candidate that an answer's first letter names, or null."""
    return F.get(candidates, F.ascii(F.substring(answer, 1, 1)) - 65)


def judge_label(c: Column) -> Column:
    up = F.upper(strip(c))
    exact = up.isin("SUPPORTED", "PARTIALLY_SUPPORTED", "UNSUPPORTED")
    return F.when(exact, up).when(up.contains("PARTIALLY"), "PARTIALLY_SUPPORTED").when(up.contains("UNSUPPORTED"), "UNSUPPORTED").when(up.contains("SUPPORTED"), "SUPPORTED").otherwise("UNSUPPORTED")


def literal(c: Column) -> Column:
    """A string as a Python literal: single quotes unless only those occur within."""
    out = F.coalesce(c, F.lit(""))
    for sign, escape in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(sign), F.lit(escape))
    single = F.concat(F.lit("'"), F.replace(out, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(c.contains("'") & ~c.contains('"'), F.concat(F.lit('"'), out, F.lit('"'))).otherwise(single)


def judge_message(subject: Column, predicate: Column, object_: Column, snippet: Column, reason: Column) -> Column:
    """What a judge is asked about a triple: its parts quoted, why it is novel, at most 600 characters of its source."""
    text = strip(F.coalesce(snippet, F.lit("")))
    triple = F.concat(F.lit("Triple: ["), literal(subject), F.lit(", "), literal(predicate), F.lit(", "), literal(object_), F.lit("]"))
    why = F.when(F.coalesce(reason, F.lit("")) != "", F.concat(F.lit("Novelty reason: "), reason))
    source = F.when(text == "", "(No source text snippet available.)").otherwise(F.concat(F.lit('Source text snippet:\n"""\n'), F.substring(text, 1, 600), F.lit('\n"""')))
    return F.concat_ws("\n", triple, why, source)


def text_to_embed(relation: Column, definition: Column, with_name: bool = True) -> Column:
    return F.concat(relation, F.lit(": "), definition) if with_name else definition


def snippet(c: Column, most: int = 500) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, most)




def sample_id(line: Column, s: Column, p: Column, o: Column) -> Column:
    return F.concat_ws("|", line.cast("string"), s, p, o)
