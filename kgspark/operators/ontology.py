"""Ontologies: a tokenizer for Turtle, named classes of domains and ranges, closures, definitions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..sources.scratch import checkpointed

_TOKEN = re.compile(r'"""(?:[^"\\]|\\.|"(?!""))*"""(?:@[\w-]+|\^\^\S+)?|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^[^\s;,.\]]+)?|<[^>]*>|@prefix|@base|[\[\]();,]|\.(?=\s|$)|#[^\n]*|[^\s\[\]();,]*[^\s\[\]();,.]')
_RDF = "rdf:"


def parse_turtle(text: str) -> list[tuple[str, str, str, str]]:
    """(subject, predicate, object, kind) statements; kind is uri, blank or literal. Reads prefixes, lists, blank nodes."""
    tokens = [t for t in _TOKEN.findall(text) if not t.startswith("#")]
    out: list[tuple[str, str, str, str]] = []
    prefixes: dict[str, str] = {}
    at = blanks = 0

    def fresh() -> str:
        nonlocal blanks
        blanks += 1
        return f"_:b{blanks}"

    def term() -> tuple[str, str]:
        nonlocal at
        token = tokens[at]
        at += 1
        if token == "[":
            node = fresh()
            statements(node, "]")
            at += 1
            return node, "blank"
        if token == "(":
            head = last = ""
            while tokens[at] != ")":
                node = fresh()
                if last:
                    out.append((last, _RDF + "rest", node, "blank"))
                head, last = head or node, node
                value, kind = term()
                out.append((node, _RDF + "first", value, kind))
            at += 1
            if last:
                out.append((last, _RDF + "rest", _RDF + "nil", "uri"))
            return head or _RDF + "nil", "blank" if head else "uri"
        if token.startswith('"'):
            body = re.match(r'"""(.*)"""|"(.*)"', token, re.S)
            return (body[1] if body[1] is not None else body[2]).replace('\\"', '"').replace("\\n", "\n"), "literal"
        if token.startswith("<"):
            return token[1:-1], "uri"
        if token == "a":
            return _RDF + "type", "uri"
        if token.startswith("_:"):
            return token, "blank"
        name, colon, rest = token.partition(":")
        if colon and name in prefixes and name not in ("rdf", "rdfs", "owl"):
            return prefixes[name] + rest, "uri"
        return token, "uri" if colon else "literal"

    def statements(subject: str, end: str) -> None:
        nonlocal at
        while at < len(tokens) and tokens[at] != end:
            if tokens[at] == ";":
                at += 1
                continue
            predicate = term()[0]
            while True:
                value, kind = term()
                out.append((subject, predicate, value, kind))
                if at < len(tokens) and tokens[at] == ",":
                    at += 1
                    continue
                break

    while at < len(tokens):
        if tokens[at] in ("@prefix", "@base"):
            if tokens[at] == "@prefix":
                prefixes[tokens[at + 1].rstrip(":")] = tokens[at + 2][1:-1]
            while tokens[at] != ".":
                at += 1
            at += 1
            continue
        subject = term()[0]
        statements(subject, ".")
        at += 1
    return out


def read_turtle(files: DataFrame, text_col: str = "value") -> DataFrame:
    """(s, p, o, kind) of whole Turtle files, one a row."""

    def run(batches):
        for batch in batches:
            rows = [r for t in batch.column(0).to_pylist() for r in parse_turtle(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=["s", "p", "o", "kind"])

    return files.select(text_col).mapInArrow(run, "s string, p string, o string, kind string")


def closure(links: DataFrame, start: str = "child", end: str = "parent", max_rounds: int = 64) -> DataFrame:
    """Transitive closure of (start, end) by doubling: as many rounds as the logarithm of the longest path."""
    known = checkpointed(links.select(start, end).where(f"{start} is not null and {end} is not null").distinct())
    size = known.count()
    for _ in range(max_rounds):
        step = known.select(F.col(start).alias("_a"), F.col(end).alias("_m")).join(known.select(F.col(start).alias("_m"), F.col(end).alias("_b")), "_m").select(F.col("_a").alias(start), F.col("_b").alias(end))
        known = checkpointed(known.union(step).distinct())
        now = known.count()
        if now == size:
            return known
        size = now
    raise RuntimeError("closure did not end")


def union_members(statements: DataFrame) -> DataFrame:
    """(node, member) of named members of unionOf and intersectionOf lists, nested ones too."""
    hops = statements.where(F.col("p").isin("owl:unionOf", "owl:intersectionOf", "rdf:first", "rdf:rest") & F.col("s").startswith("_:")).select(F.col("s").alias("child"), F.col("o").alias("parent"))
    reached = closure(hops)
    return reached.where(~F.col("parent").startswith("_:") & ~F.col("parent").startswith("rdf:")).select(F.col("child").alias("node"), F.col("parent").alias("member"))


def gold_triples(statements: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(subject, predicate, object): named domain classes x named range classes of each object property."""
    from ..functions.text import local_name

    props = statements.where((F.col("p") == "rdf:type") & (F.col("o") == "owl:ObjectProperty")).select(F.col("s").alias("prop")).distinct()
    members = union_members(statements)

    def side(predicate: str, name: str) -> DataFrame:
        direct = statements.where(F.col("p") == predicate).join(props, F.col("s") == F.col("prop")).select("prop", F.col("o").alias("c"), "kind")
        named = direct.where("kind = 'uri'").select("prop", F.col("c").alias(name))
        return named.union(direct.where("kind = 'blank'").join(members, F.col("c") == F.col("node")).select("prop", F.col("member").alias(name))).distinct()

    pairs = side("rdfs:domain", "d").join(side("rdfs:range", "r"), "prop")
    if names is not None:
        look = lambda c: (names.select(F.col("uri").alias("_u" + c), F.col("name").alias("_n" + c)), F.coalesce(F.col("_n" + c), local_name(F.col(c))))
        for c in ("d", "r"):
            table, value = look(c)
            pairs = pairs.join(table, F.col(c) == F.col("_u" + c), "left").withColumn(c, value)
    else:
        pairs = pairs.withColumns({c: local_name(F.col(c)) for c in ("d", "r")})
    return pairs.select(F.col("d").alias("subject"), local_name(F.col("prop")).alias("predicate"), F.col("r").alias("object")).distinct()


def subclass_triples(statements: DataFrame, names: DataFrame) -> DataFrame:
    """(subject, predicate, object) of rdfs:subClassOf between two named classes. names: uri, name."""
    n = names.select("uri", "name").distinct()
    sub = statements.where(F.col("p") == "rdfs:subClassOf").join(n.select(F.col("uri").alias("s"), F.col("name").alias("subject")), "s")
    both = sub.join(n.select(F.col("uri").alias("o"), F.col("name").alias("object")), "o")
    return both.select("subject", F.lit("subClassOf").alias("predicate"), "object").distinct()


def name_overlap(system: DataFrame, gold: DataFrame, column: str = "relation") -> DataFrame:
    """One row: distinct names of either side and of both."""
    a, b = system.select(column).distinct(), gold.select(column).distinct()
    marked = a.withColumn("a", F.lit(True)).join(b.withColumn("b", F.lit(True)), column, "full")
    return marked.agg(F.count("a").alias("system"), F.count("b").alias("gold"), F.count_if(F.col("a") & F.col("b")).alias("overlap"))


def definition_lists(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """(key, definitions): all definitions of a key in order."""
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]).alias("definitions"))


def longest_comment(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """(key, definition, warning): the longest comment after collapsing white space, ties by order; keys without one warn."""
    clean = rows.select(key, F.nullif(collapse(F.col(text)), F.lit("")).alias("t"), F.col(order).alias("o"))
    best = clean.groupBy(key).agg(F.min(F.when(F.col("t").isNotNull(), F.struct((-F.length("t")).alias("n"), "o", "t"))).alias("b"))
    return best.select(key, F.col("b.t").alias("definition"), F.when(F.col("b").isNull(), F.lit("no comment")).alias("warning"))


def relation_name_ok(c: Column) -> Column:
    return ~c.contains("?") & (~c.startswith("rel") | c.startswith("relTo"))


def longest(df: DataFrame, key: str, text: str) -> DataFrame:
    """The longest text of each key after collapsing white space, ties by text; blank ones do not count."""
    clean = df.select(key, collapse(F.col(text)).alias("t")).where("t <> ''")
    best = clean.groupBy(key).agg(F.min(F.struct((-F.length("t")).alias("n"), "t")).alias("b"))
    return best.select(key, F.col("b.t").alias("definition"))


def last_definition(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """(ord, key, text): the last text of each key at the place where the key first stood."""
    return rows.groupBy(key).agg(F.min(order).alias("ord"), F.max_by(text, order).alias(text)).select("ord", key, text)
