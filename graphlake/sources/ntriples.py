"""Triples: the projection of a graph, N-Triples text in and out, a Turtle subset for small schemas.

A term is one string as N-Triples writes it: <iri>, "literal" or _:blank; so equal strings are equal
terms, and a literal never equals an IRI.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escaped_literal, iri
from ..model import PropertyGraph

BASE = "https://example.org/"
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
#: s, p, o of an N-Triples line.
LINE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*\.\s*(?:#.*)?$'


def literal(c: F.Column) -> F.Column:
    return F.concat(F.lit('"'), escaped_literal(c), F.lit('"'))


def triples(graph: PropertyGraph, base: str = BASE, properties: bool = True, types: bool = True, data: bool = False) -> DataFrame:
    """(s, p, o): relationships as rel/<label>; properties as prop/<key>; types; payloads as data."""
    parts = [graph.edges.select(iri(base, "node", F.col("src")).alias("s"), iri(base, "rel", F.col("label")).alias("p"), iri(base, "node", F.col("dst")).alias("o"))]
    for name, df in graph.tables.items():
        s = iri(base, "node", F.col("rid")).alias("s")
        keys = [k for k in df.columns if k not in ("rid", "data")]
        if types and name:
            parts.append(df.select(s, F.lit(RDF_TYPE).alias("p"), F.lit(f"<{base}type/{name}>").alias("o")))
        elif types and "type" in keys:
            parts.append(df.where("type is not null").select(s, F.lit(RDF_TYPE).alias("p"), iri(base, "type", F.col("type")).alias("o")))
        if properties and keys:
            pairs = F.array(*(F.struct(F.lit(f"<{base}prop/{k}>").alias("p"), literal(F.col(k).cast("string")).alias("o")) for k in keys))
            parts.append(df.select(s, F.inline(F.filter(pairs, lambda x: x["o"].isNotNull()))))
        if data and "data" in df.columns:
            parts.append(df.where("data is not null").select(s, F.lit(f"<{base}data>").alias("p"), literal(F.col("data")).alias("o")))
    return reduce(DataFrame.unionByName, parts)


def lines(rows: DataFrame) -> DataFrame:
    """(value): one line a triple, for write.text."""
    return rows.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))


def parse_lines(text: DataFrame) -> DataFrame:
    """(s, p, o) of N-Triples lines (column value); comments, blank and broken lines are left out."""
    found = text.select(*(F.regexp_extract("value", LINE, i).alias(c) for i, c in ((1, "s"), (2, "p"), (3, "o"))))
    return found.where("s <> ''")


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


TURTLE = re.compile(r'\s*(?:#[^\n]*|(?P<iri><[^>]*>)|(?P<str>"(?:[^"\\]|\\.)*")(?:\^\^(?P<dt>\S+?(?=[\s;,.\])])))?|(?P<num>[+-]?\d+(?:\.\d+)?)|(?P<op>[;,.\[\]()])|(?P<name>@?[A-Za-z_][\w-]*(?::[\w-]*)?|:[\w-]+|_:\w+))')
PREFIXES = {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "sh": "http://www.w3.org/ns/shacl#", "xsd": "http://www.w3.org/2001/XMLSchema#", "owl": "http://www.w3.org/2002/07/owl#"}


def parse_turtle(text: str, base: str = BASE) -> list[tuple[str, str, str]]:
    """Triples of a Turtle subset: prefixes, a, lists of objects and predicates, blank nodes, collections.

    For schemas and shapes, which are small; data comes as N-Triples.
    """
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TURTLE.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"unexpected {text[at : at + 20]!r}")
        if m.lastgroup:
            kind = next(k for k in ("iri", "str", "num", "op", "name") if m[k])
            tokens.append((kind, m[kind]))
        at = m.end()
    prefixes, out, fresh, i = dict(PREFIXES), [], 0, 0

    def term() -> str:
        nonlocal i, fresh
        kind, t = tokens[i]
        i += 1
        if kind == "iri":
            return t if ":" in t else f"<{base}{t[1:-1]}>"
        if kind == "str":
            return t
        if kind == "num":
            return f'"{t}"'
        if t == "[":
            fresh += 1
            node = f"_:b{fresh}"
            predicates(node)
            i += 1  # ]
            return node
        if t == "(":
            items = []
            while tokens[i][1] != ")":
                items.append(term())
            i += 1
            fresh += 1
            node = f"_:b{fresh}"
            out.extend((node, "<list:item>", x) for x in items)
            return node
        if t == "a":
            return RDF_TYPE
        if t in ("true", "false"):
            return f'"{t}"'
        if t.startswith("_:"):
            return t
        prefix, _, local = t.partition(":")
        if prefix not in prefixes:
            raise ValueError(f"unknown prefix {prefix}")
        return f"<{prefixes[prefix]}{local}>"

    def predicates(s: str) -> None:
        nonlocal i
        while i < len(tokens) and tokens[i][1] not in (".", "]"):
            p = term()
            while True:
                out.append((s, p, term()))
                if i < len(tokens) and tokens[i][1] == ",":
                    i += 1
                    continue
                break
            while i < len(tokens) and tokens[i][1] == ";":
                i += 1

    while i < len(tokens):
        if tokens[i][1].lower() in ("@prefix", "prefix"):
            prefixes[tokens[i + 1][1].rstrip(":").split(":")[0]] = tokens[i + 2][1][1:-1]
            i += 3
            if i < len(tokens) and tokens[i][1] == ".":
                i += 1
            continue
        predicates(term())
        i += 1
    return out
