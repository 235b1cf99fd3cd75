"""RDFS inference: the schema is closed first, then one join a rule over the data.

The schema (subClassOf, subPropertyOf, domain, range) is bounded by `most_schema` triples and its closure
by `most_closure` pairs, both checked; it is closed on the driver and broadcast. What is larger is
refused, not cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ntriples import RDF_TYPE

RDFS = "http://www.w3.org/2000/01/rdf-schema#"
SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE = (f"<{RDFS}{x}>" for x in ("subClassOf", "subPropertyOf", "domain", "range"))
ALL = ("domain", "range", "subclass", "subproperty")


def closed(pairs: set[tuple[str, str]], most: int) -> set[tuple[str, str]]:
    """Transitive closure; more than `most` pairs are refused as soon as they are met."""
    up: dict[str, set[str]] = {}
    for a, b in pairs:
        up.setdefault(a, set()).add(b)
    out = set()
    for a in up:
        todo, seen = list(up[a]), set()
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += up.get(b, ())
        out |= {(a, b) for b in seen}
        if len(out) > most:
            raise ValueError(f"the closure of the schema has more than {most} pairs")
    return out


def infer(triples: DataFrame, schema: list[tuple[str, str, str]] | None = None, rules: tuple[str, ...] = ALL, most_schema: int = 100_000, most_closure: int = 1_000_000) -> DataFrame:
    """The triples that the rules add to triples (and schema), each once, none that is asserted."""
    spark = triples.sparkSession
    own = triples.where(F.col("p").isin(SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE)).limit(most_schema + 1).collect()
    known = {(r.s, r.p, r.o) for r in own} | set(schema or [])
    if len(known) > most_schema:
        raise ValueError(f"the schema has more than {most_schema} triples")
    pairs = {p: {(s, o) for s, q, o in known if q == p} for p in (SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE)}
    wide_p = closed(pairs[SUB_PROPERTY], most_closure) if "subproperty" in rules else set()
    wide_c = closed(pairs[SUB_CLASS], most_closure) if "subclass" in rules else set()
    all_p = wide_p | {(p, p) for q in (DOMAIN, RANGE) for p, _ in pairs[q]}
    above: dict[str, set[str]] = {}
    for a, b in wide_c:
        above.setdefault(a, set()).add(b)

    def typed(kind: str) -> list[tuple[str, str]]:
        of: dict[str, set[str]] = {}
        for p, c in pairs[kind]:
            of.setdefault(p, set()).update({c} | above.get(c, set()))
        out: set[tuple[str, str]] = set()
        for p, q in all_p:
            out |= {(p, c) for c in of.get(q, ())}
            if len(out) > most_closure:
                raise ValueError(f"the closure of the schema has more than {most_closure} pairs")
        return sorted(out)

    def small(rows: list, columns: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(rows, columns))  # at most most_closure rows

    parts = []
    if wide_p:
        parts.append(triples.join(small(sorted(wide_p), "p string, q string"), "p").select("s", F.col("q").alias("p"), "o"))
    if "domain" in rules and (rows := typed(DOMAIN)):
        parts.append(triples.join(small(rows, "p string, c string"), "p").select("s", F.lit(RDF_TYPE).alias("p"), F.col("c").alias("o")))
    if "range" in rules and (rows := typed(RANGE)):
        parts.append(triples.where(~F.col("o").startswith('"')).join(small(rows, "p string, c string"), "p").select(F.col("o").alias("s"), F.lit(RDF_TYPE).alias("p"), F.col("c").alias("o")))
    if wide_c:
        parts.append(triples.where(F.col("p") == RDF_TYPE).join(small(sorted(wide_c), "o string, c string"), "o").select("s", "p", F.col("c").alias("o")))
        parts.append(spark.createDataFrame(sorted((a, SUB_CLASS, b) for a, b in wide_c if (a, SUB_CLASS, b) not in known), "s string, p string, o string"))
    if wide_p:
        parts.append(spark.createDataFrame(sorted((a, SUB_PROPERTY, b) for a, b in wide_p if (a, SUB_PROPERTY, b) not in known), "s string, p string, o string"))
    if not parts:
        return triples.limit(0).select("s", "p", "o")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct().join(triples.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
