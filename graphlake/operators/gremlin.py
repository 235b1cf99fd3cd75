"""A fluent traversal language: a list of steps, folded over a DataFrame of traversers.

A traverser is (current, path array<long>, bulk, value). Each step is a filter, a projection or one
join; nothing runs until the result is read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph
from .traverse import expand


def equals(c: Column, kind: str, value: object) -> Column:
    """Equality of values: null equals null, a string is never a number, and an integer never a fraction."""
    if value is None:
        return c.isNull()
    kinds = {bool: ("boolean",), str: ("string",), int: ("int", "bigint", "smallint", "tinyint"), float: ("double", "float", "decimal")}[type(value)]
    same = F.coalesce(c == F.lit(value), F.lit(False))
    return same if kind.startswith(kinds) else F.lit(False)


@dataclass(frozen=True)
class Traversal:
    graph: PropertyGraph
    steps: tuple[tuple, ...] = field(default=())

    def then(self, *step: object) -> Traversal:
        return Traversal(self.graph, (*self.steps, step))

    def V(self, *rids: int) -> Traversal:  # noqa: N802
        return self.then("V", rids)

    def out(self, *labels: str | int) -> Traversal:
        return self.then("out", labels)

    def in_(self, *labels: str | int) -> Traversal:
        return self.then("in", labels)

    def both(self, *labels: str | int) -> Traversal:
        return self.then("both", labels)

    def has(self, key: str, value: object) -> Traversal:
        return self.then("has", key, value)

    def has_label(self, kind: str) -> Traversal:
        return self.then("hasLabel", kind)

    def values(self, key: str) -> Traversal:
        return self.then("values", key)

    def path(self) -> Traversal:
        return self.then("path")

    def limit(self, n: int) -> Traversal:
        return self.then("limit", n)

    def count(self) -> Traversal:
        return self.then("count")

    def dedup(self) -> Traversal:
        return self.then("dedup")

    def group(self, key: str) -> Traversal:
        return self.then("group", key)

    def group_count(self, key: str) -> Traversal:
        """Rows (key, count): counted in partial sums, without the lists of group()."""
        return self.then("groupCount", key)

    def order(self, key: str, ascending: bool = True) -> Traversal:
        return self.then("order", key, ascending)

    def dataframe(self) -> DataFrame:
        """The traversers; after count() one row (count), after group() rows (key, rids)."""
        g = self.graph
        if not self.steps:
            return g.spark.createDataFrame([], "current long, path array<long>, bulk long, value string")
        if self.steps[0][0] != "V":
            raise ValueError("a traversal starts with V()")
        df = None
        for name, *args in self.steps:
            if name == "V":
                df = g.nodes().select(F.col("rid").alias("current"))
                if args[0]:
                    df = df.where(F.col("current").isin(*args[0]))
                df = df.withColumns({"path": F.array("current"), "bulk": F.lit(1).cast("long"), "value": F.lit(None).cast("string")})
            elif name in ("out", "in", "both"):
                edges = g.edges_of(list(args[0]) or None)
                df = expand(df, edges, direction=name).withColumn("path", F.concat("path", F.array("current"))).select("current", "path", "bulk", "value")
            elif name == "has":
                nodes = g.nodes(keys=(args[0],)) if args[0] != "type" else g.nodes()
                kind = dict(nodes.dtypes)[args[0]]
                hit = nodes.where(equals(F.col(args[0]), kind, args[1]) & (F.col(args[0]).isNotNull() | F.lit(args[1] is None))).select(F.col("rid").alias("current"))
                df = df.join(hit, "current", "left_semi")
            elif name == "hasLabel":
                df = df.join(g.nodes(args[0]).select(F.col("rid").alias("current")), "current", "left_semi") if "" not in g.tables else df.join(g.nodes().where(F.lower("type") == args[0].lower()).select(F.col("rid").alias("current")), "current", "left_semi")
            elif name == "values":
                got = self._property(args[0]).where("_v is not null")
                df = df.join(got, "current").drop("value").withColumn("value", F.col("_v").cast("string")).select("current", "path", "bulk", "value")
            elif name == "path":
                df = df.drop("value").withColumn("value", F.col("path")).select("current", "path", "bulk", "value")
            elif name == "dedup":
                df = df.dropDuplicates(["current"])
            elif name == "limit":
                df = df.limit(args[0])
            elif name == "count":
                df = df.agg(F.coalesce(F.sum("bulk"), F.lit(0).cast("long")).alias("count"))
            elif name == "group":
                df = df.join(self._property(args[0]), "current").groupBy(F.col("_v").alias("key")).agg(F.array_sort(F.collect_list("current")).alias("rids"))
            elif name == "groupCount":
                df = df.join(self._property(args[0]), "current").groupBy(F.col("_v").alias("key")).agg(F.sum("bulk").alias("count"))
            elif name == "order":
                key = F.col("_v").asc() if args[1] else F.col("_v").desc()
                df = df.join(self._property(args[0]), "current", "left").orderBy(key, "current").drop("_v")
            else:
                raise ValueError(f"unknown step {name}")
        return df

    def _property(self, key: str) -> DataFrame:
        return self.graph.nodes(keys=(key,)).select(F.col("rid").alias("current"), F.col(key).alias("_v"))


def g(graph: PropertyGraph) -> Traversal:
    return Traversal(graph)


STEP = re.compile(r"\.?([A-Za-z]+)\(([^()]*)\)")


def literal(text: str) -> object:
    text = text.strip()
    if text[:1] in "'\"" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[text]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def parse(graph: PropertyGraph, text: str) -> Traversal:
    """Steps as text: g.V(1).out('knows').has('name', 'Bob').values('name')."""
    text = text.strip().removeprefix("g.")
    out, at = g(graph), 0
    for m in STEP.finditer(text):
        if m.start() != at:
            raise ValueError(f"no step at {text[at:]!r}")
        at = m.end()
        args = [literal(x) for x in re.findall(r"'[^']*'|\"[^\"]*\"|[^,]+", m[2]) if x.strip()]
        name = {"in": "in_", "hasLabel": "has_label", "groupCount": "group_count"}.get(m[1], m[1])
        if name not in ("V", "out", "in_", "both", "has", "has_label", "values", "path", "limit", "count", "dedup", "group", "group_count", "order", "by"):
            raise ValueError(f"unknown step {m[1]}")
        if name == "by":
            kind, *_ = out.steps[-1]
            out = Traversal(graph, (*out.steps[:-1], (kind, args[0]) if kind in ("group", "groupCount") else (kind, args[0], str(args[1:2] or ["asc"]).lower().find("desc") < 0)))
        elif name in ("group", "group_count", "order") and not args:
            out = out.then({"group_count": "groupCount"}.get(name, name), "")
        else:
            out = getattr(out, name)(*args)
    if at != len(text):
        raise ValueError(f"no step at {text[at:]!r}")
    return out
