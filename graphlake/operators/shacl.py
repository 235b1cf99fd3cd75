"""SHACL validation: shapes compile to one union of violation queries over triples-like node values.

A property path is a JSON property (typed column) or an edge label. Each constraint of each shape
adds its violating (focus, value) rows; all run in one plan. Focus nodes are chosen by class, by id,
or all.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_boolean, is_integer
from ..model import PropertyGraph
from ..sources.ntriples import RDF_TYPE, parse_turtle

SH = "http://www.w3.org/ns/shacl#"
REPORT = ("focus_node", "shape_id", "constraint", "message", "value", "expected", "path")


@dataclass(frozen=True)
class Constraint:
    """kind: datatype, minCount, maxCount, pattern, in, class, nodeKind, minInclusive, maxInclusive."""

    kind: str
    arg: object
    flags: str = ""


@dataclass(frozen=True)
class Shape:
    """path None: the constraints hold for the focus node itself."""

    shape_id: str
    path: str | None = None
    target_class: str | None = None
    target_nodes: tuple[int, ...] = ()
    constraints: tuple[Constraint, ...] = field(default=())


def local(term: str) -> str:
    """The last part of an IRI, or a literal's text."""
    if term.startswith('"'):
        return term[1 : term.rindex('"')].replace('\\"', '"').replace("\\\\", "\\")
    return term.strip("<>").replace("#", "/").rstrip("/").rsplit("/", 1)[-1]


def parse_shapes(text: str) -> list[Shape]:
    """Node and property shapes of a Turtle text; nested properties take their node shape's targets."""
    rows = parse_turtle(text)
    of: dict[str, dict[str, list[str]]] = {}
    for s, p, o in rows:
        of.setdefault(s, {}).setdefault(p.strip("<>").removeprefix(SH) if p != RDF_TYPE else "a", []).append(o)
    nested = {o for p in of.values() for o in p.get("property", ())}
    out: list[Shape] = []

    def constraints(p: dict[str, list[str]]) -> tuple[Constraint, ...]:
        found = []
        for kind in ("datatype", "minCount", "maxCount", "pattern", "class", "nodeKind", "minInclusive", "maxInclusive"):
            for o in p.get(kind, ()):
                value: object = local(o)
                found.append(Constraint(kind, int(value) if kind in ("minCount", "maxCount") else float(value) if "Inclusive" in kind else value, local(p["flags"][0]) if kind == "pattern" and "flags" in p else ""))
        for o in p.get("in", ()):
            found.append(Constraint("in", tuple(local(x) for x in of.get(o, {}).get("<list:item>".strip("<>"), ()))))
        return tuple(found)

    def add(name: str, p: dict[str, list[str]], target: dict[str, list[str]], owner: str) -> None:
        classes = [local(c) for c in target.get("targetClass", ())] or [None]
        nodes = tuple(int(local(n)) for n in target.get("targetNode", ()) if local(n).isdigit())
        for c in classes:
            out.append(Shape(owner, local(p["path"][0]) if "path" in p else None, c, nodes, constraints(p)))

    for name, p in of.items():
        shapes = {local(t) for t in p.get("a", ())} & {"NodeShape", "PropertyShape"}
        if not shapes or name in nested:
            continue
        if constraints(p) or "path" in p:
            add(name, p, p, local(name))
        for inner in p.get("property", ()):
            add(inner, of[inner], p, local(name))
    return out


#: The shapes used where a text is empty.
EXAMPLES = (
    Shape("PersonShape", None, "Person", (), (Constraint("datatype", "string"),)),
    Shape("PersonNameShape", "name", None, (), (Constraint("minCount", 1), Constraint("maxCount", 1), Constraint("datatype", "string"))),
)


def targets(graph: PropertyGraph, shape: Shape, keys: tuple[str, ...] = ()) -> DataFrame:
    typed = "" not in graph.tables
    df = graph.nodes(shape.target_class if typed and shape.target_class else None, keys)
    if shape.target_class and not typed:
        df = df.where(F.lower("type") == shape.target_class.lower())
    return df.where(F.col("rid").isin(*shape.target_nodes)) if shape.target_nodes else df


def is_edge(graph: PropertyGraph, path: str) -> bool:
    return graph.label_id(path) is not None and not any(path in t.columns for t in graph.tables.values())


def values(graph: PropertyGraph, shape: Shape) -> DataFrame:
    """(rid, value string, value_type): the values at the shape's path; nodes without one are left out."""
    if shape.path is None:
        key = ("data",) if any("data" in t.columns for t in graph.tables.values()) else ()
        df = targets(graph, shape, key)
        return df.select("rid", (F.col("data") if key else F.col("rid").cast("string")).alias("value"), F.col("type").alias("value_type"))
    if is_edge(graph, shape.path):
        reached = graph.edges_of([shape.path]).select(F.col("src").alias("rid"), "dst").join(targets(graph, shape).select("rid"), "rid", "left_semi")
        kinds = graph.nodes().select(F.col("rid").alias("dst"), F.col("type").alias("value_type"))
        return reached.join(kinds, "dst", "left").select("rid", F.col("dst").cast("string").alias("value"), "value_type")
    df = targets(graph, shape, (shape.path,))
    return df.where(F.col(shape.path).isNotNull()).select("rid", F.col(shape.path).cast("string").alias("value"), F.lit(None).cast("string").alias("value_type"))


def broken(c: Constraint, edge: bool) -> Column:
    """Whether a value breaks a constraint on single values."""
    v = F.col("value")
    if c.kind == "datatype":
        return {"integer": ~is_integer(v), "int": ~is_integer(v), "boolean": ~is_boolean(v)}.get(str(c.arg), F.lit(False))
    if c.kind == "pattern":
        return ~v.rlike((f"(?{c.flags})" if c.flags else "") + str(c.arg))
    if c.kind == "in":
        return ~v.isin(*c.arg)
    if c.kind == "class":
        return ~F.coalesce(F.lower("value_type") == str(c.arg).lower(), F.lit(False))
    if c.kind == "nodeKind":
        return F.lit(edge != ("IRI" in str(c.arg))) if str(c.arg) in ("IRI", "Literal") else F.lit(False)
    if c.kind == "minInclusive":
        return ~F.coalesce(v.try_cast("double") >= float(c.arg), F.lit(False))
    if c.kind == "maxInclusive":
        return ~F.coalesce(v.try_cast("double") <= float(c.arg), F.lit(False))
    raise ValueError(f"unknown constraint {c.kind}")


def message_of(c: Constraint, path: str | None) -> str:
    #: The texts of reports.
    told = {
        "datatype": f"{'Property value' if path else 'Value'} does not match datatype {c.arg}",
        "pattern": f"Value does not match pattern {c.arg}",
        "in": "Value not in allowed set: [" + ", ".join(f'"{x}"' for x in c.arg) + "]" if c.kind == "in" else "",
    }
    return told.get(c.kind, f"Value does not satisfy {c.kind} {c.arg}")


def violations_of(graph: PropertyGraph, shape: Shape) -> DataFrame | None:
    edge = shape.path is not None and is_edge(graph, shape.path)
    found, parts = values(graph, shape), []

    def told(df: DataFrame, kind: str, message: Column, value: Column, expected: object) -> DataFrame:
        text = ",".join(map(str, expected)) if isinstance(expected, tuple) else f"{expected:g}" if isinstance(expected, float) else str(expected)
        return df.select(F.col("rid").alias("focus_node"), F.lit(shape.shape_id).alias("shape_id"), F.lit(kind).alias("constraint"), message.alias("message"), value.cast("string").alias("value"), F.lit(text).alias("expected"), F.lit(shape.path).cast("string").alias("path"))

    limits = [c for c in shape.constraints if c.kind in ("minCount", "maxCount")]
    if limits:
        n = targets(graph, shape).select("rid").join(found.groupBy("rid").agg(F.count(F.lit(1)).alias("n")), "rid", "left").select("rid", F.coalesce("n", F.lit(0)).alias("n"))
        for c in limits:
            bad = n.where(F.col("n") < c.arg if c.kind == "minCount" else F.col("n") > c.arg)
            parts.append(told(bad, c.kind, F.format_string(f"Expected {'at least' if c.kind == 'minCount' else 'at most'} {c.arg} values, found %d", "n"), F.col("n"), c.arg))
    for c in (c for c in shape.constraints if c.kind not in ("minCount", "maxCount")):
        parts.append(told(found.where(broken(c, edge)), c.kind, F.lit(message_of(c, shape.path)), F.col("value"), c.arg))
    return reduce(DataFrame.unionByName, parts) if parts else None


def validate(graph: PropertyGraph, shapes: list[Shape] | str, max_violations: int | None = None, strict: bool = False) -> DataFrame:
    """The violations (focus_node, shape_id, constraint, message, value, expected, path).

    max_violations keeps the first in order of shape, focus node and constraint; strict stops at the
    first shape that does not conform.
    """
    if isinstance(shapes, str):
        shapes = parse_shapes(shapes) if shapes.strip() else list(EXAMPLES)
    parts = []
    for shape in shapes:
        part = violations_of(graph, shape)
        if part is not None:
            parts.append(part)
            if strict and not part.isEmpty():
                break
    if not parts:
        return graph.spark.createDataFrame([], "focus_node long, shape_id string, constraint string, message string, value string, expected string, path string")
    out = reduce(DataFrame.unionByName, parts)
    return out.orderBy("shape_id", "focus_node", "constraint", "value").limit(max_violations) if max_violations is not None else out


def summary(violations: DataFrame) -> DataFrame:
    """One row (conforms, violations)."""
    return violations.agg((F.count(F.lit(1)) == 0).alias("conforms"), F.count(F.lit(1)).alias("violations"))
