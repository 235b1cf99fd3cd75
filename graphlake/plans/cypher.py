"""A Cypher subset: text to tokens, tokens to a small syntax tree, the tree to one lazy DataFrame.

MATCH patterns (chains, comma-separated; inline properties; types; directions; variable length),
WHERE, RETURN [DISTINCT] with aliases and aggregates, ORDER BY, SKIP, LIMIT. Each node variable is a
column of ids joined to the columns that the query names; each relationship is one join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..operators.gremlin import equals
from ..operators.traverse import durable

TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.\d+|\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_][A-Za-z0-9_]*|`[^`]+`)|(?P<op><>|<=|>=|->|<-|\.\.|[-+*/=<>()\[\]{}:,.|%]))")
AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "collect": F.collect_list}


class CypherError(ValueError):
    pass


@dataclass
class Node:
    var: str
    label: str | None
    props: dict[str, object]


@dataclass
class Relationship:
    var: str | None
    types: list[str]
    direction: str
    low: int
    high: int | None  # None: as far as the edges go
    variable: bool


@dataclass
class Query:
    patterns: list[list[Node | Relationship]] = field(default_factory=list)
    where: tuple | None = None
    items: list[tuple[tuple, str]] = field(default_factory=list)
    distinct: bool = False
    order: list[tuple[tuple, bool]] = field(default_factory=list)
    skip: int | None = None
    limit: int | None = None


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.rstrip().rstrip(";").rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise CypherError(f"unexpected {text[at : at + 12]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.fresh = 0, 0

    def peek(self, value: str, ahead: int = 0) -> bool:
        i = self.at + ahead
        return i < len(self.tokens) and self.tokens[i][0] != "str" and self.tokens[i][1].lower() == value.lower()

    def take(self, value: str) -> bool:
        hit = self.peek(value)
        self.at += hit
        return hit

    def need(self, value: str) -> None:
        if not self.take(value):
            found = self.tokens[self.at][1] if self.at < len(self.tokens) else "the end"
            raise CypherError(f"expected {value}, found {found}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise CypherError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1].strip("`")

    def number(self) -> int:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "num":
            raise CypherError("expected a number")
        self.at += 1
        return int(self.tokens[self.at - 1][1])

    def query(self) -> Query:
        q = Query()
        self.need("MATCH")
        while True:
            q.patterns.append(self.pattern())
            if not (self.take(",") or self.take("MATCH")):
                break
        if self.take("WHERE"):
            q.where = self.either()
        self.need("RETURN")
        q.distinct = self.take("DISTINCT")
        while True:
            start = self.at
            e = self.either()
            text = "".join(t for _, t in self.tokens[start : self.at])
            q.items.append((e, self.name() if self.take("AS") else text))
            if not self.take(","):
                break
        if self.take("ORDER"):
            self.need("BY")
            while True:
                e = self.either()
                down = self.take("DESC") or self.take("DESCENDING")
                if not down:
                    self.take("ASC") or self.take("ASCENDING")
                q.order.append((e, not down))
                if not self.take(","):
                    break
        while self.peek("SKIP") or self.peek("LIMIT"):
            if self.take("SKIP"):
                q.skip = self.number()
            elif self.take("LIMIT"):
                q.limit = self.number()
        if self.at != len(self.tokens):
            raise CypherError(f"unexpected {self.tokens[self.at][1]}")
        return q

    def pattern(self) -> list[Node | Relationship]:
        out: list[Node | Relationship] = [self.node()]
        while self.peek("-") or self.peek("<-"):
            out += [self.relationship(), self.node()]
        return out

    def variable(self) -> str | None:
        return self.name() if self.at < len(self.tokens) and self.tokens[self.at][0] == "name" else None

    def node(self) -> Node:
        self.need("(")
        var = self.variable()
        if var is None:
            self.fresh += 1
            var = f"_n{self.fresh}"
        label = self.name() if self.take(":") else None
        props = self.properties() if self.peek("{") else {}
        self.need(")")
        return Node(var, label, props)

    def properties(self) -> dict[str, object]:
        self.need("{")
        out = {}
        while not self.take("}"):
            key = self.name()
            self.need(":")
            value = self.atom()
            if value[0] != "lit":
                raise CypherError("a property in a pattern is a literal")
            out[key] = value[1]
            self.take(",")
        return out

    def relationship(self) -> Relationship:
        inward = self.take("<-")
        if not inward:
            self.need("-")
        var, types, low, high, variable = None, [], 1, 1, False
        if self.take("["):
            var = self.variable()
            if self.take(":"):
                types.append(self.name())
                while self.take("|"):
                    self.take(":")
                    types.append(self.name())
            if self.take("*"):
                variable, low, high = True, 1, None
                if self.at < len(self.tokens) and self.tokens[self.at][0] == "num":
                    low = high = self.number()
                if self.take(".."):
                    high = self.number() if self.at < len(self.tokens) and self.tokens[self.at][0] == "num" else None
            self.need("]")
        if inward:
            self.need("-")
            direction = "in"
        elif self.take("->"):
            direction = "out"
        else:
            self.need("-")
            direction = "both"
        return Relationship(var, types, direction, low, high, variable)

    def either(self) -> tuple:
        e = self.both()
        while self.take("OR"):
            e = ("or", e, self.both())
        return e

    def both(self) -> tuple:
        e = self.negated()
        while self.take("AND"):
            e = ("and", e, self.negated())
        return e

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("NOT") else self.compared()

    def compared(self) -> tuple:
        e = self.summed()
        for op in ("=", "<>", "<=", ">=", "<", ">"):
            if self.take(op):
                return ("cmp", op, e, self.summed())
        if self.take("IN"):
            self.need("[")
            values = []
            while not self.take("]"):
                values.append(self.summed())
                self.take(",")
            return ("in", e, values)
        if self.take("IS"):
            negative = self.take("NOT")
            self.need("NULL")
            return ("not", ("null", e)) if negative else ("null", e)
        for op, n in (("STARTS", "WITH"), ("ENDS", "WITH"), ("CONTAINS", None)):
            if self.take(op):
                if n:
                    self.need(n)
                return ("text", op.lower(), e, self.summed())
        return e

    def summed(self) -> tuple:
        e = self.multiplied()
        while self.peek("+") or self.peek("-"):
            op = "+" if self.take("+") else (self.need("-") or "-")
            e = ("math", op, e, self.multiplied())
        return e

    def multiplied(self) -> tuple:
        e = self.atom()
        while self.peek("*") or self.peek("/") or self.peek("%"):
            op = next(o for o in "*/%" if self.take(o))
            e = ("math", op, e, self.atom())
        return e

    def listing(self) -> tuple:
        """A list, or a comprehension: [x IN list WHERE condition | value]."""
        if self.peek("IN", 1):
            var = self.name()
            self.need("IN")
            source, where = self.atom(), None
            if self.take("WHERE"):
                where = self.either()
            value = self.either() if self.take("|") else ("var", var)
            self.need("]")
            return ("each", var, source, where, value)
        values = []
        while not self.take("]"):
            values.append(self.either())
            self.take(",")
        return ("list", values)

    def atom(self) -> tuple:
        if self.take("-"):
            e = self.atom()
            return ("lit", -e[1]) if e[0] == "lit" else ("math", "-", ("lit", 0), e)
        if self.take("("):
            e = self.either()
            self.need(")")
            return e
        if self.take("["):
            return self.listing()
        if self.at >= len(self.tokens):
            raise CypherError("expected an expression")
        kind, text = self.tokens[self.at]
        if kind == "num":
            self.at += 1
            return ("lit", float(text) if "." in text else int(text))
        if kind == "str":
            self.at += 1
            return ("lit", re.sub(r"\\(.)", r"\1", text[1:-1]))
        name = self.name()
        if name.lower() in ("true", "false", "null"):
            return ("lit", {"true": True, "false": False, "null": None}[name.lower()])
        if self.take("("):
            distinct = self.take("DISTINCT")
            args = []
            if self.take("*"):
                args.append(("star",))
            while not self.take(")"):
                args.append(self.either())
                self.take(",")
            return ("call", name.lower(), distinct, args)
        return ("prop", name, self.name()) if self.take(".") else ("var", name)


def parse(text: str) -> Query:
    return Parser(text).query()


def parts_of(e: object) -> list[tuple]:
    """All sub-expressions of an expression."""
    if isinstance(e, tuple):
        return [e, *(p for x in e for p in parts_of(x))]
    return [p for x in e for p in parts_of(x)] if isinstance(e, list) else []


class Compiler:
    def __init__(self, graph: PropertyGraph, q: Query):
        self.graph, self.q = graph, q
        self.keys: dict[str, set[str]] = {}
        self.kinds: dict[str, str] = {}
        exprs = [q.where, *(e for e, _ in q.items), *(e for e, _ in q.order)]
        for p in parts_of(exprs):
            if p[:1] == ("prop",):
                self.keys.setdefault(p[1], set()).add(p[2])
        self.nodes: dict[str, Node] = {}
        for n in (x for p in q.patterns for x in p if isinstance(x, Node)):
            known = self.nodes.setdefault(n.var, Node(n.var, n.label, {}))
            known.label = known.label or n.label
            known.props |= n.props
        self.local: dict[str, Column] = {}
        for p in parts_of(exprs):
            if p[:2] == ("call", "properties") and p[3] and p[3][0][0] == "var":
                self.keys.setdefault(p[3][0][1], set()).update({f for t in graph.tables.values() for f in t.columns} | {"type"})
        self.bound: set[str] = set()
        self.relations: list[str] = []

    def node_rows(self, var: str) -> DataFrame | None:
        """The rows of a node variable with the columns that the query names; None if any node will do."""
        n = self.nodes[var]
        keys = tuple(sorted(self.keys.get(var, set()) | set(n.props)))
        typed = "" not in self.graph.tables
        df = self.graph.nodes(n.label if typed else None, keys)
        if n.label and not typed:
            df = df.where(F.lower("type") == n.label.lower())
        types = dict(df.dtypes)
        for k, v in n.props.items():
            df = df.where(equals(F.col(k), types[k], v))
        for k in keys:
            self.kinds[f"{var}.{k}"] = types[k]
        return df.select(F.col("rid").alias(var), *(F.col(k).alias(f"{var}.{k}") for k in keys if k != "rid"))

    def with_node(self, df: DataFrame | None, var: str) -> DataFrame:
        if var in self.bound:
            return df
        self.bound.add(var)
        rows = self.node_rows(var)
        if df is None:
            return rows
        return df.join(rows, var) if var in df.columns else df.crossJoin(rows)

    def match(self) -> DataFrame:
        df = None
        for pattern in self.q.patterns:
            start = pattern[0].var
            df = self.with_node(df, start) if df is None or start not in df.columns else df
            for i in range(1, len(pattern), 2):
                df = self.hop(df, pattern[i - 1].var, pattern[i], pattern[i + 1].var)
        return df

    def steps(self, r: Relationship) -> DataFrame:
        edges = self.graph.edges_of(r.types or None)
        ahead = edges.select(F.col("src").alias("_a"), F.col("dst").alias("_b"), "eid")
        back = edges.select(F.col("dst").alias("_a"), F.col("src").alias("_b"), "eid")
        return {"out": ahead, "in": back}[r.direction] if r.direction != "both" else ahead.unionByName(back.where("_a <> _b"))

    def hop(self, df: DataFrame, here: str, r: Relationship, there: str) -> DataFrame:
        steps, known = self.steps(r), there in self.bound
        end = f"_to_{there}" if known else there
        eid = f"_e{len(self.relations)}"
        if r.variable:
            if r.low < 0 or r.high is not None and r.high < r.low:
                raise CypherError("a path's length is from m to n with m <= n")
            level = df.withColumns({end: F.col(here), eid: F.expr("cast(array() as array<string>)")})
            levels = [level] if r.low == 0 else []
            for depth in count(1) if r.high is None else range(1, r.high + 1):
                level = level.join(steps, F.col(end) == F.col("_a")).where(~F.array_contains(F.col(eid), F.col("eid")))
                level = level.withColumns({end: F.col("_b"), eid: F.concat(F.col(eid), F.array("eid"))}).drop("_a", "_b", "eid")
                if r.high is None:  # no edge comes twice in a path, so some level is empty
                    level = durable(level)
                    if level.isEmpty():
                        break
                if depth >= r.low:
                    levels.append(level)
            if not levels:
                levels = [level]
            df = reduce(DataFrame.unionByName, levels)
        else:
            df = df.join(steps, F.col(here) == F.col("_a")).withColumnRenamed("_b", end).withColumn(eid, F.array("eid")).drop("_a", "eid")
        for other in self.relations:  # no edge twice in a pattern
            df = df.where(~F.arrays_overlap(eid, other))
        self.relations.append(eid)
        if known:
            return df.where(F.col(end) == F.col(there)).drop(end)
        return self.with_node(df, there)

    def column(self, e: tuple) -> Column:
        kind = e[0]
        if kind == "lit":
            return F.lit(e[1])
        if kind == "prop":
            if e[1] not in self.nodes and e[1] not in self.local:
                raise CypherError(f"unknown variable {e[1]}")
            if e[1] in self.local:
                return self.local[e[1]][e[2]]
            return F.col(f"`{e[1]}`") if e[2] == "rid" else F.col(f"`{e[1]}.{e[2]}`")
        if kind == "var":
            if e[1] in self.local:
                return self.local[e[1]]
            if e[1] not in self.nodes:
                raise CypherError(f"unknown variable {e[1]}")
            return F.col(e[1])
        if kind in ("and", "or"):
            a, b = self.column(e[1]), self.column(e[2])
            return a & b if kind == "and" else a | b
        if kind == "not":
            return ~self.column(e[1])
        if kind == "null":
            return self.column(e[1]).isNull()
        if kind == "cmp":
            return self.compared(*e[1:])
        if kind == "in":
            return reduce(lambda a, b: a | b, (self.compared("=", e[1], v) for v in e[2]), F.lit(False))
        if kind == "text":
            a, b = self.column(e[2]), self.column(e[3])
            return {"starts": F.startswith, "ends": F.endswith, "contains": F.contains}[e[1]](a, b)
        if kind == "math":
            a, b = self.column(e[2]), self.column(e[3])
            if e[1] in "/%":  # by zero: null
                b = F.nullif(b, F.lit(0))
                return a % b if e[1] == "%" else F.call_function("div", a, b) if self.integral(e[2]) and self.integral(e[3]) else a / b
            return {"+": a + b, "-": a - b, "*": a * b}[e[1]]
        if kind == "call":
            return self.called(*e[1:])
        if kind == "list":
            return F.array(*map(self.column, e[1]))
        if kind == "each":
            return self.listed(*e[1:])
        raise CypherError(f"{kind} has no value")

    def integral(self, e: tuple) -> bool:
        """Whether an expression's value is surely an integer."""
        if e[0] == "lit":
            return isinstance(e[1], int) and not isinstance(e[1], bool)
        if e[0] == "prop":
            return e[2] == "rid" or self.kinds.get(f"{e[1]}.{e[2]}") in ("bigint", "int", "smallint", "tinyint")
        return e[0] == "math" and self.integral(e[2]) and self.integral(e[3]) or e[0] == "call" and e[1] in ("count", "size", "id")

    def compared(self, op: str, left: tuple, right: tuple) -> Column:
        if op in ("=", "<>"):
            a, b = (right, left) if left[0] == "lit" else (left, right)
            if b[0] == "lit":
                known = self.kinds.get(f"{a[1]}.{a[2]}") if a[0] == "prop" else None
                same = equals(self.column(a), known, b[1]) if known and (b[1] is None or not known.startswith("double") or isinstance(b[1], float)) else self.column(a).eqNullSafe(self.column(b))
            else:
                same = self.column(a).eqNullSafe(self.column(b))
            return same if op == "=" else ~same
        a, b = self.column(left), self.column(right)
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    def listed(self, var: str, source: tuple, where: tuple | None, value: tuple) -> Column:
        """[var IN source WHERE where | value]"""

        def within(x: Column, e: tuple) -> Column:
            before, self.local = self.local, {**self.local, var: x}
            try:
                return self.column(e)
            finally:
                self.local = before

        rows = self.column(source)
        if where is not None:
            rows = F.filter(rows, lambda x: F.coalesce(within(x, where), F.lit(False)))
        return F.transform(rows, lambda x: within(x, value))

    def whole(self, var: str) -> Column:
        """A node as JSON: rid, type, and its properties in order of their names, without those it lacks."""
        names = sorted({f for t in self.graph.tables.values() for f in t.columns} - {"rid", "type"})
        return F.to_json(F.struct(F.col(var).alias("rid"), F.col(f"`{var}.type`").alias("type"), *(F.col(f"`{var}.{k}`").alias(k) for k in names)))

    def called(self, name: str, distinct: bool, args: list[tuple]) -> Column:
        if name in AGGREGATES:
            arg = F.lit(1) if args == [("star",)] else self.column(args[0])
            if distinct:
                return F.count_distinct(arg) if name == "count" else F.collect_set(arg) if name == "collect" else AGGREGATES[name](arg)
            return AGGREGATES[name](arg)
        scalar = {"id": lambda x: x, "toupper": F.upper, "tolower": F.lower, "size": F.length, "abs": F.abs, "tostring": lambda x: x.cast("string"), "coalesce": F.coalesce}
        if name == "properties" and args and args[0][0] == "var":
            return self.whole(args[0][1])
        if name == "size" and args and args[0][0] in ("list", "each"):
            return F.size(self.column(args[0]))
        if name not in scalar:
            raise CypherError(f"unknown function {name}")
        return scalar[name](*map(self.column, args))

    def dataframe(self) -> DataFrame:
        q, df = self.q, self.match()
        if q.where is not None:
            df = df.where(F.coalesce(self.column(q.where), F.lit(False)))
        is_sum = lambda e: any(p[:1] == ("call",) and p[1] in AGGREGATES for p in parts_of(e))
        names = [n for _, n in q.items]
        if any(is_sum(e) for e, _ in q.items):
            keys = [self.column(e).alias(n) for e, n in q.items if not is_sum(e)]
            df = df.groupBy(*keys).agg(*(self.column(e).alias(n) for e, n in q.items if is_sum(e))).select(*(f"`{n}`" for n in names))
            by = lambda e: F.col(f"`{next((n for x, n in q.items if x == e or e == ('var', n)), '?')}`")
        else:
            hidden = [(e, f"_o{i}") for i, (e, _) in enumerate(q.order) if not any(e in (x, ("var", n)) for x, n in q.items)]
            df = df.select(*(self.column(e).alias(n) for e, n in q.items), *(self.column(e).alias(n) for e, n in hidden if not q.distinct))
            by = lambda e: F.col(f"`{next((n for x, n in [*q.items, *hidden] if x == e or e == ('var', n)), '?')}`")
        if q.distinct:
            df = df.distinct()
        if q.order:
            df = df.orderBy(*(by(e).asc() if up else by(e).desc() for e, up in q.order))
        if q.skip:
            df = df.offset(q.skip)
        if q.limit is not None:
            df = df.limit(q.limit)
        return df.select(*(f"`{n}`" for n in names))


def cypher(graph: PropertyGraph, text: str) -> DataFrame:
    return Compiler(graph, parse(text)).dataframe()
