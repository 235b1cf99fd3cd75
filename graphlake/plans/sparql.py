"""A SPARQL subset over a table of triples (s, p, o): SELECT, ASK and CONSTRUCT.

Groups of triple patterns, FILTER, OPTIONAL, UNION, MINUS, [NOT] EXISTS, DISTINCT, GROUP BY with COUNT, SUM, AVG, MIN, MAX,
SAMPLE and GROUP_CONCAT, ORDER BY, LIMIT and OFFSET. A pattern is a filtered projection; patterns meet by equi joins on
their common variables. A variable is a column of terms; unbound is null.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unescaped_literal

from ..sources.ntriples import PREFIXES, RDF_TYPE

TOKEN = re.compile(r"""\s*(?:\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<var>[?$]\w+)|(?P<num>\d+(?:\.\d+)?)|(?P<op>&&|\|\||!=|<=|>=|[{}().;,=<>!*+/-])|(?P<name>[A-Za-z_][\w-]*(?::[\w./-]*\w)?:?|:[\w-]+))""")


class SparqlError(ValueError):
    pass


class Parser:
    def __init__(self, text: str):
        self.tokens, at, text = [], 0, text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m or m.end() == at:
                raise SparqlError(f"unexpected {text[at : at + 15]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.prefixes = 0, dict(PREFIXES)

    def peek(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1].upper() in words

    def take(self, *words: str) -> bool:
        hit = self.peek(*words)
        self.at += hit
        return hit

    def need(self, word: str) -> None:
        if not self.take(word):
            raise SparqlError(f"expected {word}, found {self.tokens[self.at][1] if self.at < len(self.tokens) else 'the end'}")

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise SparqlError("unexpected end")
        self.at += 1
        return self.tokens[self.at - 1]

    def query(self) -> dict:
        while self.take("PREFIX"):
            name = self.next()[1].rstrip(":")
            self.prefixes[name] = self.next()[1][1:-1]
        q: dict = {"items": [], "distinct": False, "group": [], "order": [], "limit": None, "offset": 0, "template": []}
        if self.take("SELECT"):
            q["kind"], q["distinct"] = "select", self.take("DISTINCT", "REDUCED")
            while not self.peek("WHERE", "{"):
                if self.take("*"):
                    q["items"] = None
                elif self.take("("):
                    e = self.either()
                    self.need("AS")
                    q["items"].append((self.next()[1][1:], e))
                    self.need(")")
                else:
                    v = self.next()[1][1:]
                    q["items"].append((v, ("var", v)))
        elif self.take("ASK"):
            q["kind"] = "ask"
        elif self.take("CONSTRUCT"):
            q["kind"] = "construct"
            self.need("{")
            q["template"] = self.block()
            self.need("}")
        else:
            raise SparqlError("SELECT, ASK or CONSTRUCT is expected")
        self.take("WHERE")
        q["where"] = self.group()
        while self.at < len(self.tokens):
            if self.take("GROUP"):
                self.need("BY")
                while self.at < len(self.tokens) and self.tokens[self.at][0] == "var":
                    q["group"].append(self.next()[1][1:])
            elif self.take("ORDER"):
                self.need("BY")
                while self.at < len(self.tokens) and (self.tokens[self.at][0] == "var" or self.peek("ASC", "DESC")):
                    down = self.take("DESC")
                    self.take("ASC")
                    bracket = self.take("(")
                    q["order"].append((self.next()[1][1:], not down))
                    if bracket:
                        self.need(")")
            elif self.take("LIMIT"):
                q["limit"] = int(self.next()[1])
            elif self.take("OFFSET"):
                q["offset"] = int(self.next()[1])
            else:
                raise SparqlError(f"unexpected {self.tokens[self.at][1]}")
        return q

    def term(self) -> tuple:
        kind, t = self.next()
        if kind == "var":
            return ("var", t[1:])
        if kind == "iri":
            return ("term", t)
        if kind == "str":
            return ("term", '"' + t[1:-1].replace('"', '\\"') + '"' if t[0] == "'" else t)
        if kind == "num":
            return ("term", f'"{t}"')
        if t == "a":
            return ("term", RDF_TYPE)
        prefix, colon, local = t.partition(":")
        if not colon or prefix not in self.prefixes:
            raise SparqlError(f"unknown prefix in {t}")
        return ("term", f"<{self.prefixes[prefix]}{local}>")

    def block(self) -> list[tuple]:
        out = []
        while not self.peek("}", "FILTER", "OPTIONAL", "MINUS", "{"):
            s = self.term()
            while True:
                p = self.term()
                out.append((s, p, self.term()))
                while self.take(","):
                    out.append((s, p, self.term()))
                if not self.take(";") or self.peek(".", "}"):
                    break
            if not self.take("."):
                break
        return out

    def group(self) -> list[tuple]:
        self.need("{")
        out: list[tuple] = []
        while not self.take("}"):
            if self.take("FILTER"):
                if self.take("NOT"):
                    self.need("EXISTS")
                    out.append(("minus_all", self.group()))
                elif self.take("EXISTS"):
                    out.append(("exists", self.group()))
                else:
                    out.append(("filter", self.either()))
            elif self.take("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.take("MINUS"):
                out.append(("minus", self.group()))
            elif self.peek("{"):
                parts = [self.group()]
                while self.take("UNION"):
                    parts.append(self.group())
                out.append(("union", parts))
            else:
                out.append(("bgp", self.block()))
            self.take(".")
        return out

    def either(self) -> tuple:
        e = self.both()
        while self.take("||"):
            e = ("or", e, self.both())
        return e

    def both(self) -> tuple:
        e = self.compared()
        while self.take("&&"):
            e = ("and", e, self.compared())
        return e

    def compared(self) -> tuple:
        e = self.unary()
        for op in ("=", "!=", "<=", ">=", "<", ">"):
            if self.take(op):
                return ("cmp", op, e, self.unary())
        return e

    def unary(self) -> tuple:
        if self.take("!"):
            return ("not", self.unary())
        if self.take("("):
            e = self.either()
            self.need(")")
            return e
        kind, t = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind == "name" and ":" not in t and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "(":
            self.at += 2
            distinct, args = self.take("DISTINCT"), []
            while not self.take(")"):
                args.append(("star",) if self.take("*") else self.either())
                if self.take(";"):
                    self.need("SEPARATOR")
                    self.need("=")
                    args.append(self.term())
                self.take(",")
            return ("call", t.upper(), distinct, args)
        return self.term()


def content(c: Column) -> Column:
    """The text of a term: of an IRI without brackets, of a literal without quotes and tail."""
    body = unescaped_literal(F.regexp_extract(c, r'(?s)^"(.*)"[^"]*$', 1))
    return F.when(c.startswith("<"), F.regexp_replace(c, "^<|>$", "")).otherwise(body)


def number(c: Column) -> Column:
    return F.when(c.startswith('"'), content(c).try_cast("double"))


class Compiler:
    def __init__(self, triples: DataFrame):
        self.triples = triples.select("s", "p", "o")

    def pattern(self, t: tuple) -> DataFrame:
        df, columns = self.triples, {}
        for name, (kind, value) in zip("spo", t, strict=True):
            if kind == "term":
                df = df.where(F.col(name) == value)
            elif value in columns:
                df = df.where(F.col(name) == F.col(columns[value]))
            else:
                columns[value] = name
        return df.select(*(F.col(c).alias(v) for v, c in columns.items())) if columns else df.select(F.lit(1).alias("_one"))

    def joined(self, a: DataFrame | None, b: DataFrame, how: str = "inner", loose: frozenset[str] = frozenset()) -> DataFrame:
        """By equal common variables; those that may be unbound agree with anything."""
        if a is None:
            return b
        common = [c for c in a.columns if c in b.columns]
        if not common:
            return a.crossJoin(b) if how == "inner" else a.join(b, F.lit(True), how)
        if not loose & set(common):
            return a.join(b, common, how)
        r = b.select(*(F.col(c).alias(f"_r_{c}" if c in common else c) for c in b.columns))
        agree = reduce(lambda x, y: x & y, ((F.col(c) == F.col(f"_r_{c}")) | ((F.col(c).isNull() | F.col(f"_r_{c}").isNull()) if c in loose else F.lit(False)) for c in common))
        out = a.join(r, agree, how)
        return out if how in ("left_semi", "left_anti") else out.select(*((F.coalesce(c, f"_r_{c}").alias(c) if c in common else F.col(c)) for c in a.columns), *(c for c in b.columns if c not in common))

    def group(self, parts: list[tuple]) -> tuple[DataFrame | None, frozenset[str]]:
        """(solutions, variables that may be unbound)."""
        df, loose, filters = None, frozenset(), []
        for kind, body in parts:
            if kind == "bgp":
                for t in body:
                    df = self.joined(df, self.pattern(t), "inner", loose)
                    loose -= {v for k, v in t if k == "var"}
            elif kind == "filter":
                filters.append(body)
            elif kind == "optional":
                right, free = self.group(body)
                new = frozenset(right.columns) - frozenset(df.columns if df is not None else ())
                df = self.joined(df, right, "left", loose | free) if df is not None else right
                loose |= new | free
            elif kind == "union":
                sides = [self.group(p) for p in body]
                names = {c for d, _ in sides for c in d.columns}
                u = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), (d for d, _ in sides))
                free = frozenset(n for n in names if any(n not in d.columns for d, _ in sides)) | frozenset().union(*(f for _, f in sides))
                df = self.joined(df, u, "inner", loose | free)
                loose = (loose | free) if df is u else loose | free
            elif kind in ("minus", "minus_all", "exists"):
                right, free = self.group(body)
                if kind != "minus" or set(df.columns) & set(right.columns):
                    df = self.joined(df, right, "left_semi" if kind == "exists" else "left_anti", loose | free)
        for f in filters:
            df = df.where(F.coalesce(self.truth(f), F.lit(False)))
        return df, loose

    def truth(self, e: tuple) -> Column:
        kind = e[0]
        if kind in ("and", "or"):
            a, b = self.truth(e[1]), self.truth(e[2])
            return a & b if kind == "and" else a | b
        if kind == "not":
            return ~self.truth(e[1])
        if kind == "cmp":
            op, a, b = e[1], self.value(e[2]), self.value(e[3])
            x, y = number(a), number(b)
            text = {"=": a == b, "!=": a != b}.get(op)
            by_text = {"<": content(a) < content(b), "<=": content(a) <= content(b), ">": content(a) > content(b), ">=": content(a) >= content(b)}.get(op)
            by_number = {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
            return F.when(x.isNotNull() & y.isNotNull(), by_number).otherwise(text if text is not None else by_text)
        if kind == "call" and e[1] == "BOUND":
            return F.col(e[3][0][1]).isNotNull()
        if kind == "call" and e[1] == "REGEX":
            flags = e[3][2][1].strip('"') if len(e[3]) > 2 else ""
            return content(self.value(e[3][0])).rlike((f"(?{flags})" if flags else "") + e[3][1][1][1:-1].replace("\\\\", "\\"))
        if kind == "call" and e[1] in ("ISIRI", "ISURI", "ISLITERAL"):
            return self.value(e[3][0]).startswith('"' if e[1] == "ISLITERAL" else "<")
        if kind == "call" and e[1] in ("CONTAINS", "STRSTARTS", "STRENDS"):
            a, b = (content(self.value(x)) for x in e[3])
            return {"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[e[1]](a, b)
        raise SparqlError(f"no condition: {e}")

    def value(self, e: tuple) -> Column:
        if e[0] == "var":
            return F.col(e[1])
        if e[0] == "term":
            return F.lit(e[1])
        if e[0] == "call" and e[1] == "STR":
            return F.concat(F.lit('"'), content(self.value(e[3][0])), F.lit('"'))
        raise SparqlError(f"no value: {e}")

    def aggregate(self, e: tuple) -> Column:
        _, name, distinct, args = e
        if name == "COUNT":
            if args == [("star",)]:
                return F.count(F.lit(1))
            return F.count_distinct(self.value(args[0])) if distinct else F.count(self.value(args[0]))
        v = self.value(args[0])
        if name in ("SUM", "AVG"):
            return {"SUM": F.sum, "AVG": F.avg}[name](number(v))
        if name in ("MIN", "MAX"):
            f = F.min if name == "MIN" else F.max
            return F.coalesce(f(number(v)).cast("string"), f(content(v)))
        if name == "SAMPLE":
            return F.min(content(v))
        if name == "GROUP_CONCAT":
            return F.array_join(F.array_sort(F.collect_list(content(v))), args[1][1][1:-1] if len(args) > 1 else " ")
        raise SparqlError(f"unknown aggregate {name}")

    def dataframe(self, q: dict) -> DataFrame:
        df, _ = self.group(q["where"])
        if df is None:
            df = self.triples.sparkSession.range(1).select(F.lit(1).alias("_one"))
        if q["kind"] == "ask":
            return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("boolean"))
        if q["kind"] == "construct":
            made = [df.select(*(self.value(x).alias(c) for c, x in zip("spo", t, strict=True))) for t in q["template"]]
            return reduce(DataFrame.unionByName, made).where("s is not null and p is not null and o is not null").distinct()
        items = q["items"] if q["items"] is not None else [(c, ("var", c)) for c in df.columns if c != "_one"]
        if q["group"] or any(e[0] == "call" for _, e in items):
            sums = [self.aggregate(e).alias(n) for n, e in items if e[0] == "call"]
            df = (df.groupBy(*q["group"]).agg(*sums) if sums else df.select(*q["group"]).distinct()).select(*(n for n, _ in items))
        else:
            for v in {e[1] for _, e in items} - set(df.columns):
                df = df.withColumn(v, F.lit(None).cast("string"))
            extra = [v for v, _ in q["order"] if v not in {n for n, _ in items} and not q["distinct"]]
            df = df.select(*(self.value(e).alias(n) for n, e in items), *extra)
        if q["distinct"]:
            df = df.distinct()
        if q["order"]:
            types = dict(df.dtypes)
            keys = []
            for v, up in q["order"]:
                for k in ([number(F.col(v)), content(F.col(v))] if types[v] == "string" else [F.col(v)]):
                    keys.append(k.asc() if up else k.desc())
            df = df.orderBy(*keys)
        if q["offset"]:
            df = df.offset(q["offset"])
        if q["limit"] is not None:
            df = df.limit(q["limit"])
        return df.select(*(n for n, _ in items))


def sparql(triples: DataFrame, text: str) -> DataFrame:
    """SELECT: a column a variable; ASK: one row (boolean); CONSTRUCT and DESCRIBE <iri>: distinct (s, p, o)."""
    if found := re.match(r"(?s)\s*DESCRIBE\s+(<[^>]*>)\s*$", text, re.IGNORECASE):
        return describe(triples, found[1])
    return Compiler(triples).dataframe(Parser(text).query())


def json_rows(solutions: DataFrame) -> DataFrame:
    """(row): each solution as a JSON object of its bound variables: type (uri, bnode or literal), value, datatype, xml:lang."""

    def term(c: Column) -> Column:
        tail = F.regexp_extract(c, r'(?s)^".*"([^"]*)$', 1)
        kind = F.when(c.startswith("<"), "uri").when(c.startswith("_:"), "bnode").otherwise("literal")
        value = F.when(c.startswith("_:"), F.substring(c, 3, 2**31 - 1)).when(c.startswith("<") | c.startswith('"'), content(c)).otherwise(c)
        datatype = F.when(tail.startswith("^^"), F.regexp_replace(tail, r"^\^\^<|>$", ""))
        language = F.when(tail.startswith("@"), F.substring(tail, 2, 99))
        return F.when(c.isNotNull(), F.struct(kind.alias("type"), value.alias("value"), datatype.alias("datatype"), language.alias("xml:lang")))

    return solutions.select(F.to_json(F.struct(*(term(F.col(v).cast("string")).alias(v) for v in solutions.columns))).alias("row"))


def describe(triples: DataFrame, term: str) -> DataFrame:
    """(s, p, o) of all triples that a term begins or ends."""
    return triples.where((F.col("s") == term) | (F.col("o") == term)).select("s", "p", "o").distinct()
