"""Text and term functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case terms between Unicode white space; punctuation stays."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != "")


def escaped_literal(c: Column) -> Column:
    """For N-Triples: backslash, quote, line feed and carriage return."""
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescaped_literal(c: Column) -> Column:
    """The text of an escaped literal: \\\\, \\", \\n, \\r, \\t, \\b, \\f, \\uXXXX and \\UXXXXXXXX undone from left to right."""
    simple = F.create_map(*(F.lit(x) for pair in {"\\\\": "\\", '\\"': '"', "\\'": "'", "\\n": "\n", "\\r": "\r", "\\t": "\t", "\\b": "\b", "\\f": "\f"}.items() for x in pair))
    parts = F.regexp_extract_all(c, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+|\\$"), F.lit(0))

    def undone(x: Column) -> Column:
        code = F.conv(F.substring(x, 3, 8), 16, 10).cast("bigint")
        wide = F.when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd").otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.when(x.rlike(r"^\\[uU][0-9A-Fa-f]{4}"), wide).otherwise(F.coalesce(simple[x], x))

    return F.when(c.contains("\\"), F.array_join(F.transform(parts, undone), "")).otherwise(c)


def iri(base: str, kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"<{base}{kind}/"), key.cast("string"), F.lit(">"))


def is_integer(c: Column) -> Column:
    """A signed 64-bit integer without blanks."""
    return c.rlike(r"^[+-]?[0-9]+$") & c.try_cast("bigint").isNotNull()


def is_boolean(c: Column) -> Column:
    return c.isin("true", "false", "1", "0")
