"""Chat formatting with a grammar that reads back what was written, in DataFrame functions only.

    conversation := turn*
    turn         := "<|im_start|>" role "\\n" text "<|im_end|>\\n"

The parser is deterministic: it cuts at "<|im_start|>", takes the role up to the first line break
and the text up to the closing mark, which may stand nowhere else in the turn, and undoes escapes. A turn is first written as it is and read
back; if role and text don't come back identical, its content is escaped and read again, and if a
whole conversation doesn't come back, all its turns are escaped. Escapes add a backslash inside
"<|" ("<\\|", "<\\\\|", ...), and in roles also write a line break as "<n|"; both can be undone whatever
the content, and escaped content holds no "<|", so no mark.

Turns follow each other by turn, then role, then text (a null turn first); null roles and texts are
empty. A conversation becomes one row, which holds all its turns; sums over them use partial lists
on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, STOP, END = "<|im_start|>", "<|im_end|>", "<|im_end|>\n"


def escape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, r"<([n\\]*)\|", r"<\\$1|"), F.lit("\n"), F.lit("<n|"))


def unescape_role(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("<n|"), F.lit("\n")), r"<\\([n\\]*)\|", r"<$1|")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def parsed(formatted: Column) -> Column:
    """array<struct<role, body, text>> of a formatted string (body: text as written); null if it isn't of the grammar."""

    def turn(segment: Column) -> Column:
        role = F.substring_index(segment, "\n", 1)
        body = F.substring(segment, F.length(role) + 2, F.length(segment) - F.length(role) - 1 - len(END))
        return F.struct(unescape_role(role).alias("role"), body.alias("body"), unescape_text(body).alias("text"))

    segments = F.split(formatted, r"<\|im_start\|>")
    turns = F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0)))
    sound = (F.element_at(segments, 1) == "") & F.forall(turns, lambda s: s.endswith(END) & (F.instr(s, STOP) == F.length(s) - len(END) + 1) & (F.length(s) - F.length(F.substring_index(s, "\n", 1)) > len(END)))
    return F.when(sound, F.transform(turns, turn))


def content(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array<struct<role, body, text>> as read back, identical boolean).

    identical is true for every row: the whole conversation's escape makes it so.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    back = parsed(rendered(F.col("role"), F.col("text")))
    same = content(back) == F.array(F.struct("role", "text"))
    plain = rendered(F.col("role"), F.col("text"))
    safe = rendered(escape_role(F.col("role")), escape_text(F.col("text")))
    rows = rows.withColumn("written", F.when(F.coalesce(same, F.lit(False)), plain).otherwise(safe))
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "written"))).alias("source"))
    first = held.withColumn("formatted", F.array_join(F.col("source.written"), ""))
    check = F.coalesce(content(parsed(F.col("formatted"))) == content(F.col("source")), F.lit(False))
    whole = F.array_join(F.transform("source", lambda t: rendered(escape_role(t["role"]), escape_text(t["text"]))), "")
    second = first.withColumn("formatted", F.when(check, F.col("formatted")).otherwise(whole))
    read = second.withColumn("turns", parsed(F.col("formatted")))
    return read.select("conv_id", "formatted", "turns", (content(F.col("turns")) == content(F.col("source"))).alias("identical"))


def with_loss_mask(formatted: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds loss_mask array<struct<start, length>>: code points of formatted that the loss counts, in order.

    The masked part of a turn is its text as written, without role and marks.
    """

    def step(state: Column, t: Column) -> Column:
        # the role as written: what it escapes to, or itself where the turn stands unescaped
        head = F.length(F.substring_index(F.substring(F.col("formatted"), state["at"] + len(START) + 1, 2**31 - 1), "\n", 1)) + len(START) + 1
        size = F.length(t["body"])
        span = F.struct((state["at"] + head).cast("long").alias("start"), size.cast("long").alias("length"))
        mask = F.when(t["role"].isin(*trained), F.concat(state["mask"], F.array(span))).otherwise(state["mask"])
        return F.struct((state["at"] + head + size + len(END)).cast("int").alias("at"), mask.alias("mask"))

    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)").alias("mask"))
    return formatted.withColumn("loss_mask", F.aggregate("turns", empty, step, lambda s: s["mask"]))


def masked_text() -> Column:
    """What stands under the mask, unescaped and joined."""
    return F.array_join(F.transform("loss_mask", lambda m: unescape_text(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
