"""Term search: postings with positions, counts as scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


def postings(texts: DataFrame, rid: str = "rid", text: str = "text") -> DataFrame:
    """(term, rid, pos): positions count from 0 over the terms of a text."""
    return texts.select(F.col(rid).alias("rid"), F.posexplode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("pos", "term")).select("term", "rid", "pos")


def search(texts: DataFrame, term: str, rid: str = "rid", text: str = "text") -> DataFrame:
    """(rid, score): occurrences of one term (in any case), best first, ties by rid.

    A text that does not contain the term as a substring is left out before it is cut up.
    """
    wanted = term.lower()
    some = texts.where(F.lower(text).contains(wanted)).select(F.col(rid).alias("rid"), tokens(F.col(text)).alias("terms"))
    scored = some.select("rid", F.size(F.filter("terms", lambda t: t == wanted)).alias("n")).where("n > 0")
    return scored.groupBy("rid").agg(F.sum("n").cast("double").alias("score")).orderBy(F.desc("score"), "rid")


def term_counts(texts: DataFrame, rid: str = "rid", text: str = "text") -> DataFrame:
    return postings(texts, rid, text).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
