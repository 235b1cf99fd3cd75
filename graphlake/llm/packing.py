"""Packing by concatenating and cutting: all documents' ids in a row, cut every `length` ids.

Two passes. The first encodes each document once and keeps, beside its ids, how many ids of its
partition stand before it; the partitions' totals (one row a partition) then give each partition's
global offset by a prefix sum. The second pass works row by row: a document's global offset says
which windows it touches, and each touch is a boundary record (sequence, offset in it, start in
the document, length). Only the last sequence can be short. Order is that of the input partitions
and their rows, fixed when the first pass is written; a document without text is its end id alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, durable, slices, text_rows
from .vocab import document_encoder


def encoded(docs: DataFrame, vocabulary: str, end_id: int | None = 2) -> DataFrame:
    """(part, before, doc_id, n, ids): ids as little-endian unsigned 32-bit bytes."""
    schema = "part long, before long, doc_id long, n long, ids binary"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, before = document_encoder(vocabulary, end_id), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch):
                ids = encode(rows.column("text").to_pylist())
                n = np.array([len(x) // 4 for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int64)), pa.array(before + np.cumsum(n) - n), rows.column("doc_id"), pa.array(n), pa.array(ids, pa.binary())], schema=out)
                before += int(n.sum())

    return text_rows(docs).mapInArrow(run, schema)


def cut(tokens: DataFrame, length: int = 4096) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of encoded documents.

    tokens must give the same rows each time it is read (see durable()).
    """
    totals = {r.part: r.n for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    parts = sorted(totals)
    offsets = list(zip(parts, accumulate([0, *(totals[p] for p in parts)]), strict=False))
    shift = tokens.sparkSession.createDataFrame(offsets, "part long, shift long")  # a row a partition
    at = tokens.join(F.broadcast(shift), "part").where("n > 0").withColumn("at", F.col("before") + F.col("shift"))
    touched = F.sequence(F.expr(f"at div {length}"), F.expr(f"(at + n - 1) div {length}"))
    rows = at.select("doc_id", "n", "ids", "at", F.explode(touched).alias("sequence_id"))
    start = F.greatest(F.lit(0), F.col("sequence_id") * length - F.col("at"))
    stop = F.least(F.col("n"), (F.col("sequence_id") + 1) * length - F.col("at"))
    rows = rows.withColumn("start", start).withColumn("length", stop - F.col("start"))
    return rows.select(
        "doc_id", "start", "length", F.expr("substring(ids, int(4 * start + 1), int(4 * length))").alias("ids"),
        F.col("n").alias("doc_tokens"), "sequence_id", (F.col("at") + F.col("start") - F.col("sequence_id") * length).alias("offset"),
    )


def pack(docs: DataFrame, vocabulary: str, length: int = 4096, end_id: int | None = 2) -> DataFrame:
    return cut(durable(encoded(docs, vocabulary, end_id)), length)
