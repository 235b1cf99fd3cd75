"""Columns of numbers moved through a shuffle as one row a bucket, and texts met with such rows.

A row per number would cost far more than the number; here a task deals its numbers out to buckets
and ships each bucket's columns as one binary. Buckets are keyed by a hash, several a partition, so
a reader holds one bucket at a time. A bucket goes to the partition of its own number (modulo their
count), so no partition gets several by chance. Columns are written byte by byte of their numbers
(all lowest bytes, then the next, ...), so that the high bytes of small numbers compress away.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Columns = dict[str, np.ndarray]
BLOB = "kind int, bucket int, data binary"
BLOB_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])


def dumped(columns: Columns) -> bytes:
    head = ";".join(f"{n}:{a.dtype.str}:{len(a)}" for n, a in columns.items()).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(planes(a) for a in columns.values())


def planes(a: np.ndarray) -> bytes:
    return a.tobytes() if a.itemsize == 1 else np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def loaded(blobs: list[bytes]) -> Columns:
    """The columns of all blobs, one after the other."""
    parts: dict[str, list[np.ndarray]] = {}
    for data in blobs:
        n = int.from_bytes(data[:4], "little")
        at = 4 + n
        for name, kind, size in (x.split(":") for x in data[4:at].decode().split(";")):
            a = np.frombuffer(data, kind, int(size), at)
            at += a.nbytes
            if a.itemsize > 1:
                a = np.ascontiguousarray(a.view(np.uint8).reshape(a.itemsize, len(a)).T).view(a.dtype).ravel()
            parts.setdefault(name, []).append(a)
    return {k: np.concatenate(v) for k, v in parts.items()}


def dealt(kind: int, bucket: np.ndarray, columns: Columns) -> Iterator[pa.RecordBatch]:
    """Blob rows of the columns by bucket."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], {n: a[order] for n, a in columns.items()}
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for lo in range(0, len(cuts) - 1, 64):
        rows = [(int(bucket[i]), dumped({n: a[i:j] for n, a in columns.items()})) for i, j in zip(cuts[lo : lo + 64].tolist(), cuts[lo + 1 : lo + 65].tolist(), strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array([b for b, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], schema=BLOB_ARROW)


def one_blob(kind: int, bucket: int, columns: Columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([dumped(columns)], pa.binary())], schema=BLOB_ARROW)


def bucket_count(df: DataFrame, per_partition: int = 4) -> int:
    """Some buckets a shuffle partition: many bound a reader's memory, few keep blobs large."""
    return per_partition * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_bucket(df: DataFrame, *then: Column) -> DataFrame:
    """df with each bucket's rows in one partition, in order of bucket and `then`."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket", *then)


def per_bucket(blobs: DataFrame, of: Callable[..., Iterator[pa.RecordBatch]], schema: str = BLOB, named: bool = False) -> DataFrame:
    """Brings each bucket's blobs together and gives them, by kind, to `of`, one bucket at a time; named: and the bucket's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        for batch in batches:
            for kind, bucket, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != key:
                    if held:
                        yield from of(held, *[key] * named)
                    key, held = bucket, {}
                held.setdefault(kind, []).append(data)
        if held:
            yield from of(held, *[key] * named)

    return by_bucket(blobs.select("kind", "bucket", "data")).mapInArrow(run, schema)


def with_texts(texts: DataFrame, blobs: DataFrame, of: Callable[[Columns, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, buckets: int, finish: Callable[[], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """Meets texts (doc_id, text, ...) with the blobs of their bucket: pmod(xxhash64(doc_id), buckets).

    `of` gets a bucket's columns (empty if it has none) and some of its texts at a time. This is a
    join on doc_id that moves each text once and the other side in blobs.
    """
    names = texts.columns
    left = texts.withColumn("bucket", F.expr(f"int(pmod(xxhash64(doc_id), {buckets}))")).withColumn("data", F.lit(None).cast("binary"))
    right = blobs.select("bucket", "data", *(F.lit(None).cast(t).alias(n) for n, t in texts.dtypes))
    both = left.select("bucket", *names, "data").unionByName(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, raw, columns = None, [], None
        for batch in batches:
            buckets_of, data = batch.column("bucket").to_numpy(), batch.column("data")
            cuts = np.flatnonzero(np.concatenate([[True], buckets_of[1:] != buckets_of[:-1], [True]]))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if buckets_of[i] != key:
                    key, raw, columns = buckets_of[i], [], None
                part = data.slice(i, j - i)
                n = len(part) - part.null_count  # blobs come first
                if n:
                    raw += part.slice(0, n).to_pylist()
                if n < j - i:
                    if columns is None:
                        columns, raw = (loaded(raw) if raw else {}), []
                    rows = batch.slice(i + n, j - i - n)
                    yield from of(columns, pa.RecordBatch.from_arrays([rows.column(x) for x in names], names=names))
        if finish is not None:
            yield from finish()

    return by_bucket(both, F.col("data").isNull()).mapInArrow(run, schema)


def doc_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    """pmod(xxhash64(doc_id), buckets) of 64-bit ids, as Spark has it."""
    u = np.uint64
    p1, p2, p3, p4, p5 = u(0x9E3779B185EBCA87), u(0xC2B2AE3D27D4EB4F), u(0x165667B19E3779F9), u(0x85EBCA77C2B2AE63), u(0x27D4EB2F165667C5)
    turn = lambda x, r: (x << u(r)) | (x >> u(64 - r))
    with np.errstate(over="ignore"):
        h = u(42) + p5 + u(8)
        h = h ^ (turn(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = h ^ (h >> u(33))
        h = h * p2
        h = h ^ (h >> u(29))
        h = h * p3
        h = h ^ (h >> u(32))
    return np.mod(h.view(np.int64), buckets).astype(np.int32)
