"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

fit() learns a rotation from a bounded sample: principal axes, then iterative quantisation, which
alternates between codes (signs) and the orthogonal map nearest to them. Several such rotations from
different starts give a code of `bits` bits. stored_index() writes every vector's code once, in
blocks of bounded size; in a block each of the code's m substrings is indexed by its value. A query
with radius r looks up, for each substring, the values within its own radius: the radii add up to
r - m + 1, so by the pigeonhole principle every code within r of the query's is among those found.
The codes found within r are ranked by their vectors' distance in double precision, ties to the
smaller id. Rows that share an id count once, by the nearest of them, before anything is counted
towards k or cut.

The radius is the one that held `recall` of the sample's true neighbours; in a sample neighbours are
farther than among all rows, so it errs to the wide side. A query that finds fewer than k ids in a
block has its radius doubled there until it has k or the whole block.

Queries go in blocks of at most `block` vectors, one after the other: each is broadcast (its size is
bounded), meets the stored index, and its results are written before the next one, so that neither
the driver nor an executor holds more than one. Each index block answers with k ids a query at most.

Vectors that are null, zero or hold null or non-finite components take no part; between vectors of
different lengths there is no distance, so those of another length than most of the sample take none
either. An empty index gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blobs import dumped, loaded
from .common import arrow_schema, durable

SAMPLE, QUERY_BLOCK, INDEX_BLOCK, PART = 4000, 1 << 14, 1 << 15, 16


@dataclass(frozen=True)
class Coder:
    mean: np.ndarray
    turn: np.ndarray
    radius: int

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """uint16 substrings (n, bits / 16)."""
        return np.packbits((x - self.mean) @ self.turn > 0, axis=1).view(np.uint16)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(v.isNotNull() & F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def rotation(x: np.ndarray, seed: int, steps: int = 30) -> np.ndarray:
    """Principal axes, then the orthogonal map that iterative quantisation settles on."""
    _, axes = np.linalg.eigh(x.T @ x)
    z = x @ axes
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))
    for _ in range(steps):
        u, _, w = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
        r = (u @ w).T
    return axes @ r


def fit(rows: DataFrame, k: int = 10, bits: int = 256, recall: float = 0.97, sample: int = SAMPLE) -> Coder | None:
    """From at most `sample` usable vectors, one an id, of the ids with the least hash."""
    least = rows.select("vec_id").distinct().orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    one = rows.join(F.broadcast(least), "vec_id").groupBy("vec_id").agg(F.min("v").alias("v"))
    taken = one.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").collect()
    size = max((len(r.v) for r in taken), key=[len(r.v) for r in taken].count, default=0)
    x = np.array([r.v for r in taken if len(r.v) == size], np.float64)
    if not len(x):
        return None
    mean = x.mean(0)
    turns = [rotation(x - mean, seed) for seed in range(-(-bits // size))]
    coder = Coder(mean, np.concatenate(turns, axis=1)[:, : max(PART, bits // PART * PART)], 0)
    if coder.bits % PART:
        coder = Coder(mean, np.concatenate([coder.turn] * PART, axis=1)[:, : coder.bits // PART * PART + PART], 0)
    codes, far = coder.codes(x), []
    for i in range(0, len(x), max(1, len(x) // 200)):
        d = ((x - x[i]) ** 2).sum(1)
        near = [j for j in np.argsort(d, kind="stable")[: k + 1] if j != i][:k]
        far += np.bitwise_count(codes[near] ^ codes[i]).sum(1).tolist()
    return Coder(mean, coder.turn, int(np.quantile(far, recall)) if far else coder.bits)


@cache
def masks(radius: int) -> np.ndarray:
    """The values of a substring within radius of zero."""
    every = np.arange(1 << PART, dtype=np.uint16)
    return every[np.bitwise_count(every) <= radius]


class Block:
    """An index block: for each substring, the rows ordered by its value, and where each value starts."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, orders: np.ndarray):
        self.ids, self.vectors, self.codes, self.orders = ids, vectors, codes, orders
        self.repeats = len(np.unique(ids)) < len(ids)
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(c, minlength=1 << PART))]) for c in codes.T]

    @staticmethod
    def written(ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray) -> bytes:
        orders = np.argsort(codes, axis=0, kind="stable").T.astype(np.int32)
        return dumped({"ids": ids, "vectors": vectors.ravel(), "codes": codes.ravel(), "orders": orders.ravel()})

    @staticmethod
    def read(data: bytes) -> Block:
        c = loaded([data])
        n = len(c["ids"])
        return Block(c["ids"], c["vectors"].reshape(n, -1), c["codes"].reshape(n, -1), c["orders"].reshape(-1, n))

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows that share with code, in some substring, a value within that substring's radius."""
        m, seen = len(self.starts), np.zeros(len(self.ids), bool)
        each, more = divmod(radius - m + 1, m)
        for j, (order, starts) in enumerate(zip(self.orders, self.starts, strict=True)):
            own = min(PART, each + (j < more))
            if own < 0:
                continue
            values = masks(own) ^ code[j]
            lo, n = starts[values], starts[values.astype(np.int64) + 1] - starts[values]
            lo, n = lo[n > 0], n[n > 0]
            seen[order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]] = True
        return np.flatnonzero(seen)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within radius: pigeonhole probes, then the whole code."""
        rows = self.probed(code, radius)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1) <= radius]

    def distinct(self, rows: np.ndarray) -> int:
        return len(np.unique(self.ids[rows])) if self.repeats else len(rows)

    def search(self, q_id: int, q: np.ndarray, code: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        while True:
            rows = self.within(code, radius)
            rows = rows[self.ids[rows] != q_id]
            if self.distinct(rows) >= k or radius >= PART * len(self.starts):
                break
            radius = min(2 * radius + 1, PART * len(self.starts))
        d = np.sqrt(((self.vectors[rows] - q) ** 2).sum(1))
        best = np.lexsort((self.ids[rows], d))
        if self.repeats:
            best = best[np.sort(np.unique(self.ids[rows][best], return_index=True)[1])]
        best = best[:k]
        return self.ids[rows][best], d[best]


def stored_index(rows: DataFrame, coder: Coder, block: int = INDEX_BLOCK) -> DataFrame:
    """One row a block (data binary), written once: ids, vectors, codes and each substring's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flushed() -> pa.RecordBatch:
            ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([Block.written(ids, x, coder.codes(x))], pa.binary())], names=["data"])

        for batch in batches:
            held.append((batch.column("vec_id").to_numpy(), batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)))
            if sum(len(h[0]) for h in held) >= block:
                yield flushed()
        if held and sum(len(h[0]) for h in held):
            yield flushed()

    return durable(rows.repartition(F.xxhash64("vec_id")).mapInArrow(run, "data binary"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, bits: int = 256, recall: float = 0.97, block: int = QUERY_BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each query; never the query's own id.

    Queries that share an id are taken as one query by each of their vectors, and their results are merged.
    """
    schema = "query_id long, vec_id long, score double"
    out = arrow_schema(schema)
    rows = usable(vectors, id_col, vector_col)
    coder = fit(rows, k, bits, recall)
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if coder is None:
        return empty
    size = len(coder.mean)
    asked = durable(usable(queries, id_col, vector_col).where(F.size("v") == size))
    blocks = -(-asked.count() // block)
    index, found = stored_index(rows.where(F.size("v") == size), coder), [empty]
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()  # about `block` rows
        q_ids = np.array([r.vec_id for r in part], np.int64)
        qs = np.array([r.v for r in part], np.float64).reshape(-1, size)
        sent = vectors.sparkSession.sparkContext.broadcast((q_ids, qs, coder.codes(qs)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, points, codes = sent.value
            for batch in batches:
                for data in batch.column("data"):
                    held = Block.read(data.as_py())
                    for lo in range(0, len(ids), 512):
                        hits = [held.search(int(i), q, c, coder.radius, k) for i, q, c in zip(ids[lo : lo + 512], points[lo : lo + 512], codes[lo : lo + 512], strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo : lo + 512], [len(h[0]) for h in hits])), pa.array(np.concatenate([h[0] for h in hits])), pa.array(np.concatenate([h[1] for h in hits]))], schema=out)

        every = index.mapInArrow(run, schema).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        found.append(durable(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")))
        sent.destroy()
    return reduce(DataFrame.unionByName, found)
