"""Exact repeats of `length` bytes over all documents, by suffix arrays of what could repeat.

A byte goes if a string of `length` bytes that covers it also starts earlier: in a document with a
smaller id, or earlier in its own. All strings are judged on the input.

1. Anchors. Each string picks the least hash among its k-byte pieces, the last of equals, so equal
   strings pick the same piece. The strings of a document that pick one piece in one place follow
   each other; they make a stretch of the document, and every string lies in exactly one stretch.
   Equal strings lie in stretches whose pieces are equal.
2. Stretches with equal pieces meet by the piece's hash. A piece seen once ends there. Of stretches
   that are equal in full (two 64-bit hashes), all but the earliest go at once, those within one
   task before the shuffle already. What stays, one stretch of each content, goes on if its piece
   has several contents.
3. Those stretches' bytes are fetched, again met by piece, and sorted in blocks by a suffix array of
   two stages; neighbours' common prefixes of `length` bytes tell which strings are equal, and all
   but the earliest of them go. A piece with more than `crowd` contents would make too large a
   block: its strings meet by two 64-bit hashes instead, again all of them.
4. Each document meets the starts of its strings that go, and its covered bytes are cut.

Rows with the same id are told apart by their texts' checksum and come in its order; rows alike in
both are judged alike. A null text is empty, a null id keeps its text whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import BLOB, Columns, bucket_count, dealt, doc_bucket, loaded, one_blob, per_bucket, with_texts
from .common import arrow_schema, durable, release, slices
from .suffix_sort import common_prefix_at_least, suffix_array, words_at
from .words import ODD, mixed

PIECE, CHUNK, HELD, BLOCK_BYTES, CROWD = 24, 1 << 19, 1 << 20, 3 << 20, 20_000
BASE = np.uint64(0xD6E8FEB86659FD93)
GONE, STRETCH, NEED, CONTENT, STRING = 0, 1, 2, 3, 4


class Roller:
    """Hashes of any part of a chunk: differences of prefix sums over powers of an odd base."""

    def __init__(self, longest: int):
        self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(longest, BASE))])
        self.inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(longest, np.uint64(pow(int(BASE), -1, 2**64))))])

    def load(self, text: np.ndarray) -> None:
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.power[: len(text)])])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]


def last_least(x: np.ndarray, width: int) -> np.ndarray:
    """For each window of width values the place of its least one, the last of equals."""
    at, values, span = np.arange(len(x), dtype=np.int32), x, 1

    def merged(by: int) -> None:
        nonlocal at, values
        later = values[by:] <= values[:-by]
        at = np.where(later, at[by:], at[:-by])
        values = np.where(later, values[by:], values[:-by])

    while 2 * span <= width:
        merged(span)
        span *= 2
    if width > span:
        merged(width - span)
    return at


def stretches(text: np.ndarray, ends: np.ndarray, length: int, roller: Roller) -> tuple[np.ndarray, ...]:
    """(first string, strings, hash of the piece, hash of the content) of each stretch of a chunk.

    ends: for each byte, where its document ends in the chunk (or beyond it).
    """
    if len(text) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    roller.load(text)
    pieces = np.arange(len(text) - PIECE + 1)
    hashes = mixed(roller.of(pieces, pieces + PIECE))
    picked = last_least(hashes, length - PIECE + 1)
    whole = np.flatnonzero(np.arange(len(picked)) + length <= ends[: len(picked)])
    picked = picked[whole]
    new = np.flatnonzero(np.concatenate([[True], (picked[1:] != picked[:-1]) | (whole[1:] != whole[:-1] + 1)])[: len(whole)])
    lo, n = whole[new], np.diff(np.append(new, len(whole)))
    content = mixed(roller.of(lo, lo + n - 1 + length) ^ (n.astype(np.uint64) * ODD))
    return lo, n, hashes[picked[new]], content


def first_of_each(keys: tuple[np.ndarray, ...], c: Columns) -> tuple[np.ndarray, np.ndarray]:
    """(order of rows by keys, then document and place; whether each, so ordered, is the first of its keys)."""
    order = np.lexsort((c["lo"], c["tag"], c["doc"], *keys))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, new


def binary_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def taken(c: Columns, rows: np.ndarray, *names: str) -> Columns:
    return {n: c[n][rows] for n in names}


def found_stretches(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """Blobs: STRETCH by piece, and GONE by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, held, rows = Roller(CHUNK + 2 * length), [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            if held:
                c = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
                held.clear()
                rows = 0
                order, first = first_of_each((c["content"], c["piece"]), c)
                gone, stays = order[~first], order[first]
                yield from dealt(GONE, doc_bucket(c["doc"][gone], buckets), taken(c, gone, "doc", "tag", "lo", "n"))
                yield from dealt(STRETCH, (c["piece"][stays] % np.uint64(buckets)).astype(np.int32), taken(c, stays, "piece", "content", "doc", "tag", "lo", "n"))

        for batch in batches:
            for part in slices(batch, 4 << 20):
                part = part.filter(part.column("doc_id").is_valid())
                if not part.num_rows:
                    continue
                raws = part.column("text").to_pylist()
                ids, tags = part.column("doc_id").to_numpy(), np.array([zlib.crc32(r) for r in raws], np.uint32)
                size = np.array([len(r) for r in raws])
                stop = np.cumsum(size)
                text = np.frombuffer(b"".join(raws), np.uint8)
                ends = np.repeat(stop, size)
                for at in range(0, max(1, len(text) - length + 1), CHUNK):
                    piece_of = slice(at, at + CHUNK + length - 1)
                    lo, n, piece, content = stretches(text[piece_of], ends[piece_of] - at, length, roller)
                    if len(lo):
                        own = np.searchsorted(stop, lo + at, "right")
                        held.append({"piece": piece, "content": content, "doc": ids[own], "tag": tags[own], "lo": (lo + at - stop[own] + size[own]).astype(np.uint32), "n": n.astype(np.uint16)})
                        rows += len(lo)
                if rows > HELD:
                    yield from flushed()
        yield from flushed()

    return texts.mapInArrow(run, BLOB)


def met_by_piece(blobs: DataFrame, buckets: int, crowd: int) -> DataFrame:
    """Blobs by document: GONE, and NEED for the contents that other contents share a piece with."""

    def of(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        if GONE in held:
            c = loaded(held[GONE])
            yield from dealt(GONE, doc_bucket(c["doc"], buckets), c)
        if STRETCH not in held:
            return
        c = loaded(held[STRETCH])
        by_piece = np.sort(c["piece"])
        again = by_piece[1:][by_piece[1:] == by_piece[:-1]]
        some = np.flatnonzero(np.isin(c["piece"], again))
        c = taken(c, some, *c)
        order, first = first_of_each((c["content"], c["piece"]), c)
        gone, stays = order[~first], order[first]
        yield from dealt(GONE, doc_bucket(c["doc"][gone], buckets), taken(c, gone, "doc", "tag", "lo", "n"))
        _, inverse, contents = np.unique(c["piece"][stays], return_inverse=True, return_counts=True)
        need = stays[contents[inverse] > 1]
        crowded = (contents[inverse] > crowd)[contents[inverse] > 1]
        yield from dealt(NEED, doc_bucket(c["doc"][need], buckets), taken(c, need, "doc", "tag", "lo", "n", "piece") | {"crowded": crowded})

    return per_bucket(blobs, of)


def own_rows(c: Columns, order: np.ndarray, doc: int, tag: int) -> np.ndarray:
    """Rows of c (ordered by doc, then tag) of a document."""
    docs = c["doc"]
    i, j = np.searchsorted(docs, doc, "left", sorter=order), np.searchsorted(docs, doc, "right", sorter=order)
    rows = order[i:j]
    return rows[c["tag"][rows] == tag]


def fetched(texts: DataFrame, blobs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Blobs: CONTENT by piece (with the stretches' bytes), STRING by hash."""
    memo: dict[str, object] = {}
    held: list[tuple] = []

    def out(every: bool) -> Iterator[pa.RecordBatch]:
        if not held or not (every or sum(len(h[-1]) for h in held) > 8 << 20):
            return
        names = ("doc", "tag", "lo", "n", "piece", "crowded")
        c = {n: np.concatenate([h[i] for h in held]) for i, n in enumerate(names)}
        raw = np.concatenate([h[-1] for h in held])
        held.clear()
        size = c["n"].astype(np.int64) + length - 1
        start = np.cumsum(size) - size
        bucket = (c["piece"] % np.uint64(buckets)).astype(np.int32)
        calm = np.flatnonzero(~c["crowded"])
        order = calm[np.argsort(bucket[calm], kind="stable")]
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]])) if len(order) else []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True) if len(order) else ():
            rows = order[i:j]
            data = np.concatenate([raw[start[r] : start[r] + size[r]] for r in rows])
            yield one_blob(CONTENT, int(bucket[rows[0]]), taken(c, rows, "doc", "tag", "lo", "n", "piece") | {"bytes": data})
        hot = np.flatnonzero(c["crowded"])
        if len(hot):
            roller = Roller(int(size[hot].max()))
            parts = []
            for r in hot:
                roller.load(raw[start[r] : start[r] + size[r]])
                at = np.arange(int(c["n"][r]))
                one_hash = roller.of(at, at + length)
                two = np.array([zlib.crc32(raw[start[r] + k : start[r] + k + length]) for k in at.tolist()], np.uint64)
                parts.append({"a": mixed(one_hash), "b": two, "doc": np.repeat(c["doc"][r], len(at)), "tag": np.repeat(c["tag"][r], len(at)), "lo": (c["lo"][r] + at).astype(np.uint32)})
            w = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            order, first = first_of_each((w["b"], w["a"]), w)
            gone, stays = order[~first], order[first]
            yield from dealt(GONE, doc_bucket(w["doc"][gone], buckets), taken(w, gone, "doc", "tag", "lo") | {"n": np.ones(len(gone), np.uint16)})
            yield from dealt(STRING, (w["a"][stays] % np.uint64(buckets)).astype(np.int32), taken(w, stays, *w))

    def of(c: Columns, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not c:
            return
        if memo.get("c") is not c:
            memo["c"], memo["order"], memo["known"] = c, np.argsort(c["doc"], kind="stable"), set(c["doc"].tolist())
        done = memo.setdefault("done", set()) if memo.get("last") is c else set()
        memo["last"], memo["done"] = c, done
        for doc, raw in zip(rows.column("doc_id").to_pylist(), rows.column("text"), strict=True):
            if doc not in memo["known"]:
                continue
            raw = raw.as_py()
            tag = zlib.crc32(raw)
            if (doc, tag) in done:
                continue
            done.add((doc, tag))
            own = own_rows(c, memo["order"], doc, tag)
            if len(own):
                text = np.frombuffer(raw, np.uint8)
                size = c["n"][own].astype(np.int64) + length - 1
                data = np.concatenate([text[a : a + b] for a, b in zip(c["lo"][own].tolist(), size.tolist(), strict=True)])
                held.append((c["doc"][own], c["tag"][own], c["lo"][own], c["n"][own], c["piece"][own], c["crowded"][own], data))
        yield from out(False)

    return with_texts(texts, blobs, of, BLOB, buckets, lambda: out(True))


def repeated_strings(c: Columns, length: int) -> Columns:
    """GONE columns of contents (doc, tag, lo, n, bytes) that share pieces: one suffix array over all."""
    size = c["n"].astype(np.int64) + length - 1
    start = np.cumsum(size + 1) - size - 1
    text = np.full(int((size + 1).sum()), 255, np.uint8)
    text[np.arange(len(c["bytes"])) + np.repeat(np.arange(len(size)), size)] = c["bytes"]
    owner = np.full(len(text), -1, np.int32)
    n = c["n"].astype(np.int64)
    strings = np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    owner[strings] = np.repeat(np.arange(len(n), dtype=np.int32), n)
    at = suffix_array(text, length + 4)
    at = at[owner[at] >= 0]
    same = common_prefix_at_least(at, words_at(text), length)
    who = owner[at]
    ranks = np.empty(len(n), np.int64)
    ranks[np.lexsort((c["lo"], c["tag"], c["doc"]))] = np.arange(len(n))
    place = (ranks[who] << 20) + (at - start[who])
    runs = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(place, runs), np.diff(np.append(runs, len(at))))
    gone = np.sort(place[place != least])
    by_rank = np.argsort(ranks)
    own, off = by_rank[gone >> 20], gone & ((1 << 20) - 1)
    new = np.flatnonzero(np.concatenate([[True], np.diff(gone) != 1])[: len(gone)])
    return taken(c, own[new], "doc", "tag") | {"lo": (c["lo"][own[new]] + off[new]).astype(np.uint32), "n": np.diff(np.append(new, len(gone))).astype(np.uint16)}


def met_in_blocks(blobs: DataFrame, length: int, buckets: int) -> DataFrame:
    """GONE blobs by document from CONTENT and STRING blobs."""

    def of(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        if GONE in held:
            c = loaded(held[GONE])
            yield from dealt(GONE, doc_bucket(c["doc"], buckets), c)
        if STRING in held:
            c = loaded(held[STRING])
            order, first = first_of_each((c["b"], c["a"]), c)
            gone = order[~first]
            yield from dealt(GONE, doc_bucket(c["doc"][gone], buckets), taken(c, gone, "doc", "tag", "lo") | {"n": np.ones(len(gone), np.uint16)})
        if CONTENT in held:
            c = loaded(held[CONTENT])
            size = c["n"].astype(np.int64) + length - 1
            start = np.cumsum(size) - size
            order = np.argsort(c["piece"], kind="stable")
            ends = np.flatnonzero(np.concatenate([c["piece"][order][1:] != c["piece"][order][:-1], [True]])) + 1
            total = np.cumsum(size[order])
            i = 0
            while i < len(order):  # whole pieces, about BLOCK_BYTES together
                fit = ends[ends > i]
                limit = (total[i - 1] if i else 0) + BLOCK_BYTES
                j = int(fit[max(0, np.searchsorted(total[fit - 1], limit, "right") - 1)])
                rows = order[i:j]
                data = np.concatenate([c["bytes"][start[r] : start[r] + size[r]] for r in rows.tolist()])
                gone = repeated_strings(taken(c, rows, "doc", "tag", "lo", "n") | {"bytes": data}, length)
                yield from dealt(GONE, doc_bucket(gone["doc"], buckets), gone)
                i = j

    return per_bucket(blobs, of)


def remove_repeats(docs: DataFrame, length: int = 100, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes long, kept binary, removed array<struct<start, stop>>) of each document.

    removed: the maximal removed runs, in bytes of the text's UTF-8, in order.
    """
    texts, buckets = binary_texts(docs), bucket_count(docs)
    first = durable(met_by_piece(found_stretches(texts, length, buckets), buckets, crowd))
    release(docs.sparkSession)
    second = durable(met_in_blocks(fetched(texts, first.where(f"kind = {NEED}"), length, buckets), length, buckets))
    release(docs.sparkSession)
    gone = first.where(f"kind = {GONE}").unionByName(second)
    schema = "doc_id long, n_bytes long, kept binary, removed array<struct<start: long, stop: long>>"
    out = arrow_schema(schema)
    memo: dict[str, object] = {}

    def of(c: Columns, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if c and memo.get("c") is not c:
            memo["c"], memo["order"], memo["known"] = c, np.argsort(c["doc"], kind="stable"), set(c["doc"].tolist())
        ids, kept, removed, sizes = rows.column("doc_id").to_pylist(), [], [], []
        for doc, raw in zip(ids, rows.column("text").to_pylist(), strict=True):
            runs: list[dict] = []
            if c and doc in memo["known"]:
                own = own_rows(c, memo["order"], doc, zlib.crc32(raw))
                lo = np.sort(c["lo"][own].astype(np.int64) << 16 | c["n"][own])
                for start, stop in zip((lo >> 16).tolist(), ((lo >> 16) + (lo & 0xFFFF) - 1 + length).tolist(), strict=True):
                    if runs and start <= runs[-1]["stop"]:
                        runs[-1]["stop"] = max(stop, runs[-1]["stop"])
                    else:
                        runs.append({"start": start, "stop": stop})
            sizes.append(len(raw))
            removed.append(runs)
            at, parts = 0, []
            for r in runs:
                parts.append(raw[at : r["start"]])
                at = r["stop"]
            kept.append(b"".join([*parts, raw[at:]]) if runs else raw)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, out.field("removed").type)], schema=out)

    return with_texts(texts, gone, of, schema, buckets)
