"""Line dedup by an exact set-similarity join of all lines of all documents.

A line goes if an earlier line (smaller doc_id, or earlier in its document) has a set of words with
a Jaccard similarity of at least the threshold; all lines are judged on the input. Lines without a
word stay and match nothing.

1. Words are counted over all documents in a table of fixed size (a word counts with those of its
   slot); its logarithm is a word's rarity. Rarity, then hash, orders the words of every line alike.
2. Each line's distinct words are ordered rarest first. Lines of equal sets are one class: within a
   task all but the first go at once, and classes meet by two hashes of the set. The first of each
   class sends a row for every word of its prefix, n - ceil(t n) + 1 words: two sets that match share
   a word of both prefixes. A word that occurs once at all has no partner and sends none.
3. A word of more than `heavy` occurrences would gather too many lines. The first word that two sets
   share lies in both prefixes, and if they must share two, the second lies in both prefixes or one
   word behind; so such a word sends a row for each pair with a later one of these words instead.
4. Rows meet by word (or pair). Pairs whose sizes, whose places in the order, or whose parity marks
   (every differing word flips one of 64 bits, in long lines of 256) rule out the threshold are dropped.
   Of a line's candidates each task sends the NEAREST likeliest (fewest differing bits, then earliest):
   all pairs of a crowd of like lines would grow with its square. The task names the lines that have
   more, and keeps the rows of those pairs.
5. A later line's likeliest candidate is judged first, from all words of both; a line that it doesn't
   remove is judged against all others that were sent in a second round, and a line that is still left
   and has more against all of these in a third, in which the rows kept meet again. Lines are judged
   where the later one's document lies, and only documents with such lines are fetched: a broadcast of
   at most DOC_SLOTS hash slots tells them.
6. Each document that has lines to go (by such slots) meets them; the others pass unshuffled.

Words are known by 64-bit hashes, classes by two of them. Rows move as blobs (see blobs.py). Rows
with the same id are told apart by their texts' checksum; rows alike in both are one document,
so that none of its copies removes a line of another. Null
texts are empty, a null id keeps its text whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .blobs import BLOB, Columns, bucket_count, dealt, doc_bucket, loaded, one_blob, per_bucket, with_texts
from .common import durable, slices
from .words import ODD, byte_words, joined, mixed, word_hashes

SLOTS, PARTS, HELD, HEAVY, LONG, DOC_SLOTS = 1 << 22, 64, 1 << 18, 1 << 13, 112, 1 << 20
NEAREST = 4
GONE, CLASS, PREFIX, WIDE, HALF, PAIR, REST, MORE = range(8)
LINE = ("doc", "tag", "line")
ONCE = 8  # the rarity of a slot that counts one word


def string_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def collected(parts: DataFrame, column: str, missing: np.ndarray) -> np.ndarray:
    """A table of PARTS parts, of fixed size, from one blob a part."""
    found = {r.bucket: loaded([bytes(r.data)])[column] for r in parts.collect()}
    return np.concatenate([found.get(p, missing) for p in range(PARTS)])


def rarities(texts: DataFrame) -> np.ndarray:
    """floor(8 log2(1 + occurrences)) by slot of all words of all texts; one byte a slot reaches the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in slices(batch, 8 << 20):
                own = byte_words(joined(part.column("text").to_pylist())[0])[1]
                np.add.at(total, (own & np.uint64(SLOTS - 1)).astype(np.int64), 1)
        for p, part in enumerate(np.split(np.minimum(total, 2**32 - 1).astype(np.uint32), PARTS)):
            yield one_blob(0, p, {"counts": part})

    def summed(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS // PARTS, np.float64)
        for data in held[0]:
            total += loaded([data])["counts"]
        yield one_blob(0, 0, {"rarity": np.minimum(255, np.floor(8 * np.log2(1 + total))).astype(np.uint8)})

    return collected(numbered(texts.mapInArrow(counted, BLOB), summed), "rarity", np.zeros(SLOTS // PARTS, np.uint8))


def numbered(blobs: DataFrame, of) -> DataFrame:
    """per_bucket, with the bucket's number in the one blob that `of` gives."""
    named = blobs.select("kind", "bucket", F.concat(F.unhex(F.lpad(F.hex("bucket"), 4, "0")), "data").alias("data"))

    def run(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        bucket = int.from_bytes(held[0][0][:2], "big")
        for batch in of({0: [x[2:] for x in held[0]]}):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bucket], pa.int32()), batch.column(2)], schema=batch.schema)

    return per_bucket(named, run)


def with_slot(rows: DataFrame) -> DataFrame:
    return rows.withColumn("slot", F.expr(f"int(pmod(xxhash64(doc_id), {DOC_SLOTS}))"))


def slots_of(blobs: DataFrame) -> DataFrame:
    """The slots (at most DOC_SLOTS, by hash) of the documents that the blobs name, to be broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DOC_SLOTS, bool)
        for batch in batches:
            for data in batch.column("data").to_pylist():
                seen[doc_bucket(loaded([data])["doc"], DOC_SLOTS)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen).astype(np.int32))], names=["slot"])

    return F.broadcast(durable(blobs.mapInArrow(run, "slot int").distinct()))


def ordered_sets(own: np.ndarray, counts: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, rarity, line) of the distinct words of each of at most 2^20 lines, rarest first: rarity, then hash."""
    rare = rarity[own & np.uint64(SLOTS - 1)]
    line = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    keys = line << np.uint64(44) | rare.astype(np.uint64) << np.uint64(36) | own >> np.uint64(28)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    if (same & (own[order][1:] != own[order][:-1])).any():  # different words that the key doesn't tell apart
        order = np.lexsort((own, rare, line))
        same = (own[order][1:] == own[order][:-1]) & (line[order][1:] == line[order][:-1])
    order = order[np.concatenate([[True], ~same])[: len(order)]]
    return own[order], rare[order], line[order].astype(np.int64)


def prefix_length(n: np.ndarray, threshold: float) -> np.ndarray:
    """0 for sets so small that only an equal one can match."""
    p = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
    return np.where(n + 1e-9 >= threshold / (1 - threshold), p, 0) if threshold < 1 else np.zeros_like(n)


def line_rows(c: Columns, words: np.ndarray, line: np.ndarray) -> Columns:
    """Adds to each line its set size, two hashes of the set and its parity marks.

    A word's place among 256 bits is 64 times `quarter` and a rest; mark has the quarters folded upon
    each other, and w0 to w2 the first three alone (mark and they give the last).
    """
    n = np.bincount(line, minlength=len(c["doc"]))
    starts = np.cumsum(n) - n
    spread = mixed(words * ODD)
    bit, quarter = np.uint64(1) << (spread & np.uint64(63)), spread >> np.uint64(6) & np.uint64(3)
    fold = lambda x: np.bitwise_xor.reduceat(x, starts)
    wide = {f"w{q}": fold(np.where(quarter == q, bit, np.uint64(0))) for q in range(3)}
    return c | {"n": n, "start": starts, "a": np.add.reduceat(spread, starts), "b": fold(mixed(spread + ODD)), "mark": fold(bit)} | wide


def prefix_rows(c: Columns, lines: np.ndarray, words: np.ndarray, rare: np.ndarray, threshold: float, heavy: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, place, key) of the rows that these lines send: a light word, or a heavy one with a word behind it."""
    n = c["n"][lines]
    size = prefix_length(n, threshold)
    row = np.repeat(lines, size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    place, last = c["start"][row] + at, np.repeat(size, size)
    much, again = rare[place] >= 8 * np.log2(heavy), rare[place] > ONCE
    one = np.repeat(np.ceil(threshold * n - 1e-9) < 2, size)  # may match by a single word
    plain = np.flatnonzero(again & (one | ~much))
    pairs = np.flatnonzero(again & much)
    behind = np.minimum(last, c["n"][row] - 1)[pairs] - at[pairs]  # the words behind it, as far as one beyond the prefix
    first = np.repeat(pairs, behind)
    step = 1 + np.arange(len(first)) - np.repeat(np.cumsum(behind) - behind, behind)
    second = place[first] + step
    fine = rare[second] > ONCE
    first, second = first[fine], second[fine]
    pair = mixed(words[place[first]] * ODD + mixed(words[second]))
    rows = np.concatenate([plain, first])
    return row[rows], at[rows], np.concatenate([words[place[plain]], pair])


def dealt_lines(texts: DataFrame, rarity: np.ndarray, threshold: float, buckets: int, heavy: int) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(rarity)  # SLOTS bytes

    def worked(held: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
        data, ends = joined([t for t, _, _ in held])
        at, own = byte_words(data)
        breaks = np.append(np.flatnonzero(data == 10), len(data))
        lines = np.diff(np.searchsorted(breaks, ends, "right"), prepend=0)
        doc, tag = (np.repeat(np.array([h[i] for h in held], kind), lines) for i, kind in ((1, np.int64), (2, np.uint16)))
        number = (np.arange(len(breaks)) - np.repeat(np.cumsum(lines) - lines, lines)).astype(np.uint32)
        counts = np.diff(np.searchsorted(at, breaks), prepend=0)
        some = np.flatnonzero(counts)
        before = np.concatenate([[0], np.cumsum(counts)])
        for lo in range(0, len(some), 1 << 20):
            part = some[lo : lo + (1 << 20)]
            yield from sent_rows({"doc": doc[part], "tag": tag[part], "line": number[part]}, own[before[part[0]] : before[part[-1] + 1]], counts[part])

    def sent_rows(c: Columns, own: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        words, rare, line = ordered_sets(own, counts, sent.value)
        c = line_rows(c, words, line)
        order = np.lexsort((c["line"], c["tag"], c["doc"], c["b"], c["a"]))
        a, b = c["a"][order], c["b"][order]
        first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        gone, stays = behind_first(c, order, first), order[first]
        pick = lambda rows, *names: {k: c[k][rows] for k in names}
        yield from dealt(GONE, doc_bucket(c["doc"][gone], buckets), pick(gone, *LINE))
        yield from dealt(CLASS, (c["a"][stays] % np.uint64(buckets)).astype(np.int32), pick(stays, "a", "b", *LINE))
        row, at, key = prefix_rows(c, stays, words, rare, threshold, heavy)
        key = mixed(key)
        for kind, which in ((PREFIX, c["n"][row] < LONG), (WIDE, c["n"][row] >= LONG)):
            own_row, own_key = row[which], key[which]
            small = {"key": (own_key >> np.uint64(32)).astype(np.uint32), "a": c["a"][own_row].astype(np.uint32), "n": c["n"][own_row].astype(np.uint32), "at": at[which].astype(np.uint32)}
            yield from dealt(kind, (own_key % np.uint64(buckets)).astype(np.int32), small | pick(own_row, "mark", *LINE, *(("w0", "w1", "w2") if kind == WIDE else ())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if doc is None or not text:
                    continue
                held.append((text, doc, zlib.crc32(text.encode()) & 0xFFFF))
                size += len(text)
                if size > 5 << 20:
                    yield from worked(held)
                    held, size = [], 0
        if held:
            yield from worked(held)

    return texts.mapInArrow(run, BLOB)


def behind_first(c: Columns, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The rows that are not the first line of their class, nor that line of a repeated row."""
    head = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
    return order[np.any([c[k][order] != c[k][head] for k in LINE], axis=0)]


def candidate_pairs(c: Columns, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(earlier, later, differing mark bits) of rows that share a key and pass the size, place and mark filters.

    The rows from c["short"] on are those of long lines and have wide marks.
    """
    short = c["short"]
    key = c["key"].astype(np.uint64) << np.uint64(32) | c["n"]
    order = np.lexsort((c["line"], c["tag"], c["doc"], c["a"], c["mark"], key))
    k, mark, a = key[order], c["mark"][order], c["a"][order]
    same = (k[1:] == k[:-1]) & (mark[1:] == mark[:-1]) & (a[1:] == a[:-1])
    kept = np.concatenate([[True], ~same])[: len(order)]  # the first of a class stands for it
    order, k, mark = order[kept], k[kept], mark[kept]
    t, n, at = k >> np.uint64(32), (k & np.uint64(0xFFFFFFFF)).astype(np.int64), c["at"][order].astype(np.int64)
    alive, step = np.arange(len(order) - 1), 1
    while len(alive):  # neighbours at growing distance; a group is ordered by size, so it ends early
        alive = alive[alive + step < len(order)]
        near = (t[alive] == t[alive + step]) & (n[alive] + 1e-9 >= threshold * n[alive + step])
        alive = alive[near]
        x, y = alive, alive + step
        need = np.ceil(threshold / (1 + threshold) * (n[x] + n[y]) - 1e-9).astype(np.int64)
        other = mark[x] ^ mark[y]
        apart = np.bitwise_count(other).astype(np.uint16)
        both = np.flatnonzero((order[x] >= short) & (order[y] >= short))
        if len(both):
            p, q, last = order[x[both]] - short, order[y[both]] - short, other[both]
            total = np.zeros(len(both), np.uint16)
            for w in ("w0", "w1", "w2"):
                differ = c[w][p] ^ c[w][q]
                last = last ^ differ
                total += np.bitwise_count(differ)
            apart[both] = total + np.bitwise_count(last)
        fits = (np.minimum(n[x] - at[x], n[y] - at[y]) >= need) & (apart <= n[x] + n[y] - 2 * need)
        if fits.any():
            p, q = order[x[fits]], order[y[fits]]
            later = earlier(c, q, p)
            yield np.where(later, q, p), np.where(later, p, q), apart[fits]
        step += 1


def earlier(c: Columns, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (c["doc"][p] < c["doc"][q]) | ((c["doc"][p] == c["doc"][q]) & ((c["tag"][p] < c["tag"][q]) | ((c["tag"][p] == c["tag"][q]) & (c["line"][p] < c["line"][q]))))


class Nearest:
    """The likeliest pairs of each later line, at most `most`; which lines have more, and the rows of all those pairs."""

    def __init__(self, c: Columns, most: int):
        self.c, self.most, self.id = c, most, identity(c)
        self.pairs, self.size, self.limit = [], 0, HELD
        self.kept = np.zeros(len(c["n"]), bool)
        self.more = np.zeros(0, np.int64)

    def add(self, early: np.ndarray, late: np.ndarray, apart: np.ndarray) -> None:
        self.pairs.append((early, late, apart))
        self.size += len(early)
        if self.size > self.limit:
            self.cut()
            self.limit = HELD + 2 * self.size

    def cut(self) -> None:
        if not self.pairs:
            return
        early, late, apart = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        own, other, c = self.id[late], self.id[early], self.c
        order = np.lexsort((other, c["line"][early], c["tag"][early], c["doc"][early], apart, own))
        own, other = own[order], other[order]
        new = np.concatenate([[True], own[1:] != own[:-1]])
        once = new | np.concatenate([[True], other[1:] != other[:-1]])  # a pair may meet by several words
        order, new = order[once], new[once]
        starts = np.flatnonzero(new)
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        out = order[rank >= self.most]
        self.kept[early[out]] = self.kept[late[out]] = True
        more = np.concatenate([self.more, late[out]])
        self.more = more[np.unique(self.id[more], return_index=True)[1]]
        stay = order[rank < self.most]
        self.pairs, self.size = [(early[stay], late[stay], apart[stay])], len(stay)


def sent_pairs(c: Columns, early: np.ndarray, late: np.ndarray, apart: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    yield from dealt(PAIR, doc_bucket(c["doc"][late], buckets), {k: c[k][late] for k in LINE} | {f"e_{k}": c[k][early] for k in LINE} | {"apart": apart})


def loaded_rows(held: dict[int, list[bytes]]) -> Columns:
    """The columns of PREFIX and WIDE blobs; from c["short"] on those of long lines."""
    c = loaded(held.pop(PREFIX, []) + (wide := held.pop(WIDE, [])))
    return c | {"short": len(c["n"]) - (len(c["w0"]) if wide else 0)}


def kept_rows(c: Columns, kept: np.ndarray, bucket: int) -> Iterator[pa.RecordBatch]:
    """These rows as PREFIX and WIDE blobs of their bucket."""
    short = c["short"]
    common = [k for k in c if k not in ("short", "w0", "w1", "w2")]
    for kind, rows in ((PREFIX, np.flatnonzero(kept[:short])), (WIDE, short + np.flatnonzero(kept[short:]))):
        wide = {k: c[k][rows - short] for k in ("w0", "w1", "w2")} if kind == WIDE and len(rows) else {}
        yield from dealt(kind, np.full(len(rows), bucket, np.int32), {k: c[k][rows] for k in common} | wide)


def met(blobs: DataFrame, threshold: float, buckets: int, nearest: int = NEAREST) -> DataFrame:
    """Blobs by document: GONE, PAIR (the `nearest` of a later line at most) and MORE by the later line's, once or more a pair; by bucket: PREFIX and WIDE rows of the pairs left out."""

    def of(held: dict[int, list[bytes]], bucket: int) -> Iterator[pa.RecordBatch]:
        if GONE in held:
            c = loaded(held.pop(GONE))
            yield from dealt(GONE, doc_bucket(c["doc"], buckets), c)
        if CLASS in held:
            c = loaded(held.pop(CLASS))
            order = np.lexsort((c["line"], c["tag"], c["doc"], c["b"], c["a"]))
            a, b = c["a"][order], c["b"][order]
            gone = behind_first(c, order, np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            yield from dealt(GONE, doc_bucket(c["doc"][gone], buckets), {k: c[k][gone] for k in LINE})
        if PREFIX not in held and WIDE not in held:
            return
        c = loaded_rows(held)
        found = Nearest(c, nearest)
        for pairs in candidate_pairs(c, threshold):
            found.add(*pairs)
        found.cut()
        for pairs in found.pairs:
            yield from sent_pairs(c, *pairs, buckets)
        more = found.more
        yield from dealt(MORE, doc_bucket(c["doc"][more], buckets), {k: c[k][more] for k in LINE} | {"to": np.full(len(more), bucket, np.int32)})
        yield from kept_rows(c, found.kept, bucket)

    return per_bucket(blobs, of, named=True)


def met_again(rows: DataFrame, threshold: float, buckets: int) -> DataFrame:
    """PAIR blobs of all candidates, among the rows of the bucket, of the lines that its MORE blobs name."""

    def of(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        if MORE not in held or PREFIX not in held and WIDE not in held:
            return
        asked, c = np.unique(identity(loaded(held.pop(MORE)))), loaded_rows(held)
        open_ = np.isin(identity(c), asked)
        found, size = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            early, late, apart = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            _, one = np.unique(mixed(identity(c, early) * ODD + identity(c, late)), return_index=True)
            yield from sent_pairs(c, early[one], late[one], apart[one], buckets)

        for early, late, apart in candidate_pairs(c, threshold):
            which = open_[late]
            found.append((early[which], late[which], apart[which]))
            size += int(which.sum())
            if size > HELD:
                yield from sent()
                size = 0
        if size:
            yield from sent()

    return per_bucket(rows, of)


def identity(c: Columns, rows: np.ndarray | slice = slice(None), prefix: str = "") -> np.ndarray:
    """A 64-bit hash of (document, checksum, line)."""
    return mixed(c[f"{prefix}doc"][rows].astype(np.int64).view(np.uint64) * ODD + (c[f"{prefix}tag"][rows].astype(np.uint64) << np.uint64(32) | c[f"{prefix}line"][rows]))


def needs(c: Columns, buckets: int) -> Iterator[pa.RecordBatch]:
    """HALF blobs, by its own document, for each line that the bucket of these pairs' later lines must see."""
    to, late, early = doc_bucket(c["doc"], buckets), identity(c), identity(c, prefix="e_")
    own, to = np.concatenate([early, late]), np.tile(to, 2)
    _, first = np.unique(mixed(own + to.astype(np.uint64) * ODD), return_index=True)
    need = {k: np.concatenate([c[f"e_{k}"], c[k]])[first] for k in LINE}
    yield from dealt(HALF, doc_bucket(need["doc"], buckets), need | {"id": own[first], "to": to[first]})


def ranked_pairs(pairs: DataFrame, buckets: int, at_once: bool = False) -> DataFrame:
    """PAIR: each later line's likeliest candidate (at_once: all); REST: its others; HALF: the lines that PAIR needs; MORE, as it came."""

    def of(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        if MORE in held:
            c = loaded(held[MORE])
            yield from dealt(MORE, doc_bucket(c["doc"], buckets), c)
        c = loaded(held[PAIR])
        late, early = identity(c), identity(c, prefix="e_")
        order = np.lexsort((early, c["e_line"], c["e_tag"], c["e_doc"], c["apart"], late))
        late, early = late[order], early[order]
        new = np.concatenate([[True], late[1:] != late[:-1]])
        once = new | np.concatenate([[True], early[1:] != early[:-1]])
        best, rest = (order[once], order[:0]) if at_once else (order[new], order[once & ~new])
        pick = lambda rows: {k: v[rows] for k, v in c.items()}
        yield from dealt(PAIR, doc_bucket(c["doc"][best], buckets), pick(best))
        yield from dealt(REST, doc_bucket(c["doc"][rest], buckets), pick(rest))
        yield from needs(pick(best), buckets)

    return per_bucket(pairs, of)


class Own:
    """A bucket's columns by document; made anew when the bucket changes."""

    def __init__(self):
        self.c: Columns = {}

    def load(self, c: Columns) -> None:
        if self.c is not c:
            self.c = c
            self.order = np.argsort(c["doc"], kind="stable") if c else np.zeros(0, np.int64)
            self.docs = c["doc"][self.order] if c else np.zeros(0, np.int64)
            self.known = set(self.docs.tolist())

    def rows(self, doc: int, text: str) -> np.ndarray:
        if doc not in self.known:
            return self.order[:0]
        rows = self.order[np.searchsorted(self.docs, doc, "left") : np.searchsorted(self.docs, doc, "right")]
        return rows[self.c["tag"][rows] == zlib.crc32(text.encode()) & 0xFFFF]


class Sets:
    """The word sets of a bucket's lines, by line."""

    def __init__(self, blobs: list[bytes]):
        parts = [loaded([x]) for x in blobs]
        ids = np.concatenate([x["id"] for x in parts]) if parts else np.zeros(0, np.uint64)
        counts = np.concatenate([x["count"] for x in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        words = np.concatenate([x["words"][x["codes"]] for x in parts]) if parts else np.zeros(0, np.uint64)
        self.ids, first = np.unique(ids, return_index=True)
        self.start, self.count = (np.cumsum(counts) - counts)[first], counts[first]
        self.codes = np.unique(words, return_inverse=True)[1].astype(np.uint64)

    def similar(self, early: np.ndarray, late: np.ndarray, threshold: float) -> np.ndarray:
        """Whether each pair reaches the threshold; a line that isn't there reaches none."""
        out = np.zeros(len(early), bool)
        if not len(self.ids):
            return out
        x, y = (np.minimum(np.searchsorted(self.ids, k), len(self.ids) - 1) for k in (early, late))
        there = np.flatnonzero((self.ids[x] == early) & (self.ids[y] == late))
        total = np.cumsum(self.count[x[there]] + self.count[y[there]])
        lo = 0
        while lo < len(there):  # about HELD words at a time
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + HELD, "right")))
            rows = there[lo:hi]
            sides, pair = np.concatenate([x[rows], y[rows]]), np.tile(np.arange(len(rows)), 2)
            n = self.count[sides]
            at = np.repeat(self.start[sides] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            keys = np.sort(np.repeat(pair, n).astype(np.uint64) << np.uint64(32) | self.codes[at])
            common = np.bincount((keys[1:][keys[1:] == keys[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(rows))
            out[rows] = common + 1e-9 >= threshold * (self.count[x[rows]] + self.count[y[rows]] - common)
            lo = hi
        return out


def fetched(texts: DataFrame, asked: DataFrame, buckets: int) -> DataFrame:
    """HALF blobs (word sets of lines) by the bucket that asked for them."""
    own = Own()

    def of(c: Columns, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not c:
            return
        own.load(c)
        lines, found = [], []
        for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
            mine = own.rows(doc, text)
            if len(mine):
                split = text.split("\n")
                lines += [split[k] for k in c["line"][mine].tolist()]
                found.append(mine)
        if not found:
            return
        mine = np.concatenate(found)
        own_words, counts = word_hashes(lines)
        line = np.repeat(np.arange(len(lines)), counts)
        order = np.lexsort((own_words, line))
        own_words, line = own_words[order], line[order]
        once = np.concatenate([[True], (own_words[1:] != own_words[:-1]) | (line[1:] != line[:-1])])[: len(line)]
        own_words, counts = own_words[once], np.bincount(line[once], minlength=len(lines))
        starts = np.cumsum(counts) - counts
        order = np.argsort(c["to"][mine], kind="stable")
        to = c["to"][mine][order]
        cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = order[i:j]
            n = counts[part]
            used, small = np.unique(own_words[np.repeat(starts[part] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], return_inverse=True)
            kind = np.uint16 if len(used) < 1 << 16 else np.uint32
            yield one_blob(HALF, int(to[i]), {"id": c["id"][mine[part]], "count": n.astype(np.uint32), "words": used, "codes": small.astype(kind)})

    return with_texts(with_slot(texts).join(slots_of(asked), "slot", "left_semi").drop("slot"), asked, of, BLOB, buckets)


def judged(texts: DataFrame, pairs: DataFrame, threshold: float, buckets: int) -> DataFrame:
    """GONE blobs of the later lines of PAIRs that hold up; of the others the RESTs, as PAIR and HALF blobs, and MORE."""

    def of(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        if PAIR not in held:  # no other candidates were sent of the lines that have more
            if MORE in held:
                c = loaded(held[MORE])
                yield from dealt(MORE, doc_bucket(c["doc"], buckets), c)
            return
        sets, c = Sets(held.pop(HALF, [])), loaded(held.pop(PAIR))
        late = identity(c)
        fits = sets.similar(identity(c, prefix="e_"), late, threshold)
        _, gone = np.unique(late[fits], return_index=True)
        gone = np.flatnonzero(fits)[gone]
        yield from dealt(GONE, doc_bucket(c["doc"][gone], buckets), {k: c[k][gone] for k in LINE})
        for kind, as_kind in ((REST, PAIR), (MORE, MORE)):
            if kind in held:
                more = loaded(held.pop(kind))
                open_ = np.flatnonzero(~np.isin(identity(more), late[fits]))
                more = {k: v[open_] for k, v in more.items()}
                yield from dealt(as_kind, doc_bucket(more["doc"], buckets), more)
                if kind == REST and len(open_):
                    yield from needs(more, buckets)

    return per_bucket(fetched(texts, pairs.where(f"kind = {HALF}"), buckets).unionByName(pairs.where(f"kind <> {HALF}").select("kind", "bucket", "data")), of)


def lines_gone(texts: DataFrame, threshold: float, heavy: int, nearest: int, buckets: int) -> DataFrame:
    """GONE blobs of all lines that go."""
    first = durable(met(dealt_lines(texts, rarities(texts), threshold, buckets, heavy), threshold, buckets, nearest))
    asked = durable(ranked_pairs(first.where(f"kind in ({PAIR}, {MORE})"), buckets))
    once = durable(judged(texts, asked, threshold, buckets))
    twice = durable(judged(texts, once.where(f"kind <> {GONE}"), threshold, buckets))
    gone = [first, once, twice]
    left = durable(twice.where(f"kind = {MORE}").mapInArrow(to_named, BLOB))
    if not left.isEmpty():
        again = durable(ranked_pairs(met_again(first.where(f"kind in ({PREFIX}, {WIDE})").unionByName(left), threshold, buckets), buckets, at_once=True))
        gone.append(durable(judged(texts, again, threshold, buckets)))
    out = gone[0]
    for x in gone[1:]:
        out = out.unionByName(x)
    return out.where(f"kind = {GONE}")


def to_named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MORE blobs, to the buckets that they name."""
    for batch in batches:
        for data in batch.column("data").to_pylist():
            c = loaded([data])
            yield from dealt(MORE, c["to"], {k: c[k] for k in LINE})


def dedup_lines(docs: DataFrame, threshold: float = 0.8, heavy: int = HEAVY, nearest: int = NEAREST) -> DataFrame:
    """(doc_id, text, rest, n_lines, n_removed): text without the lines that go, the others joined as they were.

    A text all of whose lines go is empty. rest is a struct of the other columns, whatever their
    names, as they came (null if there are none).
    """
    texts, buckets = string_texts(docs), bucket_count(docs, 1)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.lit(None).cast("string")
    gone = lines_gone(texts, threshold, heavy, nearest, buckets)
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), rest.alias("rest"))
    schema = T.StructType([*whole.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    out, own = to_arrow_schema(schema), Own()

    def cut(c: Columns, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own.load(c)
        ids, n, removed, kept = rows.column("doc_id").to_pylist(), [], [], []
        for doc, text in zip(ids, rows.column("text").to_pylist(), strict=True):
            mine = own.rows(doc, text)
            n.append(text.count("\n") + 1 if text else 0)
            if len(mine):
                gone = set(c["line"][mine].tolist())
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
                removed.append(len(gone))
            else:
                removed.append(0)
            kept.append(text)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(kept, out.field("text").type), rows.column("rest"), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], schema=out)

    whole, slots = with_slot(whole), slots_of(gone)
    lines = F.when(F.col("text") == "", 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    calm = whole.join(slots, "slot", "left_anti").select("doc_id", "text", "rest", lines.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    return with_texts(whole.join(slots, "slot", "left_semi").drop("slot"), gone, cut, schema, buckets).unionByName(calm)
