"""Byte-level BPE as a monoid: texts are halved, the halves encoded, neighbours joined up the tree.

An element is a text's list of pattern matches with each match's ids. Two halves join by cutting
anew a window around their border, until what lies outside provably stays as it is:

* Left of the window. The pattern runs from left to right and never looks back, so a match of the
  left half that starts where a match of the whole text starts is the whole text's match too, once
  what it has read lies in the left half: its own characters, one more (the class that ends a run,
  or the look-ahead), and at least three for the contractions. Matches that read beyond the border
  go into the window.
* Right of the window. Once a match of the window, settled in that sense, starts where a match of
  the right half starts, both go on alike from there. Until then the window takes twice as many
  matches of the right half; the whole half at most.

The proof is of PATTERN; other patterns are refused.

Ids follow: each match is encoded by itself, so matches outside the window keep theirs. The empty
text is the identity. Decoding concatenates the bytes of the ids up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_schema, slices, text_rows

#: Characters of a leaf; kept matches a task.
LEAF, CACHED = 2048, 300_000
#: Fixed value: the published cutting pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
Element = tuple[list[str], list[str]]


class Tree:
    """parts: the matches; ids: for each match its ids in decimal, joined by commas."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        import tiktoken

        if pattern != PATTERN:
            raise ValueError("a match of another pattern may read farther than settled() allows for")
        self.find, self.leaf = regex.compile(pattern).findall, max(1, leaf)
        self.match_ids = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.known: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}

    def ids_of(self, parts: list[str]) -> list[str]:
        known = self.known
        wanted = set(parts).difference(known)
        if wanted:
            if len(known) + len(wanted) > CACHED:
                known.clear()
                wanted = set(parts)
            for p in wanted:
                known[p] = ",".join(map(str, self.match_ids(p)))
        return list(map(known.__getitem__, parts))

    def encode(self, text: str) -> Element:
        if len(text) <= self.leaf:
            parts = self.find(text)
            return parts, self.ids_of(parts)
        half = len(text) // 2
        return self.join(self.encode(text[:half]), self.encode(text[half:]))

    def settled(self, parts: list[str]) -> int:
        """How many of these matches stay whatever text follows."""
        n, after = len(parts), 0
        while n:
            after += len(parts[n - 1])
            n -= 1
            if after >= 3 and after > len(parts[n]):
                return n + 1
        return 0

    def join(self, left: Element, right: Element) -> Element:
        (a, ai), (b, bi) = left, right
        if not a or not b:
            return (a or b), (ai or bi)
        keep, took = self.settled(a), 2
        tail = "".join(a[keep:])
        while True:
            took = min(took, len(b))
            window = tail + "".join(b[:took])
            new = self.find(window)
            if took == len(b):
                return a[:keep] + new, ai[:keep] + self.ids_of(new)
            starts, at = {}, len(tail)
            for k in range(took + 1):
                starts[at] = k
                at += len(b[k])
            at = 0
            for i, part in enumerate(new[: self.settled(new)]):
                at += len(part)
                if at in starts:
                    k = starts[at]
                    return a[:keep] + new[: i + 1] + b[k:], ai[:keep] + self.ids_of(new[: i + 1]) + bi[k:]
            took *= 2

    def decode(self, ids: list[str]) -> bytes:
        """The bytes of the ids, concatenated up the tree."""
        if len(ids) > 4096:
            return self.decode(ids[: len(ids) // 2]) + self.decode(ids[len(ids) // 2 :])
        known = self.decoded
        wanted = set(ids).difference(known)
        if wanted:
            if len(known) + len(wanted) > CACHED:
                known.clear()
                wanted = set(ids)
            for x in wanted:
                known[x] = b"".join(self.bytes_of[int(i)] for i in x.split(","))
        return b"".join(map(known.__getitem__, ids))


@cache
def tree_of(ranks_path: str, pattern: str, leaf: int = LEAF) -> Tree:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return Tree(ranks, pattern, leaf)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF, digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded binary) of each whole text.

    digest: instead of ids and decoded, (ids_sha256, decoded_sha256): hex digests of the decimal ids
    joined by commas and of the decoded bytes. A text that is null or empty has no ids.
    """
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary")
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = tree_of(ranks_path, pattern, leaf)
        for batch in batches:
            for rows in slices(batch):
                n, ids_of, raw_of = [], [], []
                for text in rows.column("text").to_pylist():
                    _, ids = tree.encode(text)
                    raw, joined = tree.decode(ids), ",".join(ids)
                    n.append(joined.count(",") + 1 if joined else 0)
                    ids_of.append(hashlib.sha256(joined.encode()).hexdigest() if digest else [int(x) for x in joined.split(",") if x])
                    raw_of.append(hashlib.sha256(raw).hexdigest() if digest else raw)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_of, out.field(2).type), pa.array(raw_of, out.field(3).type)], schema=out)

    return text_rows(docs).mapInArrow(run, schema)
