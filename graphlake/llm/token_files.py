"""Token-ID files: ids bit-packed in the fewest bits that hold the vocabulary, readable at random.

A file holds documents in ascending doc_id order. Layout, all integers little-endian:

    magic "GLTOK1\\0\\0", then blocks, then the index, then a fixed footer
    block    BLOCK ids (the last one fewer), width bits each, lowest bit first, from a byte border
    index    int64 place of each block, int64 doc_id of each document (null: the least long),
             int64 ids before each document and, last, of the file
    footer   int64: place of the index, documents, ids, block length, width, blocks

A task writes one file under a name no other attempt uses and returns that name; only files named
in the returned manifest belong to the output, so a task that ran twice does no harm.
Rows with equal doc_id follow each other in order of text; an empty table makes no files.
"""

from __future__ import annotations

import math
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_schema, shared_folder, slices, text_rows
from .vocab import document_encoder, vocabulary_size

MAGIC, BLOCK, NULL_ID = b"GLTOK1\0\0", 65_536, -(2**63)


def bit_width(vocabulary: int) -> int:
    return max(1, math.ceil(math.log2(max(2, vocabulary))))


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Writer:
    """Documents one by one into a file; holds one block and 16 bytes a document."""

    def __init__(self, path: str, width: int):
        where, name = opened(path)
        where.create_dir(os.path.dirname(name), recursive=True)
        self.out, self.width = where.open_output_stream(name), width
        self.out.write(MAGIC)
        self.at, self.blocks, self.docs, self.before, self.waiting, self.held = len(MAGIC), [], [], [0], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NULL_ID if doc_id is None else doc_id)
        self.before.append(self.before[-1] + len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            self.flush(self.held // BLOCK * BLOCK)

    def flush(self, n: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        for i in range(0, n, BLOCK):
            data = pack_bits(ids[i : min(n, i + BLOCK)], self.width)
            self.blocks.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.waiting, self.held = [ids[n:]], self.held - n

    def close(self) -> tuple[int, int]:
        self.flush(self.held)
        for column in (self.blocks, self.docs, self.before):
            self.out.write(np.array(column, "<i8").tobytes())
        self.out.write(np.array([self.at, len(self.docs), self.before[-1], BLOCK, self.width, len(self.blocks)], "<i8").tobytes())
        self.out.close()
        return len(self.docs), self.before[-1]


class Reader:
    """Random access: only the index is held; ids(i, j) reads the blocks that it needs."""

    def __init__(self, path: str):
        where, name = opened(path)
        self.file = where.open_input_file(name)
        size = self.file.size()
        index, n_docs, self.n_ids, self.block, self.width, n_blocks = (int(x) for x in np.frombuffer(self.file.read_at(48, size - 48), "<i8"))
        if self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is no token file")
        columns = np.frombuffer(self.file.read_at(size - 48 - index, index), "<i8")
        self.blocks, self.docs, self.before = columns[:n_blocks], columns[n_blocks : n_blocks + n_docs], columns[n_blocks + n_docs :]
        self.end = index

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        whole = []
        for b in range(first, last + 1):
            to = int(self.blocks[b + 1]) if b + 1 < len(self.blocks) else self.end
            n = min(self.block, self.n_ids - b * self.block)
            whole.append(unpack_bits(self.file.read_at(to - int(self.blocks[b]), int(self.blocks[b])), self.width, n))
        return np.concatenate(whole)[start - first * self.block : stop - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the file, its ids) in order; a few blocks are held at a time."""
        step, i = 16 * self.block, 0
        while i < len(self.docs):
            j = max(i + 1, int(np.searchsorted(self.before, self.before[i] + step, "right")) - 1)
            ids, base = self.ids(int(self.before[i]), int(self.before[j])), int(self.before[i])
            for k in range(i, j):
                a, b = int(self.before[k]), int(self.before[k + 1])
                doc = int(self.docs[k])
                yield (None if doc == NULL_ID else doc), a, ids[a - base : b - base]
            i = j


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int | None = 2, folder: str | None = None) -> list[tuple[str, int, int]]:
    """Encodes whole texts and writes the files; (path, documents, ids) of each, in doc_id order.

    The rows are dealt by ranges of doc_id, so that the files in order are the documents in order;
    what reaches the driver is one row a file.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-files")
    width = bit_width(max(vocabulary_size(vocabulary), (end_id or 0) + 1))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, out, path = document_encoder(vocabulary, end_id), TaskContext.get().partitionId(), None, ""
        for batch in batches:
            for rows in slices(batch):
                ids = encode(rows.column("text").to_pylist())
                if out is None:
                    path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok"
                    out = Writer(path, width)
                for doc, x in zip(rows.column("doc_id").to_pylist(), ids, strict=True):
                    out.add(doc, np.frombuffer(x, "<u4"))
        if out is not None:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((part, pa.int64()), (path, pa.string()), (n_docs, pa.int64()), (n_ids, pa.int64()))], names=["part", "path", "n_docs", "n_ids"])

    dealt = text_rows(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = dealt.mapInArrow(write, "part long, path string, n_docs long, n_ids long").collect()
    return [(f.path, f.n_docs, f.n_ids) for f in sorted(files, key=lambda f: f.part)]


def read_token_files(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, a task a file; start counts over all files."""
    starts = np.concatenate([[0], np.cumsum([n for _, _, n in files])]).astype(int).tolist()
    rows = [(path, start) for (path, _, _), start in zip(files, starts, strict=False)]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    out = arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                found: list[tuple] = []
                for doc, before, ids in Reader(path).documents():
                    found.append((doc, start + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(found) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), out, strict=True)], schema=out)
                        found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), out, strict=True)], schema=out)

    listed = spark.createDataFrame(rows, "path string, start long")
    return listed.repartition(max(1, len(rows))).mapInArrow(read, schema)
