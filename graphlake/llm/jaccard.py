"""N-gram Jaccard join by a MinHash LSH forest, verified exactly.

Documents with equal shingle sets are one class from the start. Each class has a signature of `depth`
minimum hashes in each of `trees` trees. A tree is a prefix trie of its signatures, kept as their
sorted order: neighbours in it share a prefix, whose length is their node's depth, and the classes
below a node follow each other (ranges of the order are sorted apart, their ends are matched after).

Matching prefixes are shortened from the whole signature on, level by level, until the target recall
is reached. The recall of a level is estimated on what the forest holds: the neighbours that share at
least the shortest prefix, with their similarity as their whole signatures tell it (a standard error
lower); a pair of similarity s has a common prefix of length d in some tree with 1 - (1 - s^d)^trees.

What meets is not expanded into pairs. Connected components of the neighbours that share a long enough
prefix bring together all classes that could match, and each is verified in blocks of at most `block`
classes that follow each other in the first tree. A task holds two blocks, counts the links between
them from the shingles themselves, and gives one row a class (its links, and the least class of its
verified cluster). A small component is one block, of which all links are counted, those that no tree
has found included. Of a larger one two blocks meet only if some of their classes share a node of the
forest, so a long chain of components isn't compared with itself.

A document without words matches nothing; one of fewer than five words has one shingle of all its
words. A null id gets no class id of its own. Extra columns are ignored. Classes go by numbers of
their own, in the order of their least doc_id, and a text is found by its id and hash: so several
texts under one id are each verified, and rows that share both count as copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, durable, slices, text_rows
from .components import connected_components
from .words import ODD, mixed, shingle_sets

BLOCK, DEPTH, SHORTEST, STRETCH = 256, 8, 4, 4096


def recall_at(similarity: float, trees: int, depth: int) -> float:
    """The chance that a pair shares a prefix of this length in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def matched_depth(found: dict[int, int], threshold: float, trees: int, recall: float, depth: int = DEPTH) -> int:
    """The longest prefix with the target recall over found: agreeing hashes of a pair -> pairs."""
    total = trees * depth
    similar = [(max(threshold, k / total - math.sqrt(threshold * (1 - threshold) / total)), n) for k, n in found.items()]
    for d in range(depth, SHORTEST, -1):
        if sum(n * recall_at(s, trees, d) for s, n in similar) >= recall * sum(n for _, n in similar):
            return d
    return SHORTEST


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash)."""
    return text_rows(docs).withColumn("text_hash", F.xxhash64("text"))


def signed(docs: DataFrame, size: int, trees: int) -> DataFrame:
    """(doc_id, text_hash, h1, h2, n, signature): a hash of the shingle set, its size, and 16 bits of each minimum hash, tree by tree."""
    schema = "doc_id long, text_hash long, h1 long, h2 long, n long, signature binary"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw, hashes = np.random.default_rng(20_11), trees * DEPTH
        a = draw.integers(0, 2**63, (hashes, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        b = draw.integers(0, 2**63, (hashes, 1), np.uint64)
        for batch in batches:
            for rows in slices(batch):
                sets = shingle_sets(rows.column("text").to_pylist(), size)
                signatures = []
                for s in sets:
                    least = np.full(hashes, 2**64 - 1, np.uint64)
                    for k in range(0, len(s), 256):
                        least = np.minimum(least, (s[None, k : k + 256] * a + b).min(1))
                    signatures.append((mixed(least) >> np.uint64(48)).astype(">u2").tobytes())
                wrap = [np.array([f(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64) for f in (lambda s: mixed(s + ODD).sum(), lambda s: np.bitwise_xor.reduce(mixed(s ^ ODD)))]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), pa.array(wrap[0]), pa.array(wrap[1]), pa.array([len(s) for s in sets], pa.int64()), pa.array(signatures, pa.binary())], schema=out)

    return hashed(docs).mapInArrow(run, schema)


def common_prefixes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading hashes agree of rows of hashes."""
    return np.logical_and.accumulate(a == b, axis=1).sum(1)


def trie_neighbours(classes: DataFrame, trees: int) -> tuple[DataFrame, DataFrame]:
    """((a, b, depth) of neighbours in a tree that share SHORTEST hashes at least, (id, place) in the first tree).

    Each tree's signatures are sorted by range, ids last, so that no prefix is too common for a task.
    The ends of the ranges, two rows a partition, are matched by the driver.
    """
    spark, width = classes.sparkSession, 2 * DEPTH
    entries = classes.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring(F.col("signature"), 1 + t * width, width))).alias("tree", "label"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = entries.repartitionByRange(parts, "tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    schema = "kind int, a long, b long, depth int, label binary"
    out = arrow_schema(schema)

    def rows(kind: int, a: np.ndarray, b: np.ndarray, depth: np.ndarray, label: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(depth, pa.int32()), pa.array(label, pa.binary())], schema=out)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, tree, raw = batch.column("id").to_numpy(), batch.column("tree").to_numpy(), batch.column("label").to_pylist()
            labels = np.frombuffer(b"".join(raw), ">u2").reshape(-1, DEPTH)
            if last is None:
                yield rows(2, ids[:1], np.array([part]), tree[:1], raw[:1])
            else:
                ids, tree, labels = np.concatenate([[last[0]], ids]), np.concatenate([[last[1]], tree]), np.concatenate([last[2][None], labels])
            shared = np.where(tree[1:] == tree[:-1], common_prefixes(labels[1:], labels[:-1]), 0)
            hit = np.flatnonzero(shared >= SHORTEST)
            yield rows(0, ids[hit], ids[hit + 1], shared[hit], [None] * len(hit))
            first = np.flatnonzero(tree == 0)
            first = first[first >= (last is not None)]
            if len(first):
                yield rows(1, ids[first], (np.int64(part) << 40) + at + np.arange(len(first)), np.zeros(len(first), np.int32), [None] * len(first))
                at += len(first)
            last = (ids[-1], tree[-1], labels[-1])
        if last is not None:
            yield rows(3, np.array([last[0]]), np.array([part]), np.array([last[1]]), [last[2].tobytes()])

    walked = durable(ordered.mapInArrow(walk, schema))
    ends = sorted((r.b, r.kind, r.a, r.depth, bytes(r.label)) for r in walked.where("kind >= 2").collect())
    across = []
    for (_, _, a, tree, x), (_, _, b, other, y) in zip(ends[1::2], ends[2::2], strict=False):
        shared = next((k for k in range(DEPTH) if x[2 * k : 2 * k + 2] != y[2 * k : 2 * k + 2]), DEPTH)
        if tree == other and shared >= SHORTEST:
            across.append((a, b, shared))
    edges = walked.where("kind = 0").select("a", "b", "depth").unionByName(spark.createDataFrame(across, "a long, b long, depth int"))
    return edges, walked.where("kind = 1").select(F.col("a").alias("id"), F.col("b").alias("place"))


def agreements(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(agree, n): how many neighbours have so many hashes in common, each pair once."""
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.join(classes.select(F.col("id").alias("a"), F.col("signature").alias("x")), "a").join(classes.select(F.col("id").alias("b"), F.col("signature").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u2").reshape(batch.num_rows, -1) for c in ("x", "y"))
                agree, n = np.unique((x == y).sum(1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(agree, pa.int64()), pa.array(n, pa.int64())], names=["agree", "n"])

    return both.select("x", "y").mapInArrow(run, "agree long, n long").groupBy("agree").agg(F.sum("n").alias("n"))


def blocks_of(met: DataFrame, places: DataFrame, classes: DataFrame, trees: int, depth: int, block: int) -> DataFrame:
    """(id, component, part, partners): a class's block in its component and the blocks that it meets."""
    sizes = met.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    members = met.join(sizes, "label").withColumnRenamed("label", "component")
    small = members.where(F.col("n") <= block).select("id", "component", F.lit(0).cast("long").alias("part"), F.array(F.lit(0).cast("long")).alias("partners"))
    # a class's rank in its component, by counts of stretches of the first tree; no component is sorted as a whole
    large = members.where(F.col("n") > block).join(places, "id").withColumn("stretch", F.expr(f"place div {STRETCH}"))
    counts = large.groupBy("component", "stretch").agg(F.count(F.lit(1)).alias("own"))
    before = counts.withColumn("before", F.sum("own").over(Window.partitionBy("component").orderBy("stretch")) - F.col("own")).drop("own")
    within = F.row_number().over(Window.partitionBy("component", "stretch").orderBy("place"))
    large = large.withColumn("within", within).join(before, ["component", "stretch"])
    large = durable(large.select("id", "component", F.expr(f"(before + within - 1) div {block}").alias("part")))
    node = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring(F.col("signature"), 1 + t * 2 * DEPTH, 2 * depth))
    nodes = large.join(classes.select("id", "signature"), "id").select("component", "part", F.posexplode(node).alias("tree", "prefix")).distinct()
    sides = nodes.join(nodes.withColumnRenamed("part", "other"), ["component", "tree", "prefix"]).select("component", "part", "other").distinct()
    partners = sides.groupBy("component", "part").agg(F.collect_list("other").alias("partners"))
    return small.unionByName(large.join(partners, ["component", "part"]).select("id", "component", "part", "partners"))


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the common part of each left and right set."""
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left])
    both = left + right
    values, column = np.unique(np.concatenate(both), return_inverse=True)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    shared = np.bincount(column, minlength=len(values)) > 1
    order = np.argsort(column, kind="stable")
    order = order[shared[column[order]]]
    rank = np.cumsum(shared) - 1
    column, owner = rank[column[order]], owner[order]
    total, step = np.zeros((len(left), len(right)), np.float32), 8192
    edges = np.searchsorted(column, np.arange(0, int(shared.sum()) + step, step))
    for i, (p, q) in enumerate(zip(edges, edges[1:], strict=False)):
        part = np.zeros((len(both), step), np.float32)
        part[owner[p:q], column[p:q] - i * step] = 1
        total += part[: len(left)] @ part[len(left) :].T
    return total


def linked(ids: list[int], sets: list[np.ndarray], weights: list[int], sides: list[bool] | None, threshold: float) -> list[tuple[int, int, int]]:
    """(id, links, least id of its cluster) for ids with a link; sides: only pairs of different sides count."""
    n = len(ids)
    one = [i for i in range(n) if sides is None or sides[i]]
    two = list(range(n)) if sides is None else [i for i in range(n) if not sides[i]]
    if not one or not two:
        return []
    common = intersections([sets[i] for i in one], [sets[i] for i in two])
    sizes = np.array([len(s) for s in sets])
    fits = common >= threshold * (sizes[one][:, None] + sizes[two][None] - common) - 1e-6
    if sides is None:
        np.fill_diagonal(fits, False)
    w = np.array(weights, np.int64)
    links = np.zeros(n, np.int64)
    links[one] += fits @ w[two]
    if sides is not None:
        links[two] += fits.T @ w[one]
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x, y in zip(*np.nonzero(fits), strict=True):
        p, q = find(one[x]), find(two[y])
        if p != q:
            if ids[q] < ids[p]:
                p, q = q, p
            root[q] = p
    return [(ids[i], int(links[i]), ids[find(i)]) for i in range(n) if links[i]]


def verified(members: DataFrame, docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """(id, links, root) of members (id, doc_id, text_hash, weight, component, part, partners), a row a block pair."""
    schema = "component long, p long, q long, id long, weight long, part long, shingles binary"
    out = arrow_schema(schema)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                found = shingle_sets(rows.column("text").to_pylist(), size)
                cols = {n: rows.column(i).to_pylist() for i, n in enumerate(rows.schema.names) if n != "text"}
                made, size_of = [], 0
                for i, shingles in enumerate(found):
                    b, raw = cols["part"][i], shingles.tobytes()
                    for j in cols["partners"][i]:
                        made.append((cols["component"][i], min(b, j), max(b, j), cols["id"][i], cols["weight"][i], b, raw))
                        size_of += len(raw) + 48
                        if size_of > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)
                            made, size_of = [], 0
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)

    result = "id long, links long, root long"
    given = arrow_schema(result)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, found = None, [], []

        def close() -> None:
            if held:
                sides = None if key[1] == key[2] else [x[2] == key[1] for x in held]
                found.extend(linked([x[0] for x in held], [x[3] for x in held], [x[1] for x in held], sides, threshold))
                held.clear()

        for batch in batches:
            c = [batch.column(i).to_pylist() for i in range(7)]
            for comp, p, q, one, weight, part, raw in zip(*c, strict=True):
                if key != (comp, p, q):
                    close()
                    key = (comp, p, q)
                if not held or held[-1][0] != one:  # a repeated row counts once
                    held.append((one, weight, part, np.frombuffer(raw, np.uint64)))
            if len(found) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], schema=given)
                found.clear()
        close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], schema=given)

    pairs = hashed(docs).join(members, ["doc_id", "text_hash"]).select("component", "part", "partners", "id", "weight", "text").mapInArrow(sets_of, schema)
    return pairs.repartition("component", "p", "q").sortWithinPartitions("component", "p", "q", "id").mapInArrow(count, result)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, trees: int = 20, recall: float = 0.9995, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links) of each document.

    class_id: the least doc_id of the documents joined to it by links; n_links: the other documents (rows)
    whose shingle sets have a Jaccard similarity of at least the threshold with its own.
    """
    return classified(docs, threshold, size, trees, recall, block).select("doc_id", "class_id", "n_links")


def classified(docs: DataFrame, threshold: float = 0.8, size: int = 5, trees: int = 20, recall: float = 0.9995, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, class_id, class_text, n_links): near_duplicates, with the hash of the text and of the text that class_id stands for."""
    rows = durable(signed(docs, size, trees))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash")))
    classes = rows.where("n > 0").groupBy("h1", "h2").agg(first.alias("first"), F.count(F.lit(1)).alias("weight"), F.min("signature").alias("signature"))
    classes = classes.where("first is not null").select(F.col("first.doc_id").alias("rep"), "first.text_hash", "h1", "h2", "weight", "signature")
    classes = durable(classes.orderBy("rep", "h1", "h2").withColumn("id", F.monotonically_increasing_id()))
    edges, places = trie_neighbours(classes, trees)
    likely = threshold - math.sqrt(threshold * (1 - threshold) / (trees * DEPTH))
    found = {r.agree: r.n for r in agreements(edges, classes).collect() if r.agree >= likely * trees * DEPTH}
    depth = matched_depth(found, threshold, trees, recall)
    met = connected_components(edges.where(F.col("depth") >= depth).select("a", "b").distinct())
    members = blocks_of(met, places, classes, trees, depth, block).join(classes.select("id", F.col("rep").alias("doc_id"), "text_hash", "weight"), "id")
    links = durable(verified(members, docs, size, threshold))
    clusters = connected_components(links.select(F.col("root").alias("a"), F.col("id").alias("b")))
    least_ids = classes.select(F.col("id").alias("label"), F.col("rep").alias("class_id"), F.col("text_hash").alias("class_text"))
    per_class = links.groupBy("id").agg(F.sum("links").alias("links")).join(clusters, "id").join(least_ids, "label").drop("label")
    told = classes.join(per_class, "id", "left").select("h1", "h2", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("class_text", "text_hash").alias("class_text"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    with_words = rows.where("n > 0").select("doc_id", "text_hash", "h1", "h2").join(told, ["h1", "h2"], "left")
    with_words = with_words.select("doc_id", "text_hash", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_text", "text_hash").alias("class_text"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return with_words.unionByName(rows.where("n = 0").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.col("text_hash").alias("class_text"), F.lit(0).cast("long").alias("n_links")))
