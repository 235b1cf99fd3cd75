"""Repeated rows and several contents under one id, against brute force."""

import random

import numpy as np
import pytest

from graphlake.llm import hamming, jaccard


def nearest(rows, queries, k):
    out = {}
    for q, x in queries:
        d = out.setdefault(q, {})
        for i, y in rows:
            if i != q:
                d[i] = min(d.get(i, np.inf), np.sqrt(((np.array(y) - x) ** 2).sum()))
    return {q: sorted((s, i) for i, s in d.items())[:k] for q, d in out.items()}


@pytest.mark.parametrize("partitions", ["1", "4"])
def test_copies_take_no_place_of_a_neighbour(spark, partitions):
    x = np.random.default_rng(4).normal(size=(60, 16))
    x[5] = x[0] + 1e-3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist())] * 11
    rows += [(7, (x[0] + 2e-3 * (12 - n)).tolist()) for n in range(12)]  # one id, other vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = hamming.search(df, df.where("vec_id = 0"), k=10, recall=1.0).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = nearest(rows, [(0, x[0])], 10)[0]
    assert len(got) == 10 and [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 11))
    top = {r.vec_id: r.score for r in got}
    assert top[5] == want[0][0] and top[7] == pytest.approx(want[1][0])
    assert len(set(top) & {i for _, i in want}) >= 9


def test_the_radius_does_not_come_from_copies(spark):
    x = np.random.default_rng(5).normal(size=(400, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x) for _ in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hamming.search(df, df.where("vec_id % 20 = 0"), k=5).collect()
    want = nearest(list(enumerate(x.tolist())), [(i, x[i]) for i in range(0, 400, 20)], 5)
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(found) == len(got) == 100
    assert len(found & {(q, i) for q, top in want.items() for _, i in top}) >= 90


def test_ties_clashing_columns_and_query_blocks(spark):
    from pyspark.sql import functions as F

    x = np.random.default_rng(9).normal(size=(80, 20))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, x[i % 4].tolist()) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("v", "score", "query_id", "rank", "data", "label")})
    want = nearest(rows, [(i, x[i]) for i in range(0, 80, 8)], 10)
    for block in (3, 10_000):
        got: dict = {}
        for r in hamming.search(df, df.where("vec_id < 80 and vec_id % 8 = 0"), k=10, recall=1.0, block=block).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert set(got) == set(want)
        for q in got:
            top = [(s, i) for _, i, s in sorted(got[q])]
            assert top == sorted(top) and len(top) == 10  # ties by the smaller id
            assert [i for s, i in top if s == 0] == [i for s, i in want[q] if s == 0]
            assert len({i for _, i in top} & {i for _, i in want[q]}) >= 9


def test_probes_find_every_code_within_the_radius():
    draw = np.random.default_rng(3)
    codes = draw.integers(0, 1 << 16, (3000, 4)).astype(np.uint16)
    codes[1::2] = codes[::2] ^ (np.uint16(1) << draw.integers(0, 16, (1500, 4)).astype(np.uint16))
    ids = np.arange(3000)
    block = hamming.Block.read(hamming.Block.written(ids, np.zeros((3000, 2)), codes))
    for q in range(0, 3000, 97):
        far = np.bitwise_count(codes ^ codes[q]).sum(1)
        for radius in (0, 1, 3, 4, 7, 12, 20, 64):
            assert block.within(codes[q], radius).tolist() == np.flatnonzero(far <= radius).tolist()
        assert len(block.probed(codes[q], 7)) < 300  # a radius of 1 in each substring: few of all rows


@pytest.mark.parametrize("block", [4, 256])
def test_each_text_under_one_id_is_verified(docs_of, block):
    draw = random.Random(7)
    made = lambda: [f"w{draw.randrange(10**6)}" for _ in range(60)]
    bases = [made() for _ in range(6)]
    rows = [(1, " ".join(b)) for b in bases] + [(1, " ".join(bases[2])), (1, " ".join(bases[2]) + " "), (None, " ".join(bases[3]))]
    rows += [(10 + i, " ".join(b + ["end"])) for i, b in enumerate(bases)] + [(0, " ".join(bases[5] + ["x"])), (30, " ".join(made()))]
    draw.shuffle(rows)
    sets = [frozenset(zip(*[t.split()[i:] for i in range(5)], strict=False)) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    label = [float("inf") if d is None else d for d, _ in rows]
    for _ in rows:
        label = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(rows))]
    order = lambda r: (r[0] is not None, r)
    got = sorted((tuple(r) for r in jaccard.near_duplicates(docs_of(rows), block=block).collect()), key=order)
    assert got == sorted(((d, label[i], len(near[i])) for i, (d, _) in enumerate(rows)), key=order)


def test_the_pipeline_tells_texts_under_one_id_apart(spark, docs_of):
    import corpus_pipeline

    draw = random.Random(8)
    a, b = ([f"w{draw.randrange(10**6)}" for _ in range(60)] for _ in range(2))
    rows = [(0, " ".join(a)), (1, " ".join(a + ["end"])), (1, " ".join(b)), (1, " ".join(b + ["end"])), (2, " ".join(b)), (3, None)]
    left = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs_of(rows), "").collect())
    assert [d for d, _ in left] == [0, 1, 3] and left[0][1] == rows[0][1] and left[1][1] in (rows[2][1], rows[3][1])
