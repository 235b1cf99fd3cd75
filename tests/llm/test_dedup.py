"""Similarity operators, suffix sorting and the pipeline against brute force."""

import random
import re

import numpy as np
import pytest

from graphlake.llm import components, hamming, jaccard, line_dedup, suffix_dedup
from graphlake.llm.blobs import doc_bucket
from graphlake.llm.suffix_sort import common_prefix_at_least, suffix_array, words_at


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def near_copies(draw, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[draw.randrange(len(w))] = f"z{draw.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() for _ in range(draw.randrange(5, 60))) for _ in range(30)]
    base = [word() for _ in range(120)]
    texts += near_copies(draw, base, 25, 1) + near_copies(draw, base, 5, 5)
    texts += [texts[0], texts[0], texts[1] + " ", "", None, " \n", "a b", "a b", "a b c", texts[31] + " " + word()]
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [4, 256])
def test_jaccard_equals_brute_force(docs_of, corpus, block):
    sets = {}
    for d, t in corpus:
        w = words_of(t)
        sets[d] = frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()
    near = {d: {e for e in sets if e != d and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]) > 0} for d in sets}
    label = {d: d for d in sets}
    for _ in sets:
        label = {d: min([label[d], *(label[e] for e in near[d])]) for d in sets}
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(docs_of(corpus), block=block).collect()}
    assert got == {d: (label[d], len(near[d])) for d in sets}


def test_jaccard_empty(docs_of):
    assert jaccard.near_duplicates(docs_of([])).count() == 0
    assert [tuple(r) for r in jaccard.near_duplicates(docs_of([(1, None)])).collect()] == [(1, 1, 0)]


def test_prefixes_shorten_to_the_recall():
    copies, edge = {158: 1000}, {128: 1000}  # of 160 hashes
    assert jaccard.matched_depth(copies, 0.8, 20, 0.9999) > jaccard.matched_depth(edge, 0.8, 20, 0.9999) == jaccard.SHORTEST
    assert jaccard.matched_depth(edge, 0.8, 20, 0.99) == 7 and jaccard.recall_at(0.8, 20, 7) >= 0.99 > jaccard.recall_at(0.8, 20, 8)
    assert jaccard.matched_depth({}, 0.8, 20, 0.9999) == jaccard.DEPTH


def test_neighbours_are_those_of_the_sorted_trie(spark):
    draw = np.random.default_rng(5)
    signatures = draw.integers(0, 2, (200, 3, jaccard.DEPTH)).astype(">u2")
    rows = [(int(i), bytearray(s.tobytes())) for i, s in enumerate(signatures)]
    edges, places = jaccard.trie_neighbours(spark.createDataFrame(rows, "id long, signature binary"), 3)
    want = []
    for t in range(3):
        order = sorted(range(200), key=lambda i: (signatures[i, t].tobytes(), i))
        if t == 0:
            assert [r.id for r in places.orderBy("place").collect()] == order
        for x, y in zip(order, order[1:]):
            n = next((k for k in range(jaccard.DEPTH) if signatures[x, t, k] != signatures[y, t, k]), jaccard.DEPTH)
            want += [(x, y, n)] if n >= jaccard.SHORTEST else []
    assert sorted(tuple(r) for r in edges.collect()) == sorted(want)


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.label for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


@pytest.mark.parametrize("small", [0, 1000])
def test_components_in_rounds_and_at_once(spark, monkeypatch, small):
    draw, written = random.Random(8), []
    edges = [(i, i + 1) for i in range(100, 160)] + [(draw.randrange(80), draw.randrange(80)) for _ in range(40)]
    monkeypatch.setattr(components, "durable", lambda df, own=components.durable: written.append(1) or own(df))
    got = {r.id: r.label for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), **({} if small else {"small": 0})).collect()}
    label = {i: i for e in edges if e[0] != e[1] for i in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert not small or len(written) <= 2  # few edges take no rounds of jobs


def lines_brute(rows, t=0.8):
    seen, out = [], {}
    for d, text in sorted(rows):
        kept, gone = [], 0
        for line in (text or "").split("\n") if text else []:
            s = frozenset(words_of(line))
            hit = bool(s) and any(len(s & x) >= t * len(s | x) - 1e-9 for x in seen)
            gone += hit
            kept += [] if hit else [line]
            if s:
                seen.append(s)
        out[d] = (gone, "\n".join(kept))
    return out


@pytest.mark.parametrize("heavy", [1, 4, 8192])
def test_lines_equal_brute_force(docs_of, heavy):
    draw = random.Random(9)
    lines = [" ".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(1, 14))) for _ in range(120)]
    rows = []
    for d in range(60):
        own = [draw.choice(lines) for _ in range(draw.randrange(5))]
        own += [" ".join(x if draw.random() > 0.1 else "new" for x in draw.choice(lines).split()) for _ in range(3)]
        rows.append((d, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "\n".join(lines)), (104, "long " + " ".join(f"w{i}" for i in range(3000)))]
    out = line_dedup.dedup_lines(docs_of(rows), heavy=heavy)
    got = {r.doc_id: (r.n_removed, r.text) for r in out.collect()}
    assert got == lines_brute(rows)
    assert out.first().rest.n_words == "clash"
    assert line_dedup.dedup_lines(docs_of([])).count() == 0


@pytest.mark.parametrize("nearest", [1, 2, 4])
def test_lines_of_crowds_equal_brute_force(docs_of, nearest):
    draw = random.Random(12)
    rows = []
    for crowd in range(4):  # similarities on both sides of the threshold, so that likely candidates fail
        base = [f"b{crowd}x{i}" for i in range(draw.choice([18, 40, 150]))]
        for i, line in enumerate(near_copies(draw, base, 60, len(base) // 9)):
            rows.append((crowd * 100 + i, line + "\n" + near_copies(draw, base, 1, len(base) // 20)[0]))
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.dedup_lines(docs_of(rows), nearest=nearest).collect()}
    assert got == lines_brute(rows)


def test_pairs_of_a_crowd_follow_its_lines(docs_of):
    draw, base, sent = random.Random(13), [f"b{i}" for i in range(60)], []
    for n in (200, 800):
        texts = line_dedup.string_texts(docs_of(list(enumerate(near_copies(draw, base, n, 3)))))
        blobs = line_dedup.met(line_dedup.dealt_lines(texts, line_dedup.rarities(texts), 0.8, 4, 8192), 0.8, 4)
        sent.append(sum(len(r.data) for r in blobs.where(f"kind <> {line_dedup.GONE}").collect()))
    assert sent[1] < 6 * sent[0]


@pytest.mark.parametrize("n", [1, 4])
def test_lines_of_repeated_rows_stay(docs_of, n):
    rows = [(3, "a b c"), (4, "x y\nx y\nz"), (5, "a b c\nown"), (6, "p q r s t\np q r s t u")]
    out = line_dedup.dedup_lines(docs_of(rows * 3, n)).collect()
    want = lines_brute(rows)
    assert len(out) == 12 and all((r.n_removed, r.text) == want[r.doc_id] for r in out)


def test_suffix_array_is_sorted():
    draw = np.random.default_rng(0)
    for _ in range(150):
        text = draw.integers(0, int(draw.integers(2, 5)), int(draw.integers(1, 150))).astype(np.uint8) + 97
        at = suffix_array(text, 256)
        raw = text.tobytes()
        assert sorted(at.tolist()) == list(range(len(text)))
        ordered = [raw[i:] for i in at]
        assert all(a <= b or a.startswith(b) or b.startswith(a) for a, b in zip(ordered, ordered[1:], strict=False))
    text = np.frombuffer(b"abcdefghiXabcdefghiYabcdefgZ" + b"\xff" * 16, np.uint8)
    at = suffix_array(text)
    at = at[at < 28]
    same = common_prefix_at_least(at, words_at(text), 9)
    assert {tuple(sorted(at[i - 1 : i + 1].tolist())) for i in np.flatnonzero(same)} == {(0, 10)}


def repeats_brute(rows, n):
    seen, out = set(), {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        mask = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            if raw[i : i + n] in seen:
                mask[i : i + n] = b"\1" * n
            seen.add(raw[i : i + n])
        out[d] = (bytes(x for x, m in zip(raw, mask) if not m), [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(mask))])
    return out


@pytest.mark.parametrize("crowd", [0, 20_000])
def test_repeats_equal_brute_force(docs_of, crowd):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefé") for _ in range(draw.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(4)]
    rows = []
    for d in range(40):
        parts = [" ".join(word() for _ in range(draw.randrange(30))) for _ in range(3)]
        p = draw.choice(passages)
        a = draw.randrange(60)
        parts.insert(1, p[a : a + draw.randrange(90, 200)])
        rows.append((d, "".join(parts)))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, None), (53, ""), (54, "a" * 700), (55, "ab" * 300), (56, "a" * 99), (57, "é" * 120)]
    got = {r.doc_id: (bytes(r.kept), [(x.start, x.stop) for x in r.removed]) for r in suffix_dedup.remove_repeats(docs_of(rows), crowd=crowd).collect()}
    assert got == repeats_brute(rows, 100)


def test_repeats_empty(docs_of):
    assert suffix_dedup.remove_repeats(docs_of([])).count() == 0


def test_buckets_are_sparks(spark):
    ids = [0, 1, -1, 2**62, -(2**63), 123456789]
    want = [r.b for r in spark.createDataFrame([(i,) for i in ids], "i long").coalesce(1).selectExpr("int(pmod(xxhash64(i), 97)) as b").collect()]
    assert doc_bucket(np.array(ids, np.int64), 97).tolist() == want


def test_neighbours(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(600, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [None] * 24), (1004, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in hamming.search(df, df.where("vec_id % 20 = 0"), k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q in range(0, 600, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.argsort(d, kind="stable") if i != q][:5]
        found = sorted(got[q])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(f[2] == d[f[1]] for f in found)
        hit += len({f[1] for f in found} & set(want))
    assert hit >= 0.9 * 150 and len(got) == 30
    few = df.where("vec_id < 4")
    assert hamming.search(few, few.where("vec_id = 0"), k=10).count() == 3
    assert hamming.search(few.limit(0), few).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = p.quality_rules(spark, docs, sf)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    lines = p.line_dedup_stage(spark, kept, sf)
    assert lines.columns == docs.columns
    want = lines_brute([(r.doc_id, r.text) for r in kept.collect()])
    assert {r.doc_id: r.text for r in lines.collect()} == {d: t for d, (gone, t) in want.items() if not gone or t.strip()}
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    near = p.near_duplicates(spark, docs, sf)
    classes = {r.class_id for r in jaccard.near_duplicates(docs).collect()}
    assert {r.doc_id for r in near.collect()} == classes
    pieces = p.run(spark, sf)
    assert pieces.count() and [n for n, _ in p.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "secret_scan", "packing"]
