"""Catalogued queries over the whole graph and all documents, against plain code on the smallest tables."""

from collections import Counter

import pytest

from graphlake import queries as catalogue
from graphlake.sources import driver_graph, ntriples

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_export_and_parse_of_the_whole_graph(spark):
    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()
    iri = lambda kind, key: f"<https://example.org/node/{kind * driver_graph.KIND + key}>"
    want = []
    for name, (kind, source, key, properties) in driver_graph.NODES.items():
        for r in table(source):
            want.append((iri(kind, r[key]), ntriples.RDF_TYPE, f"<https://example.org/type/{name}>"))
            want += [(iri(kind, r[key]), f"<https://example.org/prop/{p}>", f'"{r[c]}"') for p, c in properties.items() if r[c] is not None]
    for label, source, a, b, _, _ in driver_graph.EDGES.values():
        want += [(iri(a[0], r[a[1]]), f"<https://example.org/rel/{label}>", iri(b[0], r[b[1]])) for r in table(source)]
    assert sorted(rows(catalogue.queries()["ntriples_parse_all"](spark, SF))) == sorted(want)
    assert sorted(r.value for r in catalogue.queries()["ntriples_export_all"](spark, SF).collect()) == sorted(f"{' '.join(t)} ." for t in want)


@pytest.fixture(scope="module")
def plain(spark):
    """Rids and (src, dst) pairs, read from the tables."""
    at = lambda r, end: end[0] * driver_graph.KIND + r[end[1]]
    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()
    rids = [at(r, (kind, key)) for kind, source, key, _ in driver_graph.NODES.values() for r in table(source)]
    return rids, [(at(r, a), at(r, b)) for _, source, a, b, _, _ in driver_graph.EDGES.values() for r in table(source)]


def test_components_of_the_whole_graph(spark, plain):
    rids, edges = plain
    label, moved = {r: r for r in rids}, True
    while moved:
        moved = False
        for a, b in edges:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    assert dict(rows(catalogue.queries()["components_all"](spark, SF))) == label


def test_pagerank_of_the_whole_graph(spark, plain):
    rids, edges = plain
    n, out = len(rids), Counter(a for a, _ in edges)
    rank = dict.fromkeys(rids, 1 / n)
    for _ in range(10):
        lost = sum(x for r, x in rank.items() if r not in out)
        new = dict.fromkeys(rids, 0.15 / n + 0.85 * lost / n)
        for a, b in edges:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    assert dict(rows(catalogue.queries()["pagerank_all"](spark, SF))) == pytest.approx(rank, rel=1e-9)


def test_label_propagation_of_the_whole_graph(spark, plain):
    rids, edges = plain
    label = {r: r for r in rids}
    for _ in range(5):
        votes = {r: Counter() for r in rids}
        for a, b in edges:
            votes[a][label[b]] += 1
            votes[b][label[a]] += 1
        label = {r: min(v, key=lambda c: (-v[c], c)) if (v := votes[r]) else label[r] for r in rids}
    assert dict(rows(catalogue.queries()["label_propagation_all"](spark, SF))) == label


def test_positions_in_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = [(r.doc_id, t, i) for r in docs for i, t in enumerate((r.text or "").lower().split())]
    assert rows(catalogue.queries()["term_positions_documents"](spark, SF)) == sorted(want)
