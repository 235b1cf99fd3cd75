"""Goldens on small graphs."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from graphlake.engine import Engine
from graphlake.functions import signatures, statistics
from graphlake.model import from_rows
from graphlake.operators import access, algorithms, cache, rdfs, search, shacl, temporal, traverse
from graphlake.operators.gremlin import g, parse
from graphlake.plans import policy
from graphlake.plans.cypher import CypherError, cypher
from graphlake.plans.sparql import SparqlError, sparql
from graphlake.sources import ntriples
from graphlake.sources.content_store import ContentStore


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def friends(spark):
    people = [(1, '{"type":"Person","name":"Alice","age":30}'), (2, '{"type":"Person","name":"Bob","age":25}'), (3, '{"type":"Person","name":"Charlie"}'), (4, "no json")]
    return from_rows(spark, people, [(1, 2, 1), (2, 3, 1)], {"FRIENDS_WITH": 1})


def test_search_takes_any_case(spark):
    texts = spark.createDataFrame([(1, "Hello World"), (2, "Foo Bar"), (3, None)], "rid long, text string")
    assert rows(search.search(texts, "Hello")) == [(1, 1.0)] == rows(search.search(texts, "hello"))
    assert rows(search.postings(texts.where("rid = 1"))) == [("hello", 1, 0), ("world", 1, 1)]


@pytest.mark.parametrize(("ts", "want"), [(5, []), (10, [(1, 10, "v1")]), (15, [(1, 10, "v1")]), (20, [(1, 20, "v2")])])
def test_as_of(spark, ts, want):
    versions = spark.createDataFrame([(1, 10, "v1"), (1, 20, "v2")], "rid long, ts long, data string")
    assert rows(temporal.node_at(versions, 1, ts)) == want


def test_versions_write_and_delete(spark):
    versions = spark.createDataFrame([(1, 10, "a")], "rid long, ts long, data string")
    new = temporal.write_versions(versions, spark.createDataFrame([(1, 10, "b"), (1, 11, "c")], versions.schema))
    assert rows(new) == [(1, 10, "b"), (1, 11, "c")]
    gone = temporal.latest(temporal.deleted(new, spark.createDataFrame([(1,)], "rid long"), 12))
    assert rows(gone) == [(1, 12, None)]
    snapshots = spark.createDataFrame([(1000, "s")], "ts long, name string")
    asked = spark.createDataFrame([(1000,), (1500,), (999,)], "as_of long")
    assert rows(temporal.nearest_snapshot(snapshots, asked).select("as_of", "name")) == [(1000, "s"), (1500, "s")]


def test_gremlin(friends):
    assert rows(g(friends).V().out().values("name").dataframe().select("path", "value")) == [([1, 2], "Bob"), ([2, 3], "Charlie")]
    assert rows(g(friends).V(2).in_().dataframe().select("current", "path")) == [(1, [2, 1])]
    assert rows(parse(friends, "V(1).out('friends_with').out().path()").dataframe().select("value")) == [([1, 2, 3],)]
    assert rows(g(friends).V().has("age", 30).dataframe().select("current")) == [(1,)]
    assert rows(g(friends).V().has("age", "30").dataframe().select("current")) == []
    assert rows(g(friends).V().count().dataframe()) == [(4,)]
    assert rows(g(friends).dataframe()) == []
    with pytest.raises(ValueError):
        g(friends).out().dataframe()
    with pytest.raises(ValueError):
        parse(friends, "V().nothing()")


def test_cypher(friends):
    assert rows(cypher(friends, "MATCH (n) WHERE n.age > 25 RETURN n.name")) == [("Alice",)]
    assert rows(cypher(friends, "match (p:Person)-[:friends_with]->(f) return p.name, f.name")) == [("Alice", "Bob"), ("Bob", "Charlie")]
    assert rows(cypher(friends, "MATCH (a {name: 'Alice'})-[:FRIENDS_WITH]->()-[:FRIENDS_WITH]->(c) RETURN c.name AS n")) == [("Charlie",)]
    assert rows(cypher(friends, "MATCH (n:Person) WHERE n.age = null RETURN n.name")) == [("Charlie",)]
    assert rows(cypher(friends, "MATCH (n:Person) WHERE n.age <> 30 RETURN n.name")) == [("Bob",), ("Charlie",)]
    assert rows(cypher(friends, "MATCH (n:Person) WHERE n.age = '30' RETURN n.name")) == []
    assert rows(cypher(friends, "MATCH (a)-[*0..2]->(b) WHERE a.name = 'Alice' RETURN b")) == [(1,), (2,), (3,)]
    assert rows(cypher(friends, "MATCH (a)-[]-(b) RETURN count(DISTINCT b) AS n")) == [(3,)]
    for text in ("RETURN 1", "MATCH (a RETURN a", "MATCH (a) RETURN b", "MATCH (a) RETURN nosuch(a)"):
        with pytest.raises(CypherError):
            cypher(friends, text)


def test_traverse_labels_and_trap(spark):
    posts = from_rows(spark, [(i, "x") for i in (1, 2, 3)], [(1, 2, 1), (2, 3, 2), (1, 3, 3)])
    assert rows(traverse.traverse(posts, 1, None, 2)) == [(1, 0), (2, 1), (3, 1)]
    assert rows(traverse.traverse(posts, 1, [1], 2)) == [(1, 0), (2, 1)]
    assert rows(traverse.traverse(posts, 1, [], 2)) == [(1, 0)]
    trap = from_rows(spark, [(i, "x") for i in (1, 2, 3, 4)], [(1, 3, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1)])
    assert rows(traverse.traverse(trap, 1, None, 2)) == [(1, 0), (2, 1), (3, 1), (4, 2)]
    assert rows(traverse.shortest_path(trap, 1, 4)) == [([1, 3, 4], 2)]
    assert rows(traverse.bidirectional_distance(trap, 1, 4)) == [(2,)]
    assert rows(traverse.shortest_path(trap, 4, 1)) == []


def test_traverse_against_plain_search(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(12), draw.randrange(12), draw.randrange(2)) for _ in range(25)]
    graph = from_rows(spark, [(i, "x") for i in range(12)], edges)
    depth, todo = {0: 0}, deque([0])
    while todo:
        a = todo.popleft()
        for s, d, _ in edges:
            if s == a and d not in depth and depth[a] < 3:
                depth[d] = depth[a] + 1
                todo.append(d)
    assert rows(traverse.traverse(graph, 0, None, 3)) == sorted(depth.items())


def test_triples_round_trip(spark):
    two = from_rows(spark, [(1, 'say "a\nb" \\'), (2, "node2")], [(1, 2, 1)])
    out = ntriples.triples(two, properties=False, data=True)
    lines = ntriples.lines(out)
    assert lines.count() == 3
    assert rows(ntriples.parse_lines(lines)) == rows(out)
    broken = spark.createDataFrame([("# note",), ("",), ("<a> <b>",)], "value string")
    assert rows(ntriples.parse_lines(broken)) == []


def test_sparql(spark, friends):
    t = ntriples.triples(friends)
    p = "PREFIX e: <https://example.org/>"
    assert rows(sparql(t, f"{p} SELECT ?n WHERE {{ ?a e:rel/1 ?b . ?b e:prop/name ?n }}")) == [('"Bob"',), ('"Charlie"',)]
    assert rows(sparql(t, f"{p} ASK {{ ?a e:prop/name \"Nobody\" }}")) == [(False,)]
    assert rows(sparql(t, f"{p} SELECT ?n WHERE {{ ?a e:prop/name ?n OPTIONAL {{ ?a e:prop/age ?g }} FILTER(!BOUND(?g)) }}")) == [('"Charlie"',)]
    assert rows(sparql(t, f"{p} SELECT ?n WHERE {{ ?a e:prop/name ?n FILTER NOT EXISTS {{ ?x e:rel/1 ?a }} }}")) == [('"Alice"',)]
    with pytest.raises(SparqlError):
        sparql(t, "DELETE {}")


def test_rdfs_closure(spark):
    text = "@prefix e: <https://example.org/> . e:Student rdfs:subClassOf e:Person . e:Person rdfs:subClassOf e:Agent . e:teaches rdfs:domain e:Professor ; rdfs:range e:Student ."
    schema = ntriples.parse_turtle(text)
    data = spark.createDataFrame([("<i>", ntriples.RDF_TYPE, "<https://example.org/Student>"), ("<p>", "<https://example.org/teaches>", "<s>")], "s string, p string, o string")
    got = {(s, o.rsplit("/", 1)[1].strip(">")) for s, p, o in rows(rdfs.infer(data, schema)) if p == ntriples.RDF_TYPE}
    assert got == {("<i>", "Person"), ("<i>", "Agent"), ("<p>", "Professor"), ("<s>", "Student"), ("<s>", "Person"), ("<s>", "Agent")}
    again = data.unionByName(rdfs.infer(data, schema))
    assert rows(rdfs.infer(again, schema)) == []


def test_shacl(spark):
    graph = from_rows(spark, [(1, '{"type":"Person","name":"Alice"}'), (2, '{"type":"Person","email":"x"}')])
    shape = '@prefix e: <https://example.org/> . e:P a sh:NodeShape ; sh:targetClass e:Person ; sh:property [ sh:path e:name ; sh:datatype xsd:string ; sh:minCount 1 ] , [ sh:path e:email ; sh:pattern ".+@.+" ] .'
    out = shacl.validate(graph, shape)
    assert rows(out.select("focus_node", "constraint", "path")) == [(2, "minCount", "name"), (2, "pattern", "email")]
    assert rows(shacl.summary(out.where("focus_node = 1"))) == [(True, 0)]
    assert shacl.validate(graph, shape, max_violations=1).count() == 1
    assert rows(shacl.validate(graph, "").select("focus_node", "constraint")) == [(2, "minCount")]


def test_manifests_and_traces(spark):
    schema = "k string, result_cid string"
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], schema)
    new = spark.createDataFrame([("b", "2"), ("c", "4"), ("d", "5")], schema)
    diff = cache.manifest_diff(old, new, ["k"])
    assert rows(diff) == [("a", "removed", "1"), ("c", "updated", "4"), ("d", "added", "5")]
    assert rows(cache.apply_diff(old, diff, ["k"])) == rows(new)
    ops = [("node", 1, None, None, None, None, None, "x"), ("edge", None, 1, 2, 1, None, None, None), ("node", 2, None, None, None, None, None, "y")]
    columns = "op string, id long, src long, dst long, label int, node long, key string, cid string"
    assert rows(cache.normal_form(spark.createDataFrame(ops, columns))) == rows(cache.normal_form(spark.createDataFrame(ops[::-1], columns)))


def test_signatures(spark):
    one = spark.range(1).select(signatures.path_signature(F.array(F.lit("b"), F.lit("a"))).alias("p"), signatures.class_signature(F.array(F.lit("b"), F.lit("a"))).alias("c")).first()
    assert one.p == signatures.path_signature_of(["b", "a"])
    assert one.c == signatures.class_signature_of(["a", "b"]) == signatures.path_signature_of(["a", "b"])


def test_access(spark):
    schema = "base long, len long, perms int"
    a, b = (spark.createDataFrame([x], schema) for x in ((0, 100, 3), (50, 200, 1)))
    assert [tuple(r)[:3] for r in access.composed(a, b).collect()] == [(50, 100, 1)]
    points = spark.createDataFrame([(0,), (99,), (100,), (300,)], "at long")
    assert rows(access.in_scope(points, "at", a, access.READ, 7).select("at")) == [(0,), (99,)]
    assert rows(access.in_scope(points, "at", a, access.EXECUTE, 7).select("at")) == []
    leases = spark.createDataFrame([(1, 10, True), (2, 9, False)], "lease_id long, expires_at long, auto_renew boolean")
    assert rows(access.valid_leases(leases, 10).select("lease_id")) == [(1,)]
    assert rows(access.renewed(leases, 2, 50).select("expires_at")) == [(9,), (10,)]
    run = access.SafeExecutor()
    with pytest.raises(PermissionError):
        run.run("bob", "write", access.READ, access.WRITE, lambda: a)
    run.run("alice", "read", access.READ, access.READ, lambda: a)
    assert [(x[0], x[3]) for x in run.log] == [("bob", False), ("alice", True)]
    owned, borrowed = (spark.createDataFrame([x], "cid string, perms int") for x in (("x", 1), ("x", 2)))
    assert rows(access.writable(spark.createDataFrame([("x",), ("y",)], "cid string"), owned, borrowed)) == []


def test_statistics(spark):
    five = spark.createDataFrame([(float(i),) for i in range(1, 6)], "v double")
    assert rows(statistics.nearest_percentile(five, "v", 50)) == [(3.0,)]
    assert rows(statistics.nearest_percentile(five, "v", 90)) == [(4.0,)]
    assert rows(statistics.histogram_percentile(statistics.latency_histogram(five, "v"), 95)) == [(5.0,)]
    assert rows(statistics.histogram_percentile(statistics.latency_histogram(five.limit(0), "v"), 95)) == [(0.0,)]


def test_policy():
    p = policy.PlanSwitcher()
    assert p.select("q", []) == "path_first"
    assert p.select("q", ["b", "a"]) == "b"
    for plan, s in (("a", 2.0), ("b", 1.0), ("b", 9.0)):
        p.record("q", plan, s)
    assert p.select("q", ["b", "a"]) == "a"
    assert policy.split(["a", "b"]) is None
    assert policy.split(["user", "posts", "comments", "replies"]) == (["user", "posts"], ["comments", "replies"], "posts")


def test_content_store(spark, tmp_path):
    store = ContentStore(spark, str(tmp_path / "a"))
    data = spark.createDataFrame([(b"x",), (b"x",), (b"y" * 5000,), (None,)], "data binary")
    assert store.put(data).count() == 2
    store.put(data)
    assert store.all().count() == store.sound().count() == 2
    cid = store.all().where("band = 'blob'").first().cid
    assert bytes(store.get(cid).first().data) == b"y" * 5000
    assert rows(store.stats()) == [("blob", 1, 5000), ("small", 1, 1)]
    assert store.compact(str(tmp_path / "b")).all().count() == 2


def test_algorithms(spark):
    graph = from_rows(spark, [(i, "x") for i in range(1, 7)], [(1, 2, 1), (2, 3, 1), (4, 5, 1)])
    nodes = graph.nodes()
    assert rows(algorithms.connected_components(nodes, graph.edges)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)]
    assert sum(r[1] for r in algorithms.pagerank(nodes, graph.edges, iterations=5).collect()) == pytest.approx(1.0)
    assert dict(rows(algorithms.label_propagation(nodes, graph.edges, 4)))[6] == 6
    assert tuple(algorithms.graph_stats(nodes, graph.edges).first())[:3] == (6, 3, 1)


def test_engine(spark, friends):
    e = Engine(friends)
    assert e.has_node(1) and not e.has_node(99)
    assert rows(e.edges_to(3).select("src")) == [(2,)]
    more = e.created(spark.createDataFrame([(3, 1, 1, 0)], "src long, dst long, label int, ts long"))
    assert rows(more.traverse(3, None, 1).select("rid", "depth")) == [(1, 1), (3, 0)]
    assert rows(e.without([2]).graph.edges) == []
    assert e.search("bob", "name").count() == 1
    assert e.gremlin("V().count()").first()[0] == 4


def test_escapes_are_undone_in_order(spark):
    from graphlake.functions.text import escaped_literal, unescaped_literal
    from graphlake.plans.sparql import content

    texts = ["line\nbreak", "a\\nb", 'q"q', "tab\tr\r", "\\", "\\\\n", "", "é😀"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(unescaped_literal(escaped_literal(F.col("t")))).collect()] == texts
    odd = spark.createDataFrame([(r"caf\u00e9 \U0001F600 \t\x",)], "t string")
    assert odd.select(unescaped_literal(F.col("t"))).first()[0] == "café 😀 \t\\x"
    assert df.select(content(F.concat(F.lit('"'), escaped_literal(F.col("t")), F.lit('"@en')))).collect()[0][0] == texts[0]


def test_unbounded_paths_go_to_the_end(spark):
    from graphlake.model import from_rows
    from graphlake.plans.cypher import cypher

    chain = from_rows(spark, [(i, '{"type":"N"}') for i in range(14)], [(i, i + 1, 1) for i in range(13)], {"NEXT": 1})
    assert cypher(chain, "MATCH (a {rid: 0})-[:NEXT*]->(b) RETURN b.rid AS b").count() == 13
    ring = from_rows(spark, [(i, '{"type":"N"}') for i in range(4)], [(i, (i + 1) % 4, 1) for i in range(4)], {"NEXT": 1})
    assert sorted(r.b for r in cypher(ring, "MATCH (a {rid: 0})-[:NEXT*2..]->(b) RETURN b.rid AS b").collect()) == [0, 2, 3]
    assert cypher(ring, "MATCH (a {rid: 0})-[:NEXT]->(b) RETURN 7 / 2 AS x, 7 / 0 AS y, 7.0 / 2 AS z").first() == (3, None, 3.5)


def test_a_wide_closure_is_refused(spark):
    from graphlake.operators import rdfs

    schema = [(f"<c{i}>", rdfs.SUB_CLASS, f"<c{i + 1}>") for i in range(200)]
    rows = spark.createDataFrame([("<x>", rdfs.RDF_TYPE, "<c0>")], "s string, p string, o string")
    assert rdfs.infer(rows, schema).where("s = '<x>'").count() == 200
    with pytest.raises(ValueError):
        rdfs.infer(rows, schema, most_closure=1000)


def test_snapshots_by_ranges(spark):
    from graphlake.operators import temporal

    draw = random.Random(3)
    times, asked = sorted({draw.randrange(10**6) for _ in range(300)}), [draw.randrange(-10, 11 * 10**5) for _ in range(400)]
    got = temporal.nearest_snapshot(spark.createDataFrame([(t,) for t in times], "ts long"), spark.createDataFrame([(a,) for a in asked], "as_of long"), ranges=7)
    assert {(r.as_of, r.ts) for r in got.collect()} == {(a, max(t for t in times if t <= a)) for a in asked if a >= times[0]}
    assert temporal.nearest_snapshot(spark.createDataFrame([], "ts long"), spark.createDataFrame([(1,)], "as_of long")).count() == 0
