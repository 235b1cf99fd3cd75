"""The query catalogue over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import signatures, statistics
from .operators import access, algorithms, cache, rdfs, search, shacl, temporal, traverse
from .operators.gremlin import Traversal, g
from .plans import policy
from .plans.cypher import cypher
from .sources import content_store, ntriples
from .sources.driver_graph import EDGES, KIND, NODES, graph, micros, table

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}
C, O, P, S, N, R = (f"{k} * 1000000000000" for k in (3, 6, 5, 4, 2, 1))  # noqa: E741

#: The graph's tables in SQL.
NODE_SQL = " UNION ALL ".join(f"SELECT {kind} * 1000000000000 + {key} AS rid, '{name}' AS type FROM {source}" for name, (kind, source, key, _) in NODES.items())
EDGE_SQL = " UNION ALL ".join(f"SELECT {a[0]} * 1000000000000 + {a[1]} AS src, {b[0]} * 1000000000000 + {b[1]} AS dst, {label} AS label, {f'epoch_us({time})' if time else '0'} AS ts FROM {source}" for label, source, a, b, _, time in EDGES.values())
WITH = f"WITH RECURSIVE nodes AS ({NODE_SQL}), edges AS ({EDGE_SQL})"


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {n: f for n, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in FOUND.items() if s}


def flat(t: Traversal, *columns: str) -> DataFrame:
    """Traversers with path entries as columns."""
    return t.dataframe().select(*(F.get("path", i).alias(c) for i, c in enumerate(columns)))


# Scans and lookups


@query(f"{WITH} SELECT rid, type FROM nodes")
def scan_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph(spark, sf).nodes()


@query(f"{WITH} SELECT src, dst, label, ts FROM edges")
def scan_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph(spark, sf).edges.select("src", "dst", "label", "ts")


@query(f"SELECT {C} + c_custkey AS rid, 'Customer' AS type, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey = 7")
def node_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(graph(spark, sf)).node(3 * KIND + 7, ("name", "segment"))


@query(f"{WITH} SELECT src, dst, label, ts FROM edges WHERE src = {O} + 5")
def edges_from(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(graph(spark, sf)).edges_from(6 * KIND + 5).select("src", "dst", "label", "ts")


@query(f"{WITH} SELECT src, dst, label, ts FROM edges WHERE dst = {N} + 3")
def edges_to(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(graph(spark, sf)).edges_to(2 * KIND + 3).select("src", "dst", "label", "ts")


@query(f"{WITH} SELECT label, count(*) AS n FROM edges WHERE label = 4 GROUP BY label")
def edges_with_label(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(graph(spark, sf)).edges_with_label("placed").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH} SELECT count(*) AS n FROM edges WHERE src <> {C} + 7 AND dst <> {C} + 7")
def deleted_node(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(graph(spark, sf)).without([3 * KIND + 7]).graph.edges.agg(F.count(F.lit(1)).alias("n"))


# Traversal steps


@query(f"SELECT {C} + c_custkey AS rid FROM customer WHERE c_mktsegment = 'BUILDING'")
def has_filter(spark: SparkSession, sf: str) -> DataFrame:
    return flat(g(graph(spark, sf)).V().has("segment", "BUILDING"), "rid")


@query(f"SELECT {N} + n_nationkey AS current, n_name AS value FROM nation")
def values_step(spark: SparkSession, sf: str) -> DataFrame:
    return g(graph(spark, sf)).V().has_label("Nation").values("name").dataframe().select("current", "value")


@query(f"SELECT {C} + o_custkey AS a, {O} + o_orderkey AS b FROM orders WHERE o_custkey = 7")
def out_step(spark: SparkSession, sf: str) -> DataFrame:
    return flat(g(graph(spark, sf)).V(3 * KIND + 7).out(4), "a", "b")


@query(f"SELECT {N} + c_nationkey AS a, {C} + c_custkey AS b FROM customer WHERE c_nationkey = 3")
def in_step(spark: SparkSession, sf: str) -> DataFrame:
    return flat(g(graph(spark, sf)).V(2 * KIND + 3).in_("customer_nation"), "a", "b")


@query(f"SELECT {N} + n_nationkey AS a, {R} + n_regionkey AS b FROM nation")
def out_label_name(spark: SparkSession, sf: str) -> DataFrame:
    return flat(g(graph(spark, sf)).V().has_label("nation").out("IN_REGION"), "a", "b")


@query(f"SELECT {C} + o_custkey AS a, {O} + o_orderkey AS b, {P} + l_partkey AS c FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 7")
def gremlin_path_2hop(spark: SparkSession, sf: str) -> DataFrame:
    return flat(g(graph(spark, sf)).V(3 * KIND + 7).out("PLACED").out("CONTAINS").path(), "a", "b", "c")


@query("SELECT count(*) AS count FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def gremlin_count(spark: SparkSession, sf: str) -> DataFrame:
    return g(graph(spark, sf)).V().has_label("Customer").out("PLACED").out("CONTAINS").count().dataframe()


@query("SELECT c_mktsegment AS key, count(*) AS n FROM customer GROUP BY 1")
def gremlin_group(spark: SparkSession, sf: str) -> DataFrame:
    return g(graph(spark, sf)).V().has_label("Customer").group("segment").dataframe().select("key", F.size("rids").cast("long").alias("n"))


@query(f"SELECT {C} + c_custkey AS current FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def gremlin_order_limit(spark: SparkSession, sf: str) -> DataFrame:
    return g(graph(spark, sf)).V().has_label("Customer").order("balance", ascending=False).limit(10).dataframe().select("current")


@query(f"SELECT {R} + r_regionkey AS rid FROM region")
def gremlin_text(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(graph(spark, sf)).gremlin("g.V().hasLabel('Customer').out('CUSTOMER_NATION').out('IN_REGION').dedup()").select(F.col("current").alias("rid"))


# Traversal


def reached(start: str, hops: int, more: str = "") -> str:
    return f"{WITH}, walk(rid, depth) AS (SELECT {start}, 0 UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.rid WHERE w.depth < {hops}{more}) SELECT rid, min(depth) AS depth FROM walk GROUP BY rid"


@query(reached(f"{C} + 7", 3))
def traverse_3hop(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.traverse(graph(spark, sf), 3 * KIND + 7, None, 3)


@query(reached(f"{C} + 7", 2, " AND e.label IN (4, 5)"))
def traverse_labels(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.traverse(graph(spark, sf), 3 * KIND + 7, ["PLACED", "CONTAINS"], 2)


@query(reached(f"{C} + 7", 3, " AND e.ts <= epoch_us(TIMESTAMP '1996-06-30')"))
def traverse_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.traverse(graph(spark, sf), 3 * KIND + 7, None, 3, 836_092_800_000_000)


@query(reached(f"{C} + 7", 2).replace("SELECT rid, min(depth) AS depth FROM walk GROUP BY rid", "SELECT type, count(*) AS n FROM (SELECT DISTINCT rid FROM walk) JOIN nodes USING (rid) GROUP BY type"))
def traverse_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(graph(spark, sf)).traverse(3 * KIND + 7, None, 2).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH}, walk(rid, depth) AS (SELECT {C} + 7, 0 UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.rid WHERE w.depth < 4) SELECT min(depth) AS length FROM walk WHERE rid = {R} + 1 HAVING min(depth) IS NOT NULL")
def shortest_distance(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.bidirectional_distance(graph(spark, sf), 3 * KIND + 7, KIND + 1, None, 4)


@query(None)
def shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.shortest_path(graph(spark, sf), 3 * KIND + 7, KIND + 1, None, 4)


@query(f"SELECT {C} + o_custkey AS a, {N} + s_nationkey AS b, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2")
def meet_in_the_middle(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.path_pairs(graph(spark, sf), ["PLACED", "SUPPLIED_BY", "SUPPLIER_NATION"], 1)


# Cypher


@query("SELECT p_type AS kind, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1")
def cypher_flagship(spark: SparkSession, sf: str) -> DataFrame:
    return cypher(graph(spark, sf), "MATCH (c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) RETURN p.kind AS kind, count(*) AS n")


@query("SELECT c_name AS name, o_totalprice AS total FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000")
def cypher_match_where_return(spark: SparkSession, sf: str) -> DataFrame:
    return cypher(graph(spark, sf), "MATCH (c:Customer {segment: 'BUILDING'})-[:PLACED]->(o:Order) WHERE o.total > 200000 RETURN c.name AS name, o.total AS total")


@query("SELECT n_name AS nation, count(*) AS customers, max(c_acctbal) AS most FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def cypher_count_group(spark: SparkSession, sf: str) -> DataFrame:
    return cypher(graph(spark, sf), "MATCH (c:Customer)-[:CUSTOMER_NATION]->(n:Nation) RETURN n.name AS nation, count(c) AS customers, max(c.balance) AS most")


@query("SELECT DISTINCT c_mktsegment AS segment, o_orderpriority AS priority FROM customer JOIN orders ON o_custkey = c_custkey")
def cypher_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return cypher(graph(spark, sf), "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN DISTINCT c.segment AS segment, o.priority AS priority")


@query("SELECT p_name AS name, p_retailprice AS price FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5 OFFSET 3")
def cypher_skip_limit(spark: SparkSession, sf: str) -> DataFrame:
    return cypher(graph(spark, sf), "MATCH (p:Part) RETURN p.name AS name, p.price AS price ORDER BY p.price DESC, p.rid SKIP 3 LIMIT 5")


@query("SELECT c_name AS name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def cypher_in(spark: SparkSession, sf: str) -> DataFrame:
    return cypher(graph(spark, sf), "MATCH (c:Customer) WHERE c.segment IN ['BUILDING', 'MACHINERY'] RETURN c.name AS name")


@query("SELECT p_name AS name, p_size * 2 + 1 AS grown FROM part WHERE (p_size < 10 OR p_size >= 40) AND NOT p_brand = 'Brand#11' AND p_name <> 'x'")
def cypher_bool(spark: SparkSession, sf: str) -> DataFrame:
    return cypher(graph(spark, sf), "MATCH (p:Part) WHERE (p.size < 10 OR p.size >= 40) AND NOT p.brand = 'Brand#11' AND p.name <> 'x' RETURN p.name AS name, p.size * 2 + 1 AS grown")


@query(f"SELECT {C} + c_custkey AS c FROM customer WHERE c_nationkey = 3")
def cypher_incoming(spark: SparkSession, sf: str) -> DataFrame:
    return cypher(graph(spark, sf), f"MATCH (n:Nation)<-[:CUSTOMER_NATION]-(c) WHERE n.rid = {2 * KIND + 3} RETURN c")


@query(f"{WITH} SELECT b, count(*) AS n FROM (SELECT dst AS b FROM edges WHERE src = {N} + 3 UNION ALL SELECT src FROM edges WHERE dst = {N} + 3) GROUP BY b")
def cypher_undirected(spark: SparkSession, sf: str) -> DataFrame:
    return cypher(graph(spark, sf), f"MATCH (n:Nation)-[]-(b) WHERE n.rid = {2 * KIND + 3} RETURN b, count(*) AS n")


@query(f"{WITH}, walk(x, depth) AS (SELECT {C} + 7, 0 UNION ALL SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.x WHERE w.depth < 3) SELECT x, count(*) AS n FROM walk WHERE depth BETWEEN 1 AND 3 GROUP BY x")
def cypher_varlen(spark: SparkSession, sf: str) -> DataFrame:
    return cypher(graph(spark, sf), f"MATCH (c:Customer)-[*1..3]->(x) WHERE c.rid = {3 * KIND + 7} RETURN x, count(*) AS n")


@query("SELECT a.l_orderkey AS o, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND (a.l_partkey, a.l_suppkey) <> (b.l_partkey, b.l_suppkey) GROUP BY 1".replace("a.l_orderkey AS o", f"{O} + a.l_orderkey AS o"))
def cypher_unique_edges(spark: SparkSession, sf: str) -> DataFrame:
    return cypher(graph(spark, sf), "MATCH (p)<-[:CONTAINS]-(o:Order)-[:CONTAINS]->(q) RETURN o, count(*) AS n")


# Versions


@query(f"SELECT {C} + user_id AS rid, max(epoch_us(ts)) AS ts, arg_max(event_type, ts) AS data FROM events WHERE epoch_us(ts) <= (SELECT epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) // 2 FROM events) GROUP BY 1")
def node_as_of(spark: SparkSession, sf: str) -> DataFrame:
    times = table(spark, sf, "events").agg(F.min(micros("ts")), F.max(micros("ts"))).first()
    return temporal.latest(graph(spark, sf).versions, times[0] + (times[1] - times[0]) // 2).select("rid", "ts", "data")


@query(f"SELECT {C} + user_id AS rid, max(epoch_us(ts)) AS ts, arg_max(event_type, ts) AS data, arg_max(value, ts) AS value FROM events GROUP BY 1")
def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.latest(graph(spark, sf).versions)


@query(f"SELECT {C} + user_id AS rid, epoch_us(ts) AS valid_from, epoch_us(lead(ts) OVER w) AS valid_to, CAST(row_number() OVER w AS INTEGER) AS version FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def validity_interval(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.validity(graph(spark, sf).versions).select("rid", "valid_from", "valid_to", "version")


# Search


@query("SELECT doc_id AS rid, CAST(count(*) AS DOUBLE) AS score FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS t FROM documents) WHERE t = 'the' GROUP BY 1")
def search_term(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(table(spark, sf, "documents"), "The", "doc_id")


@query("SELECT t AS term, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS t FROM documents) WHERE t <> '' GROUP BY 1")
def term_counts(spark: SparkSession, sf: str) -> DataFrame:
    return search.term_counts(table(spark, sf, "documents"), "doc_id")


@query("SELECT item_id AS rid, t AS term, CAST(i - 1 AS INTEGER) AS pos FROM (SELECT item_id, unnest(a) AS t, unnest(range(1, len(a) + 1)) AS i FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS a FROM benchmark))")
def term_positions(spark: SparkSession, sf: str) -> DataFrame:
    return search.postings(table(spark, sf, "benchmark"), "item_id").select("rid", "term", "pos")


@query("SELECT doc_id AS rid, t AS term, CAST(i - 1 AS INTEGER) AS pos FROM (SELECT doc_id, unnest(a) AS t, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS a FROM documents))")
def term_positions_documents(spark: SparkSession, sf: str) -> DataFrame:
    return search.postings(table(spark, sf, "documents"), "doc_id").select("rid", "term", "pos")


# Triples and SPARQL

NODE = "'<https://example.org/node/' || CAST({} AS VARCHAR) || '>'"
B = "https://example.org/"


def node_iri(e: str) -> str:
    return NODE.format(e)


@query("SELECT " + node_iri(f"{N} + n_nationkey") + f" || ' <{B}rel/1> ' || " + node_iri(f"{R} + n_regionkey") + " || ' .' AS value FROM nation")
def ntriples_export(spark: SparkSession, sf: str) -> DataFrame:
    return ntriples.lines(ntriples.triples(graph(spark, sf)).where(f"p = '<{B}rel/1>'"))


@query(f"SELECT '<{B}doc/' || CAST(doc_id AS VARCHAR) || '> <{B}text> \"' || replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r') || '\" .' AS value FROM documents")
def ntriples_literals(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    rows = docs.select(F.concat(F.lit(f"<{B}doc/"), F.col("doc_id").cast("string"), F.lit(">")).alias("s"), F.lit(f"<{B}text>").alias("p"), ntriples.literal(F.col("text")).alias("o"))
    return ntriples.lines(rows)


@query(f"SELECT count(*) AS n, count(DISTINCT c_nationkey) AS objects FROM customer")
def ntriples_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = ntriples.parse_lines(ntriples.lines(ntriples.triples(graph(spark, sf)).where(f"p = '<{B}rel/2>'")))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o").alias("objects"))


def literal_sql(e: str) -> str:
    return f"'\"' || replace(replace(replace(replace(CAST({e} AS VARCHAR), chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r') || '\"'"


#: All triples of the graph: relationships, types, properties.
TRIPLE_SQL = " UNION ALL ".join(
    [f"SELECT {node_iri(f'{a[0]} * 1000000000000 + {a[1]}')} AS s, '<{B}rel/{label}>' AS p, {node_iri(f'{b[0]} * 1000000000000 + {b[1]}')} AS o FROM {source}" for label, source, a, b, _, _ in EDGES.values()]
    + [f"SELECT {node_iri(f'{kind} * 1000000000000 + {key}')}, '{ntriples.RDF_TYPE}', '<{B}type/{name}>' FROM {source}" for name, (kind, source, key, _) in NODES.items()]
    + [f"SELECT {node_iri(f'{kind} * 1000000000000 + {key}')}, '<{B}prop/{p}>', {literal_sql(c)} FROM {source} WHERE {c} IS NOT NULL" for kind, source, key, properties in NODES.values() for p, c in properties.items()]
)


@query(f"SELECT s || ' ' || p || ' ' || o || ' .' AS value FROM ({TRIPLE_SQL})")
def ntriples_export_all(spark: SparkSession, sf: str) -> DataFrame:
    """The whole graph; ntriples_export and ntriples_parse take one predicate each."""
    return ntriples.lines(ntriples.triples(graph(spark, sf)))


@query(TRIPLE_SQL)
def ntriples_parse_all(spark: SparkSession, sf: str) -> DataFrame:
    return ntriples.parse_lines(ntriples.lines(ntriples.triples(graph(spark, sf))))


@query("SELECT " + node_iri(f"{C} + c_custkey") + " AS c, '\"' || n_name || '\"' AS name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def sparql_bgp(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(graph(spark, sf)).sparql(f"PREFIX e: <{B}> SELECT ?c ?name WHERE {{ ?c e:rel/2 ?n . ?n e:prop/name ?name }}")


@query("SELECT " + node_iri(f"{P} + p_partkey") + " AS p, '\"' || CAST(p_size AS VARCHAR) || '\"' AS size FROM part WHERE p_size > 20 AND p_size <= 30 AND regexp_matches(p_brand, '[12]$')")
def sparql_filter(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(graph(spark, sf)).sparql(f'PREFIX e: <{B}> SELECT ?p ?size WHERE {{ ?p e:prop/size ?size ; e:prop/brand ?b FILTER(?size > 20 && ?size <= 30 && REGEX(?b, "[12]$")) }}')


@query("SELECT " + node_iri(f"{N} + n_nationkey") + " AS n, CASE WHEN s_suppkey IS NOT NULL THEN " + node_iri(f"{S} + s_suppkey") + " END AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey")
def sparql_optional(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(graph(spark, sf)).sparql(f"PREFIX e: <{B}> SELECT ?n ?s WHERE {{ ?n a e:type/Nation OPTIONAL {{ ?s e:rel/3 ?n }} }}")


@query("SELECT " + node_iri(f"{C} + c_custkey") + " AS x FROM customer WHERE c_nationkey = 3 UNION ALL SELECT " + node_iri(f"{S} + s_suppkey") + " FROM supplier WHERE s_nationkey = 3")
def sparql_union(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(graph(spark, sf)).sparql(f"PREFIX e: <{B}> SELECT ?x WHERE {{ {{ ?x e:rel/2 <{B}node/{2 * KIND + 3}> }} UNION {{ ?x e:rel/3 <{B}node/{2 * KIND + 3}> }} }}")


@query("SELECT " + node_iri(f"{C} + c_custkey") + " AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def sparql_minus(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(graph(spark, sf)).sparql(f"PREFIX e: <{B}> SELECT ?c WHERE {{ ?c a e:type/Customer MINUS {{ ?c e:rel/4 ?o }} }}")


@query("SELECT '\"' || c_mktsegment || '\"' AS segment, count(*) AS n, round(avg(c_acctbal), 3) AS mean FROM customer GROUP BY 1")
def sparql_group(spark: SparkSession, sf: str) -> DataFrame:
    out = Engine(graph(spark, sf)).sparql(f"PREFIX e: <{B}> SELECT ?segment (COUNT(?c) AS ?n) (AVG(?b) AS ?mean) WHERE {{ ?c e:prop/segment ?segment ; e:prop/balance ?b }} GROUP BY ?segment")
    return out.withColumn("mean", F.round("mean", 3))


@query("SELECT true AS boolean")
def sparql_ask(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(graph(spark, sf)).sparql(f"PREFIX e: <{B}> ASK {{ ?c e:rel/2 <{B}node/{2 * KIND + 3}> }}")


@query("SELECT " + node_iri(f"{C} + c_custkey") + f" AS s, '<{B}livesIn>' AS p, " + node_iri(f"{R} + n_regionkey") + " AS o FROM customer JOIN nation ON n_nationkey = c_nationkey")
def sparql_construct(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(graph(spark, sf)).sparql(f"PREFIX e: <{B}> CONSTRUCT {{ ?c e:livesIn ?r }} WHERE {{ ?c e:rel/2 ?n . ?n e:rel/1 ?r }}")


@query("SELECT '\"' || p_name || '\"' AS name FROM part ORDER BY p_retailprice DESC, p_name LIMIT 7 OFFSET 2")
def sparql_order_slice(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(graph(spark, sf)).sparql(f"PREFIX e: <{B}> SELECT ?name WHERE {{ ?p e:prop/price ?price ; e:prop/name ?name }} ORDER BY DESC(?price) ?name LIMIT 7 OFFSET 2")


# RDFS

ONTOLOGY = f"""@prefix e: <{B}> .
<{B}rel/2> rdfs:domain e:Customer ; rdfs:range e:Nation ; rdfs:subPropertyOf e:locatedIn .
<{B}rel/3> rdfs:subPropertyOf e:locatedIn .
e:locatedIn rdfs:subPropertyOf e:relatedTo .
e:type/Supplier rdfs:subClassOf e:Party . e:Customer rdfs:subClassOf e:Party . e:Party rdfs:subClassOf e:Agent .
""".replace("e:type/Supplier", f"<{B}type/Supplier>")
TYPE = ntriples.RDF_TYPE


def inferred(*rules: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = ntriples.triples(graph(spark, sf), properties=False).where(F.col("p").isin(f"<{B}rel/2>", f"<{B}rel/3>", TYPE))
        return rdfs.infer(rows, ntriples.parse_turtle(ONTOLOGY), rules or rdfs.ALL)

    return run


DOMAIN_SQL = "SELECT " + node_iri(f"{C} + c_custkey") + f" AS s, '{TYPE}' AS p, '<{B}Customer>' AS o FROM customer"
RANGE_SQL = "SELECT DISTINCT " + node_iri(f"{N} + c_nationkey") + f" AS s, '{TYPE}' AS p, '<{B}Nation>' AS o FROM customer"
LOCATED = "SELECT " + node_iri(f"{C} + c_custkey") + " AS s, " + node_iri(f"{N} + c_nationkey") + " AS o FROM customer UNION ALL SELECT " + node_iri(f"{S} + s_suppkey") + ", " + node_iri(f"{N} + s_nationkey") + " FROM supplier"
PROPERTY_SQL = f"SELECT s, p, o FROM ({LOCATED}), (VALUES ('<{B}locatedIn>'), ('<{B}relatedTo>')) q(p) UNION ALL SELECT '<{B}rel/' || k || '>', '{rdfs.SUB_PROPERTY}', '<{B}relatedTo>' FROM (VALUES ('2'), ('3')) v(k)"
UP = f"SELECT s, '{TYPE}' AS p, o FROM ({{}}), (VALUES ('<{B}Party>'), ('<{B}Agent>')) q(o)"
SUPPLIERS = "SELECT " + node_iri(f"{S} + s_suppkey") + " AS s FROM supplier"
CUSTOMERS = "SELECT " + node_iri(f"{C} + c_custkey") + " AS s FROM customer"
CLASSES = f"SELECT s, '{rdfs.SUB_CLASS}' AS p, '<{B}Agent>' AS o FROM (VALUES ('<{B}Customer>'), ('<{B}type/Supplier>')) v(s)"
FOUND["rdfs_domain"] = (inferred("domain"), DOMAIN_SQL)
FOUND["rdfs_range"] = (inferred("range"), RANGE_SQL)
FOUND["rdfs_subclass"] = (inferred("subclass"), f"{UP.format(SUPPLIERS)} UNION ALL {CLASSES}")
FOUND["rdfs_subproperty"] = (inferred("subproperty"), PROPERTY_SQL)
FOUND["rdfs_closure"] = (inferred(), f"{DOMAIN_SQL} UNION ALL {RANGE_SQL} UNION ALL {PROPERTY_SQL} UNION ALL {UP.format(SUPPLIERS)} UNION ALL {UP.format(CUSTOMERS)} UNION ALL {CLASSES}")

# SHACL


def shape_query(constraint: str, target: str = "Customer", path: str = "segment") -> Query:
    text = f'@prefix e: <{B}> . e:Shape a sh:NodeShape ; sh:targetClass e:{target} ; sh:property [ sh:path e:{path} ; {constraint} ] .'

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return shacl.validate(graph(spark, sf), text).select("focus_node", "constraint", "value")

    return run


FOUND["shacl_datatype"] = (shape_query("sh:datatype xsd:integer"), f"SELECT {C} + c_custkey AS focus_node, 'datatype' AS \"constraint\", c_mktsegment AS value FROM customer")
FOUND["shacl_mincount"] = (shape_query("sh:minCount 1", path="PLACED"), f"SELECT {C} + c_custkey AS focus_node, 'minCount' AS \"constraint\", '0' AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
FOUND["shacl_maxcount"] = (shape_query("sh:maxCount 8", path="PLACED"), f"SELECT {C} + o_custkey AS focus_node, 'maxCount' AS \"constraint\", CAST(count(*) AS VARCHAR) AS value FROM orders GROUP BY o_custkey HAVING count(*) > 8")
FOUND["shacl_pattern"] = (shape_query('sh:pattern "^b" ; sh:flags "i"'), f"SELECT {C} + c_custkey AS focus_node, 'pattern' AS \"constraint\", c_mktsegment AS value FROM customer WHERE NOT regexp_matches(lower(c_mktsegment), '^b')")
FOUND["shacl_in"] = (shape_query('sh:in ("BUILDING" "MACHINERY")'), f"SELECT {C} + c_custkey AS focus_node, 'in' AS \"constraint\", c_mktsegment AS value FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
FOUND["shacl_class"] = (shape_query("sh:class e:Part", "Order", "CONTAINS"), f"SELECT {O} + 0 AS focus_node, '' AS \"constraint\", '' AS value FROM region WHERE false")
FOUND["shacl_nodekind"] = (shape_query("sh:nodeKind sh:IRI", "Nation", "name"), f"SELECT {N} + n_nationkey AS focus_node, 'nodeKind' AS \"constraint\", n_name AS value FROM nation")
FOUND["shacl_inclusive"] = (shape_query("sh:minInclusive 10 ; sh:maxInclusive 45", "Part", "size"), f"SELECT {P} + p_partkey AS focus_node, CASE WHEN p_size < 10 THEN 'minInclusive' ELSE 'maxInclusive' END AS \"constraint\", CAST(p_size AS VARCHAR) AS value FROM part WHERE p_size < 10 OR p_size > 45")


@query("SELECT count(*) = 0 AS conforms, count(*) AS violations FROM part WHERE p_size > 45")
def shacl_report(spark: SparkSession, sf: str) -> DataFrame:
    shape = shacl.Shape("PartShape", "size", "Part", (), (shacl.Constraint("maxInclusive", 45.0),))
    return shacl.summary(shacl.validate(graph(spark, sf), [shape]))


# Content, signatures, manifests


@query("SELECT sha256(text) AS cid, any_value(octet_length(encode(text))) AS length FROM documents GROUP BY text")
def cas_put_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return content_store.records(table(spark, sf, "documents"), "text").select("cid", "length")


@query("SELECT count(DISTINCT text) AS n, true AS sound FROM documents")
def crc_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = content_store.records(table(spark, sf, "documents"), "text")
    fine = content_store.record_crc(F.col("cid"), F.col("kind"), F.col("length")) == F.col("crc")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.bool_and(fine).alias("sound"))


@query("SELECT CASE WHEN octet_length(encode(text)) < 4096 THEN 'small' ELSE 'blob' END AS band, count(DISTINCT text) AS n FROM documents GROUP BY 1")
def cas_bands(spark: SparkSession, sf: str) -> DataFrame:
    return content_store.records(table(spark, sf, "documents"), "text").groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey AS k, sha256(concat(r_name, chr(0), n_name, chr(0))) AS sig FROM nation JOIN region ON r_regionkey = n_regionkey")
def path_sig(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("r_regionkey") == F.col("n_regionkey"))  # five regions
    return both.select(F.col("n_nationkey").alias("k"), signatures.path_signature(F.array("r_name", "n_name")).alias("sig"))


@query("SELECT n_nationkey AS k, sha256(concat(least(r_name, n_name), chr(0), greatest(r_name, n_name), chr(0))) AS sig FROM nation JOIN region ON r_regionkey = n_regionkey")
def class_sig(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("r_regionkey") == F.col("n_regionkey"))  # five regions
    return both.select(F.col("n_nationkey").alias("k"), signatures.class_signature(F.array("r_name", "n_name")).alias("sig"))


def manifests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders as entries by key: the old manifest without every fifth, the new one without every seventh, every third changed."""
    orders = table(spark, sf, "orders")
    old = orders.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("result_cid"))
    new = orders.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 == 0, "changed").otherwise(F.col("o_orderstatus")).alias("result_cid"))
    return old, new


NEW_SQL = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderstatus END AS result_cid FROM orders WHERE o_orderkey % 7 <> 0"
OLD_SQL = "SELECT o_orderkey AS k, o_orderstatus AS result_cid FROM orders WHERE o_orderkey % 5 <> 0"


@query(f"SELECT coalesce(n.k, o.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'updated' END AS change, CASE WHEN n.k IS NULL THEN o.result_cid ELSE n.result_cid END AS result_cid FROM ({OLD_SQL}) o FULL JOIN ({NEW_SQL}) n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL OR o.result_cid <> n.result_cid")
def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    return cache.manifest_diff(*manifests(spark, sf), key=["k"])


@query(NEW_SQL)
def manifest_apply(spark: SparkSession, sf: str) -> DataFrame:
    old, new = manifests(spark, sf)
    return cache.apply_diff(old, cache.manifest_diff(old, new, ["k"]), ["k"])


# Capabilities


def caps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") * 50).alias("base"), (F.lit(40) + F.col("s_nationkey")).cast("long").alias("len"), (F.col("s_nationkey") % 8).alias("perms"))


CAPS_SQL = "SELECT s_suppkey, s_suppkey * 50 AS base, CAST(40 + s_nationkey AS BIGINT) AS len, s_nationkey % 8 AS perms FROM supplier"


@query(f"SELECT s_suppkey FROM ({CAPS_SQL}) WHERE 1020 >= base AND 1020 < base + len OR (perms & 2) <> 0")
def cap_filter(spark: SparkSession, sf: str) -> DataFrame:
    return caps(spark, sf).where(access.contains(F.lit(1020)) | access.has_permission(access.WRITE)).select("s_suppkey")


@query(f"SELECT p_partkey, s_suppkey FROM part JOIN ({CAPS_SQL}) ON p_partkey >= base AND p_partkey < base + len WHERE (perms & 3) <> 0")
def cap_range_join(spark: SparkSession, sf: str) -> DataFrame:
    return access.in_scope(table(spark, sf, "part").select("p_partkey"), "p_partkey", caps(spark, sf), access.READ | access.WRITE, 64).select("p_partkey", "s_suppkey")


@query(f"SELECT a.s_suppkey, greatest(a.base, a.base + 10) AS base, least(a.len, 45) AS len, a.perms & 5 AS perms FROM ({CAPS_SQL}) a")
def cap_compose(spark: SparkSession, sf: str) -> DataFrame:
    a = caps(spark, sf)
    b = a.select("s_suppkey", (F.col("base") + 10).alias("base"), F.lit(45).cast("long").alias("len"), F.lit(5).alias("perms"))
    return access.composed(a, b, ["s_suppkey"]).select("s_suppkey", "base", "len", "perms")


@query("SELECT event_id FROM events WHERE epoch_us(ts) + 3600000000 >= (SELECT epoch_us(max(ts)) FROM events)")
def lease_valid(spark: SparkSession, sf: str) -> DataFrame:
    leases = table(spark, sf, "events").select("event_id", (micros("ts") + 3_600_000_000).alias("expires_at"))
    now = table(spark, sf, "events").agg(F.max(micros("ts"))).first()[0]
    return access.valid_leases(leases, now).select("event_id")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 10")
def audit_trail(spark: SparkSession, sf: str) -> DataFrame:
    return algorithms.keep_last(table(spark, sf, "events").select("event_id", "user_id"), ["user_id"], "event_id", 10)


# Statistics


@query("SELECT l_extendedprice AS value FROM (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) AS n, count(*) OVER () AS t FROM lineitem) WHERE n = CAST(floor(0.9 * (t - 1)) AS BIGINT) + 1")
def percentile_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.nearest_percentile(table(spark, sf, "lineitem"), "l_extendedprice", 90)


@query("SELECT round(stddev_pop(o_totalprice), 2) AS deviation FROM orders")
def stddev_population(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").agg(F.round(F.stddev_pop("o_totalprice"), 2).alias("deviation"))


@query("SELECT epoch_us(o_orderdate) AS ts, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def popular_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return cache.popular_timestamps(table(spark, sf, "orders").select(micros("o_orderdate").alias("ts")), 10)


BUCKETS = "CASE " + " ".join(f"WHEN value <= {b} THEN CAST({b} AS DOUBLE)" for b in statistics.LATENCY_BOUNDS) + " ELSE CAST('Infinity' AS DOUBLE) END"


@query(f"SELECT {BUCKETS} AS bound, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.latency_histogram(table(spark, sf, "events"), "value")


@query(f"SELECT min(bound) AS bound FROM (SELECT bound, sum(n) OVER (ORDER BY bound) AS upto, sum(n) OVER () AS total FROM (SELECT {BUCKETS} AS bound, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)) WHERE upto >= floor(total * 95 / 100)")
def histogram_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.histogram_percentile(statistics.latency_histogram(table(spark, sf, "events"), "value"), 95)


@query("SELECT event_type AS plan, round(avg(value), 6) AS avg_time FROM events WHERE event_id % 10 <> 0 GROUP BY 1 ORDER BY avg(value), 1 LIMIT 1")
def best_plan(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "events").select(F.col("event_type").alias("plan"), F.col("value").alias("time"), (F.col("event_id") % 10 != 0).alias("success"))
    return policy.best_plan(runs).withColumn("avg_time", F.round("avg_time", 6))


@query("SELECT l_returnflag AS flag, round(avg(CASE WHEN l_discount < 0.05 THEN 1.0 ELSE 0.0 END), 9) AS score, CASE WHEN avg(CASE WHEN l_discount < 0.05 THEN 1.0 ELSE 0.0 END) < 0.8 THEN 'Failed' WHEN avg(CASE WHEN l_discount < 0.05 THEN 1.0 ELSE 0.0 END) < 0.95 THEN 'Warning' ELSE 'Passed' END AS status FROM lineitem GROUP BY 1")
def validation_status(spark: SparkSession, sf: str) -> DataFrame:
    scores = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.avg((F.col("l_discount") < 0.05).cast("int")), 9).alias("score"))
    return scores.withColumn("status", statistics.overall_status(F.lit(True), F.lit(True), F.lit(True), F.col("score")))


# Algorithms


@query(f"{WITH}, n AS (SELECT count(*) AS nodes FROM nodes), e AS (SELECT count(*) AS edges, count(DISTINCT label) AS labels FROM edges) SELECT nodes, edges, labels, round(edges * 1e9 / (nodes * (nodes - 1)), 3) AS density_e9, round(edges / nodes, 6) AS degree FROM n, e")
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    gr = graph(spark, sf)
    out = algorithms.graph_stats(gr.nodes(), gr.edges)
    return out.select("nodes", "edges", "labels", F.round(F.col("density") * 1e9, 3).alias("density_e9"), F.round("average_degree", 6).alias("degree"))


def nations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of customers, nations and regions."""
    gr = graph(spark, sf)
    nodes = gr.nodes("Customer").unionByName(gr.nodes("Nation")).unionByName(gr.nodes("Region"))
    return nodes, gr.edges_of(["IN_REGION", "CUSTOMER_NATION"])


@query(f"SELECT {C} + c_custkey AS rid, {R} + n_regionkey AS component FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT {N} + n_nationkey, {R} + n_regionkey FROM nation UNION ALL SELECT {R} + r_regionkey, {R} + r_regionkey FROM region")
def components(spark: SparkSession, sf: str) -> DataFrame:
    return algorithms.connected_components(*nations(spark, sf))


@query(
    "WITH v AS (SELECT (SELECT count(*) FROM customer) + 25 + 5 AS n), c AS (SELECT n_nationkey AS k, n_regionkey AS r, count(c_custkey) AS m FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2),"
    " b1 AS (SELECT n, 0.15 / n + 0.85 * (5.0 / n) / n AS x1 FROM v), n1 AS (SELECT k, r, m, x1 + 0.85 * m / n AS y1, x1, n FROM c, b1), r1 AS (SELECT r, max(x1) + 0.85 * count(*) / max(n) AS z1 FROM n1 GROUP BY r),"
    " b2 AS (SELECT 0.15 / max(n) + 0.85 * (SELECT sum(z1) FROM r1) / max(n) AS x2 FROM n1), n2 AS (SELECT k, r, x2 + 0.85 * m * x1 AS y2 FROM n1, b2), r2 AS (SELECT r, max(x2) + 0.85 * sum(y1) AS z2 FROM n1, b2 GROUP BY r)"
    f" SELECT {C} + c_custkey AS rid, round(x2 * 1e6, 4) AS rank FROM customer, b2 UNION ALL SELECT {N} + k, round(y2 * 1e6, 4) FROM n2 UNION ALL SELECT {R} + r, round(z2 * 1e6, 4) FROM r2"
)
def pagerank(spark: SparkSession, sf: str) -> DataFrame:
    return algorithms.pagerank(*nations(spark, sf), iterations=2).select("rid", F.round(F.col("rank") * 1e6, 4).alias("rank"))


@query(None)
def label_propagation(spark: SparkSession, sf: str) -> DataFrame:
    return algorithms.label_propagation(*nations(spark, sf), iterations=3)


@query(None)
def components_all(spark: SparkSession, sf: str) -> DataFrame:
    """The whole graph, as in pagerank_all and label_propagation_all; the three above take customers, nations and regions."""
    gr = graph(spark, sf)
    return algorithms.connected_components(gr.nodes(), gr.edges)


@query(None)
def pagerank_all(spark: SparkSession, sf: str) -> DataFrame:
    gr = graph(spark, sf)
    return algorithms.pagerank(gr.nodes(), gr.edges)


@query(None)
def label_propagation_all(spark: SparkSession, sf: str) -> DataFrame:
    gr = graph(spark, sf)
    return algorithms.label_propagation(gr.nodes(), gr.edges)


# Streaming


@query("SELECT CAST(epoch_us(date_trunc('day', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The stream's windows over all events, once it has read them."""
    import uuid

    from .streaming import versions as streams

    name = f"daily_{uuid.uuid4().hex}"
    events = streams.event_stream(spark, f"{sf}/events*")
    run = streams.windowed_counts(events).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select(F.unix_micros("start").alias("start"), "event_type", "n")


from . import more_queries  # noqa: E402,F401  adds its own to FOUND
