"""More of the catalogue: writes, the store, validation reports, results as terms, leases, plans and streams."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import signatures, statistics, text
from .model import from_payloads
from .operators import access, cache, search, shacl, temporal, traverse
from .operators.gremlin import g
from .plans import policy, sparql
from .plans.cypher import cypher
from .queries import B, FOUND, NEW_SQL, C, N, O, P, R, S, WITH, manifests, node_iri, query
from .sources import content_store, ntriples
from .sources.driver_graph import KIND, graph, micros, table


def folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints."""
    traverse.durable(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, sf: str) -> content_store.ContentStore:
    """All texts, put in two overlapping parts."""
    store, docs = content_store.ContentStore(spark, folder(spark, "store"), 1000), table(spark, sf, "documents")
    store.put(docs.where("doc_id % 3 <> 0"), "text")
    store.put(docs.where("doc_id % 3 <> 1"), "text")
    return store


# The store

TEXTS = "SELECT sha256(text) AS cid, any_value(octet_length(encode(text))) AS length, any_value(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1"


@query(f"SELECT cid, length FROM ({TEXTS})")
def cas_put(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf).all().select("cid", "length")


@query("SELECT text FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE text IS NOT NULL)")
def cas_get(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "documents").where("text is not null").orderBy("doc_id").select(signatures.content_id(F.col("text").cast("binary")).alias("cid")).first()
    return stored(spark, sf).get(first.cid).select(F.col("data").cast("string").alias("text"))


@query("SELECT DISTINCT sha256(text) AS cid FROM documents WHERE doc_id % 7 = 0 AND text IS NOT NULL")
def cas_contains(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "documents").where("doc_id % 7 = 0 and text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("cid")).distinct()
    unknown = spark.range(5).select(F.sha2(F.concat(F.lit("unknown "), F.col("id").cast("string")).cast("binary"), 256).alias("cid"))
    return stored(spark, sf).contains(asked.unionByName(unknown))


@query(f"SELECT CASE WHEN length < 4096 THEN 'small' ELSE 'blob' END AS band, count(*) AS records, CAST(sum(length) AS BIGINT) AS bytes FROM ({TEXTS}) GROUP BY 1")
def cas_stats(spark: SparkSession, sf: str) -> DataFrame:
    store = stored(spark, sf)
    return store.compact(folder(spark, "compact")).stats()


@query(f"SELECT cid FROM ({TEXTS}) WHERE cid NOT LIKE '0%' AND cid NOT LIKE '1%'")
def cas_sound(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose checksum was broken on purpose are left out."""
    rows = content_store.records(table(spark, sf, "documents"), "text")
    path = folder(spark, "broken")
    rows.withColumn("crc", F.when(F.col("cid").rlike("^[01]"), F.col("crc") + 1).otherwise(F.col("crc"))).write.partitionBy("band").parquet(path)
    return content_store.ContentStore(spark, path).sound().select("cid")


@query("SELECT n_nationkey AS k, sha256('{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}') AS cid FROM nation")
def json_cid(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), signatures.json_content_id(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("cid"))


# Writes


@query(f"{WITH}, top AS (SELECT max(rid) AS m FROM nodes) SELECT m + 1 + i AS rid, 'Review' AS type, CAST(i AS BIGINT) AS stars FROM top, range(3) t(i)")
def create_node(spark: SparkSession, sf: str) -> DataFrame:
    new = spark.range(0, 3, 1, 1).select(F.col("id").alias("stars"))
    return Engine(graph(spark, sf)).with_new_nodes("Review", new, 5).graph.nodes("Review", ("stars",))


@query("SELECT CAST(i AS BIGINT) AS stars, CAST(77 AS BIGINT) AS ts, '{\"stars\":' || i || '}' AS data FROM range(3) t(i)")
def create_node_version(spark: SparkSession, sf: str) -> DataFrame:
    e = Engine(graph(spark, sf)).with_new_nodes("Review", spark.range(0, 3, 1, 1).select(F.col("id").alias("stars")), 77)
    return e.graph.versions.join(e.graph.nodes("Review", ("stars",)).select("rid", "stars"), "rid").select("stars", "ts", "data")


@query(f"SELECT {C} + c_custkey AS rid, 'updated' AS data FROM customer WHERE c_custkey % 5 = 0")
def update_node(spark: SparkSession, sf: str) -> DataFrame:
    e = Engine(graph(spark, sf))
    ts = 4 * 10**18
    new = e.graph.nodes("Customer").where((F.col("rid") - 3 * KIND) % 5 == 0).select("rid", F.lit(ts).alias("ts"), F.lit("updated").alias("data"), F.lit(None).cast("double").alias("value"))
    return temporal.latest(e.updated(new).graph.versions).where("data = 'updated'").select("rid", "data")


@query(f"{WITH} SELECT label, count(*) AS n FROM (SELECT label FROM edges UNION ALL SELECT 9 FROM nation) GROUP BY label")
def create_edge(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "nation").select((F.col("n_nationkey") + 2 * KIND).cast("long").alias("src"), F.lit(KIND).cast("long").alias("dst"), F.lit(9).alias("label"), F.lit(12).cast("long").alias("ts"))
    return Engine(graph(spark, sf)).created(new).graph.edges.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def bulk_create(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select((F.col("event_id") + 8 * KIND).alias("rid"), F.col("event_type").alias("kind"))
    return Engine(graph(spark, sf)).created(nodes={"Event": rows}).graph.nodes("Event", ("kind",)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH} SELECT label, count(*) AS n FROM edges WHERE ts <= 800000000000000 GROUP BY label")
def graph_at_time(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.at_time(graph(spark, sf), 800_000_000_000_000).edges.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT as_of, max(ts) AS ts FROM (SELECT DISTINCT epoch_us(l_shipdate) AS as_of FROM lineitem) JOIN (SELECT DISTINCT epoch_us(o_orderdate) AS ts FROM orders WHERE o_custkey % 10 = 0) ON ts <= as_of GROUP BY as_of")
def nearest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    snapshots = table(spark, sf, "orders").where("o_custkey % 10 = 0").select(micros("o_orderdate").alias("ts")).distinct()
    return temporal.nearest_snapshot(snapshots, table(spark, sf, "lineitem").select(micros("l_shipdate").alias("as_of"))).select("as_of", "ts")


PAYLOAD = "CASE WHEN c_custkey % 4 = 0 THEN 'no json' ELSE '{\"name\":\"' || c_name || '\",\"nation\":' || c_nationkey || '}' END"


@query(f"SELECT c_custkey AS rid, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS nation, {PAYLOAD} AS data FROM customer")
def payload_properties(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("rid"), F.when(F.col("c_custkey") % 4 == 0, "no json").otherwise(F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")))).alias("data"))
    out = from_payloads(rows, spark.createDataFrame([], "eid string, src long, dst long, label int, ts long"), schema="name string, nation long")
    return out.nodes(keys=("name", "nation", "data")).drop("type")


@query(f"SELECT '<{B}node/' || c_custkey || '>' AS s, '<{B}data>' AS p, '\"' || replace({PAYLOAD}, '\"', '\\\"') || '\"' AS o FROM customer")
def ntriples_data(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("rid"), F.when(F.col("c_custkey") % 4 == 0, "no json").otherwise(F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")))).alias("data"))
    gr = from_payloads(rows, spark.createDataFrame([], "eid string, src long, dst long, label int, ts long"), schema="name string")
    return ntriples.triples(gr, properties=False, types=False, data=True)


# Search


@query(f"SELECT {C} + c_custkey AS rid, 'Customer' AS type, c_mktsegment AS segment, CAST(1 AS DOUBLE) AS score FROM customer WHERE c_mktsegment = 'BUILDING'")
def search_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(graph(spark, sf)).search("Building", "segment").select("rid", "type", "segment", "score")


@query("SELECT rid, count(*) AS n FROM (SELECT item_id AS rid, unnest(regexp_split_to_array(lower(text), '\\s+')) AS t FROM benchmark) WHERE t = 'the' GROUP BY 1")
def search_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(table(spark, sf, "benchmark"), "THE", "item_id").select("rid", F.col("score").cast("long").alias("n"))


# Cypher


@query(f"SELECT {P} + p_partkey AS p, p_size // 7 AS q, p_size % 7 AS r, CASE WHEN p_size <> 10 THEN 100 // (p_size - 10) END AS z FROM part")
def cypher_integers(spark: SparkSession, sf: str) -> DataFrame:
    return cypher(graph(spark, sf), "MATCH (p:Part) RETURN p.rid AS p, p.size / 7 AS q, p.size % 7 AS r, 100 / (p.size - 10) AS z")


@query(f"SELECT {C} + c_custkey AS a, x AS b FROM customer JOIN nation ON n_nationkey = c_nationkey, LATERAL (SELECT unnest([{N} + c_nationkey, {R} + n_regionkey]) AS x)")
def cypher_unbounded(spark: SparkSession, sf: str) -> DataFrame:
    return cypher(graph(spark, sf), "MATCH (a:Customer)-[:CUSTOMER_NATION|IN_REGION*]->(b) RETURN a.rid AS a, b.rid AS b")


@query("SELECT r_name AS r, array_to_string(list_sort(list_transform(list_filter(list(n_name), lambda x: x <> 'FRANCE'), lambda x: lower(x))), ',') AS names FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def cypher_comprehension(spark: SparkSession, sf: str) -> DataFrame:
    out = cypher(graph(spark, sf), "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS r, [x IN collect(n.name) WHERE x <> 'FRANCE' | tolower(x)] AS names")
    return out.withColumn("names", F.array_join(F.array_sort("names"), ","))


@query(f"SELECT '{{\"rid\":' || ({R} + r_regionkey) || ',\"type\":\"Region\",\"name\":\"' || r_name || '\"}}' AS r FROM region")
def cypher_whole_node(spark: SparkSession, sf: str) -> DataFrame:
    return cypher(graph(spark, sf), "MATCH (r:Region) RETURN properties(r) AS r")


# SPARQL


@query("SELECT '\"' || c_mktsegment || '\"' AS segment, round(sum(c_acctbal), 2) AS total, min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer GROUP BY 1")
def sparql_sum_min_max(spark: SparkSession, sf: str) -> DataFrame:
    out = Engine(graph(spark, sf)).sparql(f"PREFIX e: <{B}> SELECT ?segment (SUM(?b) AS ?total) (MIN(?b) AS ?least) (MAX(?b) AS ?most) WHERE {{ ?c e:prop/segment ?segment ; e:prop/balance ?b }} GROUP BY ?segment")
    number = lambda c: F.when(F.col(c).cast("string").startswith('"'), F.regexp_extract(F.col(c).cast("string"), '"(.*)"', 1)).otherwise(F.col(c).cast("string")).cast("double")
    return out.select("segment", F.round(number("total"), 2).alias("total"), number("least").alias("least"), number("most").alias("most"))


@query("SELECT " + node_iri(f"{C} + c_custkey") + " AS c FROM customer WHERE c_mktsegment <> 'BUILDING'")
def sparql_minus_segment(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(graph(spark, sf)).sparql(f'PREFIX e: <{B}> SELECT ?c WHERE {{ ?c a e:type/Customer MINUS {{ ?c e:prop/segment "BUILDING" }} }}')


@query("SELECT " + node_iri(f"{C} + c_custkey") + " AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def sparql_exists(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(graph(spark, sf)).sparql(f'PREFIX e: <{B}> SELECT ?c WHERE {{ ?c a e:type/Customer FILTER EXISTS {{ ?c e:rel/4 ?o . ?o e:prop/status "P" }} }}')


@query("SELECT false AS boolean")
def sparql_ask_none(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(graph(spark, sf)).sparql(f"PREFIX e: <{B}> ASK {{ <{B}node/{2 * KIND + 3}> e:rel/2 ?c }}")


@query("SELECT '{\"n\":{\"type\":\"uri\",\"value\":\"" + B + "node/' || (" + N + " + n_nationkey) || '\"},\"name\":{\"type\":\"literal\",\"value\":\"' || n_name || '\"}}' AS row FROM nation")
def sparql_json_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sparql.json_rows(Engine(graph(spark, sf)).sparql(f"PREFIX e: <{B}> SELECT ?n ?name WHERE {{ ?n a e:type/Nation ; e:prop/name ?name }}"))


@query("SELECT " + node_iri(f"{N} + n_nationkey") + f" AS s, '<{B}rel/1>' AS p, " + node_iri(f"{R} + 2") + " AS o FROM nation WHERE n_regionkey = 2 UNION ALL SELECT " + node_iri(f"{R} + 2") + f", p, o FROM region, LATERAL (SELECT unnest(['{ntriples.RDF_TYPE}', '<{B}prop/name>']) AS p, unnest(['<{B}type/Region>', '\"' || r_name || '\"']) AS o) WHERE r_regionkey = 2")
def sparql_describe(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(graph(spark, sf)).sparql(f"DESCRIBE <{B}node/{KIND + 2}>")


# Traversal


@query("SELECT c_mktsegment AS key, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def gremlin_group_count(spark: SparkSession, sf: str) -> DataFrame:
    return g(graph(spark, sf)).V().has_label("Order").in_("PLACED").group_count("segment").dataframe().select("key", F.col("count").alias("n"))


# SHACL reports


def report(shape: shacl.Shape, sql: str, **options) -> tuple:
    return (lambda spark, sf: shacl.validate(graph(spark, sf), [shape], **options)), sql


def told(focus: str, shape: str, kind: str, message: str, value: str, expected: str, path: str | None, rest: str) -> str:
    return f"SELECT {focus} AS focus_node, '{shape}' AS shape_id, '{kind}' AS \"constraint\", {message} AS message, {value} AS value, '{expected}' AS expected, {f"'{path}'" if path else 'CAST(NULL AS VARCHAR)'} AS path {rest}"


one = shacl.Constraint
MANY = told(f"{C} + o_custkey", "Buyer", "maxCount", "'Expected at most 8 values, found ' || count(*)", "CAST(count(*) AS VARCHAR)", "8", "PLACED", "FROM orders GROUP BY o_custkey HAVING count(*) > 8")
FEW = told(f"{S} + s_suppkey", "Seller", "minCount", "'Expected at least 1 values, found 0'", "'0'", "1", "PLACED", "FROM supplier")
FOUND["shacl_maxcount_report"] = report(shacl.Shape("Buyer", "PLACED", "Customer", (), (one("maxCount", 8),)), MANY)
FOUND["shacl_mincount_report"] = report(shacl.Shape("Seller", "PLACED", "Supplier", (), (one("minCount", 1),)), FEW)
FOUND["shacl_datatype_report"] = report(shacl.Shape("Sized", "brand", "Part", (), (one("datatype", "integer"),)), told(f"{P} + p_partkey", "Sized", "datatype", "'Property value does not match datatype integer'", "p_brand", "integer", "brand", "FROM part WHERE NOT regexp_full_match(p_brand, '[+-]?[0-9]+')"))
FOUND["shacl_pattern_report"] = report(shacl.Shape("Named", "segment", "Customer", (), (one("pattern", "^B", "i"),)), told(f"{C} + c_custkey", "Named", "pattern", "'Value does not match pattern ^B'", "c_mktsegment", "^B", "segment", "FROM customer WHERE NOT regexp_matches(lower(c_mktsegment), '^b')"))
FOUND["shacl_in_report"] = report(shacl.Shape("Known", "segment", "Customer", (), (one("in", ("BUILDING", "MACHINERY")),)), told(f"{C} + c_custkey", "Known", "in", "'Value not in allowed set: [\"BUILDING\", \"MACHINERY\"]'", "c_mktsegment", "BUILDING,MACHINERY", "segment", "FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"))
FOUND["shacl_class_broken"] = report(shacl.Shape("Sold", "CONTAINS", "Order", (), (one("class", "Customer"),)), told(f"{O} + l_orderkey", "Sold", "class", "'Value does not satisfy class Customer'", f"CAST({P} + l_partkey AS VARCHAR)", "Customer", "CONTAINS", "FROM lineitem"))
FOUND["shacl_target_node"] = report(shacl.Shape("Two", "segment", None, (3 * KIND + 1, 3 * KIND + 2), (one("in", ("NONE",)),)), told(f"{C} + c_custkey", "Two", "in", "'Value not in allowed set: [\"NONE\"]'", "c_mktsegment", "NONE", "segment", "FROM customer WHERE c_custkey IN (1, 2)"))
FOUND["shacl_no_target"] = report(shacl.Shape("Every", "segment", None, (), (one("minCount", 1),)), f"{WITH} " + told("rid", "Every", "minCount", "'Expected at least 1 values, found 0'", "'0'", "1", "segment", "FROM nodes WHERE type <> 'Customer'"))
FOUND["shacl_node_shape"] = report(shacl.Shape("Self", None, "Region", (), (one("pattern", "3$"),)), told(f"{R} + r_regionkey", "Self", "pattern", "'Value does not match pattern 3$'", f"CAST({R} + r_regionkey AS VARCHAR)", "3$", None, "FROM region WHERE r_regionkey <> 3"))
FOUND["shacl_examples"] = ((lambda spark, sf: shacl.validate(graph(spark, sf), "").select("focus_node", "shape_id", "constraint")), f"SELECT {O} + o_orderkey AS focus_node, 'PersonNameShape' AS shape_id, 'minCount' AS \"constraint\" FROM orders")
FOUND["shacl_max_violations"] = report(shacl.Shape("Seller", "PLACED", "Supplier", (), (one("minCount", 1),)), f"SELECT * FROM ({FEW}) ORDER BY focus_node LIMIT 3", max_violations=3)


@query(FEW)
def shacl_strict(spark: SparkSession, sf: str) -> DataFrame:
    """The second shape of three is the first that does not conform; the third is not looked at."""
    shapes = [shacl.Shape("Fine", "name", "Nation", (), (one("minCount", 1),)), shacl.Shape("Seller", "PLACED", "Supplier", (), (one("minCount", 1),)), shacl.Shape("Buyer", "PLACED", "Customer", (), (one("maxCount", 1),))]
    return shacl.validate(graph(spark, sf), shapes, strict=True)


@query("SELECT p_partkey, p_size IN (0, 1) AS yes, regexp_full_match(p_brand, '[+-]?[0-9]+') AS whole FROM part")
def literal_types(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", text.is_boolean(F.col("p_size").cast("string")).alias("yes"), text.is_integer(F.col("p_brand")).alias("whole"))


# Manifests, traces, scores and plans


@query(f"SELECT k, result_cid FROM ({NEW_SQL}) WHERE k = 33")
def manifest_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return cache.lookup(manifests(spark, sf)[1], k=33)


@query("SELECT string_agg(r_name || ',' || n, ',' ORDER BY r_regionkey) AS ops, CAST(4 AS BIGINT) AS ts FROM region JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) ON n_regionkey = r_regionkey")
def trace_combine(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("n"))
    traces = table(spark, sf, "region").join(n, "r_regionkey").select(F.col("r_regionkey").alias("seq"), F.array("r_name", F.col("n").cast("string")).alias("ops"), F.col("r_regionkey").cast("long").alias("ts"))
    return cache.combined_traces(traces).select(F.array_join("ops", ",").alias("ops"), "ts")


@query("SELECT true AS same, true AS differs")
def trace_normal_form(spark: SparkSession, sf: str) -> DataFrame:
    """All edges as operations: the same in any order, another with one edge less."""
    no = F.lit(None).cast("string")
    ops = graph(spark, sf).edges.select(F.lit("edge").alias("op"), F.col("eid").alias("id"), "src", "dst", "label", no.alias("node"), no.alias("key"), no.alias("cid"))
    forms = [cache.normal_form(x).select(F.col("hash").alias(n)) for n, x in (("a", ops), ("b", ops.repartition(7, "dst")), ("c", ops.where("id <> '1:3'")))]
    return reduce(lambda x, y: x.join(y, F.lit(True)), forms).selectExpr("a = b as same", "a <> c as differs")  # three rows of one hash


@query("SELECT avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS score FROM orders")
def performance_score(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.performance_score(table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").alias("passed")), "passed")


@query("SELECT l_returnflag AS plan, avg(CASE WHEN l_linestatus <> 'O' THEN l_quantity END) AS avg_time FROM lineitem GROUP BY 1")
def plan_times(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("plan"), F.col("l_quantity").alias("time"), (F.col("l_linestatus") != "O").alias("success"))
    return policy.average_times(runs)


@query("SELECT CAST(n AS BIGINT) AS n, round(CAST(n * 2.0 * 0.1 AS DOUBLE), 6) AS path, round(CAST(n * 2.0 * (n * 0.5) * 0.1 AS DOUBLE), 6) AS typed, CAST(n * 3 * 10.0 AS DOUBLE) AS plan FROM range(1, 9) t(n)")
def plan_costs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(n, round(policy.path_cost(n), 6), round(policy.path_cost(n, n), 6), policy.plan_cost(n, 3)) for n in range(1, 9)], "n long, path double, typed double, plan double")


@query("SELECT 'first' AS step, 'path_first' AS plan UNION ALL SELECT 'no plans', 'path_first' UNION ALL SELECT 'by time', 'type_first' UNION ALL SELECT 'failures do not count', 'type_first' UNION ALL SELECT 'only the last hundred', 'path_first'")
def plan_choice(spark: SparkSession, sf: str) -> DataFrame:
    plans, s = ["path_first", "type_first"], policy.PlanSwitcher()
    out = [("first", s.select("k", plans)), ("no plans", s.select("k", []))]
    s.record("k", "path_first", 2.0)
    s.record("k", "type_first", 1.0)
    out.append(("by time", s.select("k", plans)))
    s.record("k", "path_first", 0.1, success=False)
    out.append(("failures do not count", s.select("k", plans)))
    for _ in range(100):
        s.record("k", "path_first", 3.0)
    out.append(("only the last hundred", s.select("k", plans)))
    return spark.createDataFrame(out, "step string, plan string")


# Capabilities, leases and audit

LEASES = "SELECT event_id AS lease_id, event_type AS cid, CAST(user_id AS VARCHAR) AS owner, epoch_us(ts) AS expires_at, event_id % 2 = 0 AS auto_renew FROM events"


def leases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("lease_id"), F.col("event_type").alias("cid"), F.col("user_id").cast("string").alias("owner"), micros("ts").alias("expires_at"), (F.col("event_id") % 2 == 0).alias("auto_renew"))


@query(f"SELECT lease_id, CASE WHEN lease_id IN (4, 5) AND auto_renew THEN 99 ELSE expires_at END AS expires_at FROM ({LEASES}) WHERE lease_id <> 6")
def lease_renew_revoke(spark: SparkSession, sf: str) -> DataFrame:
    return access.revoked(access.renewed(access.renewed(leases(spark, sf), 4, 99), 5, 99), 6).select("lease_id", "expires_at")


@query(f"SELECT cid, owner, expires_at FROM ({LEASES}) UNION ALL SELECT 'free', 'me', 150")
def lease_grant(spark: SparkSession, sf: str) -> DataFrame:
    """A free content is leased; one that another holds is not."""
    some = access.granted(leases(spark, sf), -1, "free", "me", 100, 50)
    return access.granted(some, -2, "free", "other", 120, 50).select("cid", "owner", "expires_at")


@query("SELECT event_id, 'cid' AS by FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'actor' FROM events WHERE user_id = 7")
def audit_filters(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select("event_id", F.col("event_type").alias("cid"), F.col("user_id").cast("string").alias("actor"))
    return access.audit_trail(log, "click").select("event_id", F.lit("cid").alias("by")).unionByName(access.actor_operations(log, "7").select("event_id", F.lit("actor").alias("by")))


@query("SELECT 'reader' AS actor, 'read' AS operation, true AS done UNION ALL SELECT 'reader', 'write', false")
def audit_append(spark: SparkSession, sf: str) -> DataFrame:
    run, regions = access.SafeExecutor(), lambda: table(spark, sf, "region")
    run.run("reader", "read", access.READ, access.READ, regions)
    try:
        run.run("reader", "write", access.READ, access.WRITE, regions)
    except PermissionError:
        pass
    return spark.createDataFrame([(a, o, d) for a, o, _, d, _ in run.log], "actor string, operation string, done boolean")


OWNED = "SELECT s_suppkey AS cid, s_nationkey % 8 AS perms, 0 AS rank FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 7, 1 FROM supplier WHERE s_suppkey % 3 = 0"


@query(f"SELECT cid FROM (SELECT cid, arg_min(perms, rank) AS perms FROM ({OWNED}) GROUP BY cid) WHERE perms & 2 <> 0")
def write_permission(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cid"), (F.col("s_nationkey") % 8).alias("perms"))
    return access.writable(rows.select("cid"), rows.where("cid % 2 = 0"), rows.where("cid % 3 = 0").withColumn("perms", F.lit(7).cast(dict(rows.dtypes)["perms"])))


@query("SELECT s_suppkey, upper(s_name) AS name, s_suppkey * 50 AS base, s_nationkey % 8 AS perms FROM supplier")
def cap_map(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("name"), (F.col("s_suppkey") * 50).alias("base"), F.lit(40).alias("len"), (F.col("s_nationkey") % 8).alias("perms"))
    return access.mapped(rows, lambda df: df.withColumn("name", F.upper("name"))).drop("len")


# Streams


@query(f"SELECT {C} + user_id AS rid, epoch_us(max(ts)) AS ts FROM events GROUP BY 1")
def stream_latest_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The newest version of each node, kept as the stream's state."""
    from .streaming import versions as streams

    name = f"latest_{uuid.uuid4().hex}"
    new = streams.versions(streams.event_stream(spark, f"{sf}/events*"))
    streams.latest_versions(new).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("rid", "ts")


@query(f"SELECT {C} + user_id AS rid, epoch_us(ts) AS ts, event_type AS data FROM events")
def stream_append_versions(spark: SparkSession, sf: str) -> DataFrame:
    from .streaming import versions as streams

    path = folder(spark, "versions")
    streams.append_versions(streams.versions(streams.event_stream(spark, f"{sf}/events*")), path, folder(spark, "progress")).awaitTermination()
    return spark.read.parquet(path).select("rid", "ts", "data")
