"""One object for all query languages and calls over a graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import EDGE_SCHEMA, PropertyGraph
from .operators import gremlin, rdfs, search, shacl, temporal, traverse
from .plans import cypher, sparql
from .sources import ntriples


@dataclass
class Engine:
    graph: PropertyGraph
    base: str = ntriples.BASE
    cached: dict[tuple, DataFrame] = field(default_factory=dict)

    def node(self, rid: int, keys: tuple[str, ...] = ()) -> DataFrame:
        return self.graph.nodes(keys=keys).where(F.col("rid") == rid)

    def has_node(self, rid: int) -> bool:
        return not self.node(rid).isEmpty()

    def list_rids(self) -> DataFrame:
        return self.graph.nodes().select("rid").orderBy("rid")

    def node_at(self, rid: int, ts: int) -> DataFrame:
        return temporal.node_at(self.graph.versions, rid, ts)

    def edges_from(self, rid: int) -> DataFrame:
        return self.graph.edges.where(F.col("src") == rid)

    def edges_to(self, rid: int) -> DataFrame:
        return self.graph.edges.where(F.col("dst") == rid)

    def edges_with_label(self, label: str | int) -> DataFrame:
        return self.graph.edges_of([label])

    def traverse(self, rid: int, labels: list | None = None, max_depth: int = 3, as_of: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
        """(rid, depth, type, keys...) of what is reached."""
        hits = traverse.traverse(self.graph, rid, labels, max_depth, as_of)
        return hits.join(self.graph.nodes(keys=keys), "rid")

    def search(self, term: str, key: str) -> DataFrame:
        """(rid, score, type, key) of nodes with the term in a property."""
        nodes = self.graph.nodes(keys=(key,))
        return search.search(nodes, term, text=key).join(nodes, "rid")

    def triples(self) -> DataFrame:
        return ntriples.triples(self.graph, self.base)

    def sparql(self, text: str) -> DataFrame:
        return sparql.sparql(self.triples(), text)

    def cypher(self, text: str) -> DataFrame:
        return cypher.cypher(self.graph, text)

    def gremlin(self, text: str) -> DataFrame:
        return gremlin.parse(self.graph, text).dataframe()

    def validate_shacl(self, shapes: str, max_violations: int | None = None, strict: bool = False) -> DataFrame:
        return shacl.validate(self.graph, shapes, max_violations, strict)

    def classify(self, ontology: str) -> DataFrame:
        """The triples that an ontology (Turtle) adds to the graph's."""
        return rdfs.infer(self.triples(), ntriples.parse_turtle(ontology, self.base))

    def created(self, edges: DataFrame | None = None, nodes: dict[str, DataFrame] | None = None) -> Engine:
        """An engine over the graph with more edges (src, dst, label, ts; eid is made if absent) and nodes, in bulk."""
        g = self.graph
        tables = dict(g.tables)
        for kind, df in (nodes or {}).items():
            tables[kind] = tables[kind].unionByName(df, allowMissingColumns=True) if kind in tables else df
        more = g.edges
        if edges is not None:
            if "eid" not in edges.columns:
                edges = edges.withColumn("eid", F.uuid())
            names = [x.split()[0] for x in EDGE_SCHEMA.split(", ")]
            more = more.unionByName(edges.select(*names))
        return Engine(PropertyGraph(tables, more, g.labels, g.versions), self.base)

    def with_new_nodes(self, kind: str, rows: DataFrame, ts: int) -> Engine:
        """An engine over the graph with rows (properties) as nodes of a type, each with a rid of its own above all others and a first version at ts."""
        g = self.graph
        top = g.nodes().agg(F.coalesce(F.max("rid"), F.lit(-1))).first()[0]
        new = traverse.durable(rows.withColumn("rid", F.monotonically_increasing_id() + top + 1))  # ids must not change between reads
        out = self.created(nodes={kind: new})
        if g.versions is None:
            return out
        others = {c: F.lit(None).cast(t).alias(c) for c, t in g.versions.dtypes if c not in ("rid", "ts", "data")}
        first = new.select("rid", F.lit(ts).cast("long").alias("ts"), F.to_json(F.struct(*rows.columns)).alias("data"), *others.values())
        return out.updated(first.select(*g.versions.columns))

    def updated(self, versions: DataFrame) -> Engine:
        g = self.graph
        return Engine(PropertyGraph(g.tables, g.edges, g.labels, temporal.write_versions(g.versions, versions)), self.base)

    def without(self, rids: list[int] | None = None, eids: list[str] | None = None) -> Engine:
        """An engine over the graph without some nodes (and their edges) and edges."""
        g, rids, eids = self.graph, rids or [], eids or []
        tables = {k: df.where(~F.col("rid").isin(rids)) for k, df in g.tables.items()}
        edges = g.edges.where(~F.col("src").isin(rids) & ~F.col("dst").isin(rids) & ~F.col("eid").isin(eids))
        return Engine(PropertyGraph(tables, edges, g.labels, g.versions), self.base)

    def result(self, key: tuple, of) -> DataFrame:
        """A result by its key, cached from the first time on."""
        if key not in self.cached:
            self.cached[key] = of().cache()
        return self.cached[key]
