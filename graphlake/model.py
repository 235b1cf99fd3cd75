"""The property graph: typed node tables, one edge table, a label dictionary and node versions.

nodes of a type live in a table of their own with typed columns, so that a property is a column that
a scan can prune and filter. Edges are one table (eid, src, dst, label, ts); reverse adjacency is the
same table read by dst. Every access is lazy.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_SCHEMA = "eid string, src long, dst long, label int, ts long"
VERSION_SCHEMA = "rid long, ts long, data string"


@dataclass(frozen=True)
class PropertyGraph:
    """tables: node type -> (rid, properties...); labels: edge type name -> label id."""

    tables: dict[str, DataFrame]
    edges: DataFrame
    labels: dict[str, int] = field(default_factory=dict)
    versions: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def type_named(self, name: str) -> str | None:
        return next((t for t in self.tables if t.lower() == name.lower()), None)

    def label_id(self, name: str | int) -> int | None:
        """By name in either case, else by number; None for a label that does not exist."""
        if isinstance(name, int):
            return name
        found = next((i for n, i in self.labels.items() if n.lower() == name.lower()), None)
        return int(name) if found is None and name.isdigit() else found

    def nodes(self, kind: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
        """(rid, type, keys...) of the nodes of a type, or of all; a key that a type lacks is null."""
        wanted = self.tables if kind is None else {k: v for k, v in self.tables.items() if k == self.type_named(kind)}
        types: dict[str, object] = {}
        for df in self.tables.values():
            for f in df.schema.fields:
                types.setdefault(f.name, f.dataType)
        parts = []
        for name, df in wanted.items():
            own_type = F.col("type") if "type" in df.columns else F.lit(name)
            columns = [F.col(k) if k in df.columns else F.lit(None).cast(types.get(k, "string")).alias(k) for k in keys if k not in ("rid", "type")]
            parts.append(df.select("rid", own_type.alias("type"), *columns))
        if not parts:
            columns = [F.lit(None).cast(types.get(k, "string")).alias(k) for k in keys if k not in ("rid", "type")]
            return self.spark.range(0).select(F.col("id").alias("rid"), F.lit("").alias("type"), *columns)
        return reduce(DataFrame.unionByName, parts)

    def edges_of(self, labels: list[str | int] | None = None, as_of: int | None = None) -> DataFrame:
        """Edges with one of the labels (an empty list has none, None has all), not younger than as_of."""
        df = self.edges
        if labels is not None:
            ids = [i for i in map(self.label_id, labels) if i is not None]
            df = df.where(F.col("label").isin(ids)) if ids else df.where(F.lit(False))
        return df if as_of is None else df.where(F.col("ts") <= as_of)


def from_rows(spark: SparkSession, nodes: list[tuple], edges: list[tuple] = (), labels: dict[str, int] | None = None, schema: str | None = None) -> PropertyGraph:
    """A graph of (rid, JSON payload) nodes and (src, dst, label[, ts]) edges.

    The payloads' types are read from the payloads unless schema (DDL) names them. A payload that is
    no JSON object has no properties; it stays in the column data.
    """
    raw = spark.createDataFrame([(r, d) for r, d in nodes], "rid long, data string")
    edge_rows = [(str(i), e[0], e[1], e[2], e[3] if len(e) > 3 else 0) for i, e in enumerate(edges)]
    return from_payloads(raw, spark.createDataFrame(edge_rows, EDGE_SCHEMA), labels, schema)


def from_payloads(nodes: DataFrame, edges: DataFrame, labels: dict[str, int] | None = None, schema: str | None = None) -> PropertyGraph:
    """A graph of nodes (rid, data) whose properties are the keys of the JSON in data."""
    valid = F.when(F.ltrim("data").startswith("{") & F.expr("try_parse_json(data) is not null"), F.col("data"))
    if schema is None:
        schema = nodes.select(F.expr("schema_of_variant_agg(try_parse_json(data))").alias("s")).where("s like 'OBJECT%'").collect()
        schema = schema[0].s.removeprefix("OBJECT").strip("<>") if schema else ""
        schema = ", ".join(f"`{k.strip().strip('`')}` {'string' if t.strip() in ('VOID', 'VARIANT') else t.strip()}" for k, t in (x.split(":", 1) for x in schema.split(", ") if ":" in x))
    if schema:
        df = nodes.withColumn("_p", F.from_json(valid, schema)).select("rid", "data", "_p.*")
    else:
        df = nodes
    return PropertyGraph({"": df}, edges, labels or {}, None)
