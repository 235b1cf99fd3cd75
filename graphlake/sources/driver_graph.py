"""A property graph over the star-schema tables: rid = kind * 10^12 + key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PropertyGraph

KIND = 10**12
#: type -> (kind, table, key, property -> column)
NODES = {
    "Region": (1, "region", "r_regionkey", {"name": "r_name"}),
    "Nation": (2, "nation", "n_nationkey", {"name": "n_name"}),
    "Customer": (3, "customer", "c_custkey", {"name": "c_name", "segment": "c_mktsegment", "balance": "c_acctbal"}),
    "Supplier": (4, "supplier", "s_suppkey", {"name": "s_name", "balance": "s_acctbal"}),
    "Part": (5, "part", "p_partkey", {"name": "p_name", "brand": "p_brand", "kind": "p_type", "size": "p_size", "price": "p_retailprice"}),
    "Order": (6, "orders", "o_orderkey", {"status": "o_orderstatus", "total": "o_totalprice", "priority": "o_orderpriority"}),
}
#: name -> (label, table, kind and column of src, of dst, columns that tell edges apart, time column)
EDGES = {
    "IN_REGION": (1, "nation", (2, "n_nationkey"), (1, "n_regionkey"), ("n_nationkey",), None),
    "CUSTOMER_NATION": (2, "customer", (3, "c_custkey"), (2, "c_nationkey"), ("c_custkey",), None),
    "SUPPLIER_NATION": (3, "supplier", (4, "s_suppkey"), (2, "s_nationkey"), ("s_suppkey",), None),
    "PLACED": (4, "orders", (3, "o_custkey"), (6, "o_orderkey"), ("o_orderkey",), "o_orderdate"),
    "CONTAINS": (5, "lineitem", (6, "l_orderkey"), (5, "l_partkey"), ("l_orderkey", "l_partkey", "l_suppkey"), "l_shipdate"),
    "SUPPLIED_BY": (6, "lineitem", (6, "l_orderkey"), (4, "l_suppkey"), ("l_orderkey", "l_partkey", "l_suppkey"), "l_shipdate"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> F.Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    tables = {}
    for name, (kind, source, key, properties) in NODES.items():
        columns = [F.col(c).alias(p) for p, c in properties.items()]
        tables[name] = table(spark, sf_dir, source).select((F.col(key).cast("long") + kind * KIND).alias("rid"), *columns)
    parts = []
    for label, source, (src_kind, src), (dst_kind, dst), own, time in EDGES.values():
        parts.append(table(spark, sf_dir, source).select(
            F.concat_ws(":", F.lit(label), *own).alias("eid"), (F.col(src).cast("long") + src_kind * KIND).alias("src"), (F.col(dst).cast("long") + dst_kind * KIND).alias("dst"),
            F.lit(label).alias("label"), (micros(time) if time else F.lit(0).cast("long")).alias("ts"),
        ))
    events = table(spark, sf_dir, "events").select((F.col("user_id") + 3 * KIND).alias("rid"), micros("ts").alias("ts"), F.col("event_type").alias("data"), "value")
    return PropertyGraph(tables, reduce(DataFrame.unionByName, parts), {n: e[0] for n, e in EDGES.items()}, events)
