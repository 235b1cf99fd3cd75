"""Whole-graph algorithms as iterated joins; every round is written to the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .traverse import durable


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges, labels, density, average_degree)."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("label").alias("labels"))
    both = n.crossJoin(e)  # one row each
    return both.withColumns({"density": F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0), "average_degree": F.when(F.col("nodes") > 0, F.col("edges") / F.col("nodes")).otherwise(0.0)})


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 10) -> DataFrame:
    """(rid, rank): ranks sum to 1; what nodes without edges hold is spread over all."""
    n = nodes.count()
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    steps = durable(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k")).join(out, "src").select("src", "dst", (F.col("k") / F.col("out")).alias("share")))
    dangling = nodes.select("rid").join(out.select(F.col("src").alias("rid")), "rid", "left_anti").withColumn("dangles", F.lit(True))
    ranks = durable(nodes.select("rid").join(dangling, "rid", "left").withColumn("rank", F.lit(1.0 / max(n, 1))))
    for _ in range(iterations):
        lost = ranks.where("dangles").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        got = steps.join(ranks.select(F.col("rid").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("rid")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        base = (1 - damping) / max(n, 1) + damping * lost / max(n, 1)
        ranks = durable(ranks.select("rid", "dangles").join(got, "rid", "left").withColumn("rank", F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).drop("got"))
    return ranks.select("rid", "rank")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rid, component): the least rid that is joined to it, edges taken both ways."""
    both = edges.select("src", "dst").unionByName(edges.selectExpr("dst as src", "src as dst")).where("src <> dst").distinct()
    both = durable(both)
    labels = durable(nodes.select("rid", F.col("rid").alias("component")))
    while True:
        near = both.join(labels.select(F.col("rid").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("rid")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "rid", "left").select("rid", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        above = lower.select(F.col("rid").alias("component"), F.col("component").alias("above"))
        moved = durable(lower.join(above, "component", "left").select("rid", "old", F.least("component", "above").alias("component")))
        labels = moved.select("rid", "component")
        if moved.where("component <> old").isEmpty():
            return labels


def label_propagation(nodes: DataFrame, edges: DataFrame, iterations: int = 5) -> DataFrame:
    """(rid, community): each round a node takes its neighbours' most frequent label, the least of ties."""
    both = durable(edges.select("src", "dst").unionByName(edges.selectExpr("dst as src", "src as dst")).where("src <> dst"))
    labels = nodes.select("rid", F.col("rid").alias("community"))
    for _ in range(iterations):
        votes = both.join(labels.select(F.col("rid").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(F.col("src").alias("rid")).agg(F.min(F.struct(-F.col("n"), "community"))["community"].alias("best"))
        labels = durable(labels.join(best, "rid", "left").select("rid", F.coalesce("best", "community").alias("community")))
    return labels


def keep_last(rows: DataFrame, key: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key by order (plan statistics, audit trails); without a key, of all."""
    if not key:
        return rows.orderBy(F.desc(order)).limit(n)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")
