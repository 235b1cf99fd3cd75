"""Expansion, breadth-first traversal and shortest paths.

A traversal is a loop over hops: the frontier meets the edges, what was seen before is taken out by
an anti join, and the level is written to the checkpoint folder, which cuts lineage. Depths are
therefore least depths. Nothing of the frontier reaches the driver but whether it is empty.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph


def durable(df: DataFrame) -> DataFrame:
    """df, computed and held in spark.checkpoint.dir; local masters that set none get a folder of their own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if root is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="graphlake-"))
    return df.checkpoint()


def expand(frontier: DataFrame, edges: DataFrame, at: str = "current", direction: str = "out") -> DataFrame:
    """frontier with the column `at` moved along each edge; eid says along which."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    one = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b"), "eid")
    if direction == "both":
        one = edges.select(F.col("src").alias("_a"), F.col("dst").alias("_b"), "eid").unionByName(edges.where("src <> dst").select(F.col("dst").alias("_a"), F.col("src").alias("_b"), "eid"))
    moved = frontier.join(one, F.col(at) == F.col("_a"))
    return moved.drop(at, "_a").withColumnRenamed("_b", at)


def traverse(graph: PropertyGraph, starts: DataFrame | int, labels: list | None = None, max_depth: int = 3, as_of: int | None = None, direction: str = "out") -> DataFrame:
    """(rid, depth): all nodes within max_depth of any start (column rid), the starts included at 0."""
    if isinstance(starts, int):
        starts = graph.spark.range(starts, starts + 1).withColumnRenamed("id", "rid")
    edges = graph.edges_of(labels, as_of)
    frontier = seen = starts.select("rid").distinct().withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        moved = expand(frontier.select(F.col("rid").alias("current")), edges, direction=direction)
        new = moved.select(F.col("current").alias("rid")).distinct().join(seen, "rid", "left_anti").withColumn("depth", F.lit(depth))
        frontier = durable(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(graph: PropertyGraph, start: int, goal: int, labels: list | None = None, max_depth: int = 10) -> DataFrame:
    """(path array<long>, length): one shortest path, that of least rids; no row if there is none."""
    edges = graph.edges_of(labels)
    spark = graph.spark
    level = spark.range(start, start + 1).select(F.col("id").alias("rid"), F.array("id").alias("path"))
    seen = level.select("rid")
    for depth in range(max_depth + 1):
        hit = level.where(F.col("rid") == goal)
        if not hit.isEmpty():
            return hit.select("path", F.lit(depth).alias("length"))
        moved = expand(level.withColumnRenamed("rid", "current"), edges)
        best = moved.groupBy(F.col("current").alias("rid")).agg(F.min("path").alias("path")).join(seen, "rid", "left_anti")
        level = durable(best.withColumn("path", F.concat("path", F.array("rid"))))
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select("rid"))
    return spark.createDataFrame([], "path array<long>, length int")


def bidirectional_distance(graph: PropertyGraph, start: int, goal: int, labels: list | None = None, max_depth: int = 10) -> DataFrame:
    """(length): hops from start to goal, by two frontiers that grow in turn and stop where they meet; no row if too far."""
    spark, edges = graph.spark, graph.edges_of(labels)
    one = lambda rid: spark.range(rid, rid + 1).select(F.col("id").alias("rid"))
    sides = [[one(start), one(start), "out"], [one(goal), one(goal), "in"]]  # frontier, what was seen, direction
    for length in range(max_depth + 1):
        if not sides[0][0].join(sides[1][0], "rid", "left_semi").isEmpty():
            return spark.createDataFrame([(length,)], "length int")
        frontier, seen, direction = side = sides[length % 2]
        moved = expand(frontier.withColumnRenamed("rid", "current"), edges, direction=direction).select(F.col("current").alias("rid")).distinct()
        side[0] = durable(moved.join(seen, "rid", "left_anti"))
        if side[0].isEmpty():
            break
        side[1] = seen.unionByName(side[0])
    return spark.createDataFrame([], "length int")


def path_pairs(graph: PropertyGraph, steps: list[str | int], split: int) -> DataFrame:
    """(a, b, n): paths along the labels of steps from a to b, counted, by two halves that meet in the middle.

    Each half is counted before they meet, so a middle node moves one row a distinct end.
    """

    def half(labels: list) -> DataFrame:
        df = graph.edges_of([labels[0]]).select(F.col("src").alias("a"), F.col("dst").alias("current"), F.lit(1).cast("long").alias("n"))
        for label in labels[1:]:
            df = expand(df, graph.edges_of([label])).groupBy("a", "current").agg(F.sum("n").alias("n"))
        return df.groupBy("a", "current").agg(F.sum("n").alias("n"))

    left, right = half(steps[:split]), half(steps[split:])
    right = right.select(F.col("a").alias("middle"), F.col("current").alias("b"), F.col("n").alias("m"))
    return left.join(right, F.col("current") == F.col("middle")).groupBy("a", "b").agg(F.sum(F.col("n") * F.col("m")).alias("n"))
