"""Node versions: writes, as-of reads, validity intervals and snapshots. (rid, ts) is unique, the last write stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import PropertyGraph


def latest(versions: DataFrame, as_of: int | None = None) -> DataFrame:
    """The newest version of each node, not younger than as_of; a node without one has no row.

    One aggregation with partial results; versions are never sorted or brought together.
    """
    df = versions if as_of is None else versions.where(F.col("ts") <= as_of)
    others = [c for c in versions.columns if c not in ("rid", "ts")]
    best = df.groupBy("rid").agg(F.max(F.struct("ts", *others)).alias("v"))
    return best.select("rid", "v.*")


def node_at(versions: DataFrame, rid: int, ts: int) -> DataFrame:
    return latest(versions.where(F.col("rid") == rid), ts)


def validity(versions: DataFrame) -> DataFrame:
    """versions with valid_from, valid_to (null: still valid) and a version number from 1."""
    w = Window.partitionBy("rid").orderBy("ts")
    return versions.withColumns({"valid_from": F.col("ts"), "valid_to": F.lead("ts").over(w), "version": F.row_number().over(w)})


def write_versions(versions: DataFrame, new: DataFrame) -> DataFrame:
    """versions with new ones; a new one replaces one of the same (rid, ts)."""
    return versions.join(new.select("rid", "ts"), ["rid", "ts"], "left_anti").unionByName(new)


def deleted(versions: DataFrame, rids: DataFrame, ts: int) -> DataFrame:
    """versions with a tombstone (null data) at ts for each of rids."""
    others = {c: F.lit(None).cast(t).alias(c) for c, t in versions.dtypes if c not in ("rid", "ts")}
    return write_versions(versions, rids.select("rid", F.lit(ts).cast("long").alias("ts"), *others.values()))


def at_time(graph: PropertyGraph, ts: int) -> PropertyGraph:
    """The graph as it was: edges and versions not younger than ts."""
    return PropertyGraph(graph.tables, graph.edges_of(as_of=ts), graph.labels, None if graph.versions is None else latest(graph.versions, ts))


def nearest_snapshot(snapshots: DataFrame, asked: DataFrame, ranges: int = 1024) -> DataFrame:
    """For each asked as_of the snapshot with the greatest ts not above it; none: no row.

    Times and questions are dealt by ranges of time. A question takes the last time before it in its
    own range, else the greatest of the ranges before; of those there are at most `ranges` rows.
    """
    times = snapshots.where("ts is not null").select("ts").distinct()
    low, high = times.agg(F.min("ts"), F.max("ts")).first()
    if low is None:
        low = high = 0
    width = (high - low) // ranges + 1
    part = lambda c: F.least(F.floor((F.col(c) - low) / width), F.lit(ranges))
    wanted = asked.select("as_of").distinct().where(F.col("as_of") >= low)
    both = times.select(part("ts").alias("part"), F.col("ts").alias("at"), "ts", F.lit(None).cast("long").alias("as_of"))
    both = both.unionByName(wanted.select(part("as_of").alias("part"), F.col("as_of").alias("at"), F.lit(None).cast("long").alias("ts"), "as_of"))
    own = Window.partitionBy("part").orderBy("at", F.col("ts").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("here", F.last("ts", ignorenulls=True).over(own)).where("as_of is not null")
    tops = times.groupBy(part("ts").alias("part")).agg(F.max("ts").alias("top"))
    before = tops.groupBy().agg(F.array_sort(F.collect_list(F.struct("part", "top"))).alias("tops"))  # at most `ranges` + 1 entries
    earlier = F.array_max(F.transform(F.filter("tops", lambda x: x["part"] < F.col("part")), lambda x: x["top"]))
    hit = found.join(F.broadcast(before)).withColumn("ts", F.coalesce("here", earlier)).where("ts is not null").select("as_of", "ts")
    return hit.join(snapshots, "ts")
