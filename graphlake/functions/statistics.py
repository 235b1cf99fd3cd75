"""Small aggregates: nearest-rank percentile, latency histogram, scores and statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.traverse import durable

#: Upper bounds of the latency buckets in ms; beyond the last stands infinity.
LATENCY_BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0)


def nearest_percentile(df: DataFrame, value: str, p: float) -> DataFrame:
    """One row (value): the sorted values' entry at trunc(p / 100 * (n - 1)); no interpolation. Null for no values.

    Values are counted, dealt by range and the ranges' totals summed up in order; only the range that
    holds the rank is ranked row by row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    dealt = durable(counts.repartitionByRange(value).withColumn("part", F.spark_partition_id()))
    before = 0
    totals = sorted((r.part, r.n) for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row a partition
    rank = int(p / 100.0 * (sum(n for _, n in totals) - 1)) if totals else 0
    for part, n in totals:
        if before + n > rank:
            break
        before += n
    else:
        part = -1
    one = dealt.where(F.col("part") == part).withColumn("upto", F.sum("n").over(Window.partitionBy("part").orderBy(value)))
    return one.where(F.col("upto") > rank - before).agg(F.min(value).alias("value"))


def latency_bucket(ms: Column) -> Column:
    chain = None
    for bound in LATENCY_BOUNDS:
        chain = F.when(ms <= bound, F.lit(bound)) if chain is None else chain.when(ms <= bound, F.lit(bound))
    return chain.otherwise(F.lit(float("inf")))


def latency_histogram(df: DataFrame, ms: str) -> DataFrame:
    """(bound, n) of the buckets that occur."""
    return df.where(F.col(ms).isNotNull()).groupBy(latency_bucket(F.col(ms)).alias("bound")).agg(F.count(F.lit(1)).alias("n"))


def histogram_percentile(histogram: DataFrame, p: float) -> DataFrame:
    """One row (bound): the first bucket whose running count reaches trunc(total * p / 100); 0 if empty."""
    running = histogram.withColumn("upto", F.sum("n").over(Window.orderBy("bound"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    hit = running.where(F.col("upto") >= F.floor(F.col("total") * p / 100))
    return hit.agg(F.coalesce(F.min("bound"), F.lit(0.0)).alias("bound"))


def performance_score(df: DataFrame, passed: str) -> DataFrame:
    return df.agg(F.coalesce(F.avg(F.col(passed).cast("int")), F.lit(0.0)).alias("score"))


def overall_status(math_ok: Column, security_ok: Column, integration_ok: Column, score: Column) -> Column:
    return F.when(~math_ok | ~security_ok | (score < 0.8), "Failed").when(~integration_ok | (score < 0.95), "Warning").otherwise("Passed")
