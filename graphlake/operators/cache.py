"""Result manifests, traces and snapshots' access counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QKEY = ["path_sig", "class_sig", "as_of", "cap_base", "cap_len", "type_part"]


def manifest_diff(old: DataFrame, new: DataFrame, key: list[str] = QKEY, value: str = "result_cid") -> DataFrame:
    """key, change ('added', 'removed', 'updated') and value (the new one; the old one of a removed key)."""
    same = reduce(lambda a, b: a & b, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key))
    both = old.withColumn("_o", F.lit(1)).alias("o").join(new.withColumn("_n", F.lit(1)).alias("n"), same, "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col(f"o.{value}").eqNullSafe(F.col(f"n.{value}")), "updated")
    keys = [F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in key]
    return both.select(*keys, change.alias("change"), F.when(F.col("_n").isNull(), F.col(f"o.{value}")).otherwise(F.col(f"n.{value}")).alias(value)).where("change is not null")


def apply_diff(old: DataFrame, diff: DataFrame, key: list[str] = QKEY, value: str = "result_cid") -> DataFrame:
    """old after the diff: removals, then updates of keys that are there, then additions, which overwrite."""
    same = lambda a, b: reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in key))
    part = lambda *kinds: diff.where(F.col("change").isin(*kinds)).select(*key, F.col(value).alias("_v"))
    rest = old.alias("o").join(part("removed", "added").alias("d"), same("o", "d"), "left_anti")
    rest = rest.alias("o").join(part("updated").withColumn("_u", F.lit(True)).alias("d"), same("o", "d"), "left")
    rest = rest.select(*(F.col(f"o.{k}") for k in key), F.when(F.col("_u"), F.col("_v")).otherwise(F.col(f"o.{value}")).alias(value))
    return rest.unionByName(part("added").withColumnRenamed("_v", value))


def lookup(manifest: DataFrame, **key: object) -> DataFrame:
    return manifest.where(reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(v)) for k, v in key.items())))


def popular_timestamps(accesses: DataFrame, k: int) -> DataFrame:
    """(ts, n): the k most asked-for times, ties by ts."""
    return accesses.groupBy("ts").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ts").limit(k)


def combined_traces(traces: DataFrame) -> DataFrame:
    """One row (ops, ts) of rows (seq, ops array, ts): operations joined in order of seq, the latest time."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "ops"))), lambda x: x["ops"])
    return traces.agg(F.flatten(ordered).alias("ops"), F.max("ts").alias("ts"))


def normal_form(ops: DataFrame) -> DataFrame:
    """One row (hash) of ops (op, id, src, dst, label, node, key, cid): equal for equal operations in any order.

    Each operation's 256-bit hash enters sums that don't depend on the order, so that partial sums do
    and no task sees all operations. Repeated operations count as often as they come.
    """
    columns = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("op", "id", "src", "dst", "label", "node", "key", "cid")]
    own = ops.select(F.sha2(F.to_json(F.array(*columns)), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(8)]
    return own.agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *(F.coalesce(x, F.lit("0")) for x in parts)), 256).alias("hash"))
