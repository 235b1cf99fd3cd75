"""Capabilities, leases, audit rows and checked execution."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Permission bits.
READ, WRITE, EXECUTE, DERIVE, DELEGATE = 1, 2, 4, 8, 16


def contains(address: Column, base: Column | None = None, length: Column | None = None) -> Column:
    base, length = F.col("base") if base is None else base, F.col("len") if length is None else length
    return (address >= base) & (address < base + length)


def has_permission(wanted: int, perms: Column | None = None) -> Column:
    """Any of the wanted bits."""
    return (F.col("perms") if perms is None else perms).bitwiseAND(F.lit(wanted)) != 0


def composed(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    """base: the greater, len: the lesser, perms: those of both; proof: a hash of what went in."""
    both = a.alias("a").join(b.alias("b"), on) if on else a.alias("a").crossJoin(b.alias("b"))
    base, length, perms = F.greatest("a.base", "b.base"), F.least("a.len", "b.len"), F.col("a.perms").bitwiseAND(F.col("b.perms"))
    proof = F.sha2(F.concat_ws(":", "a.base", "a.len", "a.perms", "b.base", "b.len", "b.perms"), 256)
    return both.select(*(on or []), base.alias("base"), length.alias("len"), perms.alias("perms"), proof.alias("proof"))


def in_scope(rows: DataFrame, address: str, caps: DataFrame, wanted: int, grain: int = 1 << 20) -> DataFrame:
    """rows with each capability that covers their address and has a wanted bit.

    A range join: regions are listed by the grains that they touch, so rows and regions meet by an
    equal grain and are compared only there. A region longer than many grains is listed often;
    choose the grain by the regions' usual length.
    """
    allowed = caps.where(has_permission(wanted) & (F.col("len") > 0))
    listed = allowed.withColumn("_grain", F.explode(F.sequence(F.floor(F.col("base") / grain), F.floor((F.col("base") + F.col("len") - 1) / grain))))
    return rows.withColumn("_grain", F.floor(F.col(address) / grain)).join(listed, "_grain").where(contains(F.col(address))).drop("_grain")


def valid_leases(leases: DataFrame, now: int) -> DataFrame:
    """A lease that expires just now still holds."""
    return leases.where(F.col("expires_at") >= now)


def renewed(leases: DataFrame, lease_id: int, expires_at: int) -> DataFrame:
    """Only a lease that renews itself is prolonged."""
    return leases.withColumn("expires_at", F.when((F.col("lease_id") == lease_id) & F.col("auto_renew"), F.lit(expires_at)).otherwise(F.col("expires_at")))


def granted(leases: DataFrame, lease_id: int, cid: str, owner: str, now: int, length: int, auto_renew: bool = False) -> DataFrame:
    """leases with a new one (lease_id, cid, owner, expires_at, auto_renew), unless a valid one of another owner holds the content."""
    held = valid_leases(leases, now).where((F.col("cid") == cid) & (F.col("owner") != owner)).limit(1)
    new = leases.sparkSession.createDataFrame([(lease_id, cid, owner, now + length, auto_renew)], "lease_id long, cid string, owner string, expires_at long, auto_renew boolean")
    return leases.unionByName(new.join(held.select("cid"), "cid", "left_anti"), allowMissingColumns=True)


def revoked(leases: DataFrame, lease_id: int) -> DataFrame:
    return leases.where(F.col("lease_id") != lease_id)


def audit_trail(log: DataFrame, cid: str) -> DataFrame:
    return log.where(F.col("cid") == cid)


def actor_operations(log: DataFrame, actor: str) -> DataFrame:
    return log.where(F.col("actor") == actor)


def writable(rows: DataFrame, owned: DataFrame, borrowed: DataFrame) -> DataFrame:
    """rows (cid) that a transaction may write: the first listing decides, owned before borrowed; unlisted: denied."""
    listed = owned.withColumn("_rank", F.lit(0)).unionByName(borrowed.withColumn("_rank", F.lit(1)))
    first = listed.groupBy("cid").agg(F.min(F.struct("_rank", "perms"))["perms"].alias("perms"))
    return rows.join(first.where(has_permission(WRITE)).select("cid"), "cid", "left_semi")


def mapped(rows: DataFrame, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """of(rows); the capability columns go through untouched."""
    out = of(rows)
    if lost := {"base", "len", "perms"} - set(out.columns):
        raise ValueError(f"the capability columns {sorted(lost)} are lost")
    return out


@dataclass
class SafeExecutor:
    """Checks a capability, runs, and records what happened; the log keeps the last 1000 rows."""

    log: list[tuple[str, str, str, bool, float]] = field(default_factory=list)

    def run(self, actor: str, operation: str, perms: int, wanted: int, of: Callable[[], DataFrame]) -> DataFrame:
        cid, allowed, done = hashlib.sha256(f"{actor}:{operation}".encode()).hexdigest(), bool(perms & wanted), False
        try:
            if not allowed:
                raise PermissionError(f"{actor} may not {operation}")
            out = of()
            done = True
            return out
        finally:
            self.log = [*self.log, (actor, operation, cid, done, time.time())][-1000:]
