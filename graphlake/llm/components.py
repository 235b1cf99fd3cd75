"""Connected components of an edge table, by least labels with pointer jumping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


#: Up to so many edges (16 bytes each) the driver labels in memory: each round of jobs costs it more than these.
SMALL = 1 << 20


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, label) of the edges' ids."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(ends.ravel(), 2)
    label = np.arange(len(ids))
    while True:
        low, new = np.minimum(label[x], label[y]), label.copy()
        for side in (x, y, label[x], label[y]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def connected_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, label): the least id of each id's component; ids without an edge are not listed.

    At most `small` edges are labelled by the driver; more of them in rounds over all executors. Each round takes the least label next to an id, then that label's own label, so a path of
    length n needs about log n rounds. Rounds are written to the shared folder, which cuts lineage.
    """
    both = durable(edges.select(F.col("a").alias("id"), F.col("b").alias("near")).where("id <> near"))
    if both.count() <= small:
        held = both.toArrow()
        found = least_labels(*(held.column(c).to_numpy() for c in ("id", "near")))
        return durable(both.sparkSession.createDataFrame(pa.table([pa.array(x, pa.int64()) for x in found], ["id", "label"])))
    both = durable(both.unionByName(both.selectExpr("near as id", "id as near")).distinct())
    labels = durable(both.groupBy("id").agg(F.min("near").alias("near")).select("id", F.least("id", "near").alias("label")))
    while True:
        seen = both.join(labels.withColumnRenamed("id", "near"), "near").groupBy("id").agg(F.min("label").alias("seen"))
        lower = labels.join(seen, "id").select("id", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        parent = lower.select(F.col("id").alias("label"), F.col("label").alias("above"))
        moved = durable(lower.join(parent, "label", "left").select("id", "old", F.least("label", F.coalesce("above", "label")).alias("label")))
        labels = moved.select("id", "label")
        if moved.where("label <> old").isEmpty():
            return labels
