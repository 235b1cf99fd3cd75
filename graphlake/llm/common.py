"""What the operators share: durable intermediates, Arrow maps and text rows.

Conventions for every operator of this package: a null text counts as the empty text, columns
beyond those an operator names are ignored or carried along untouched, and an empty table gives
an empty result.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only for a local master that has none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphlake-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Spark's setting that removes a query's shuffle files when the query ends; read when its plan is made.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and held in the shared folder: later reads survive lost executors.

    Its shuffle files go as soon as it is written. A plan of its own is made for that, so that no
    other query over df meets a shuffle that is gone.
    """
    spark = df.sparkSession
    root = shared_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        own = df.select("*")
    finally:
        spark.conf.set(CLEANUP, before)
    return own.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of what durable() has written; call it once nothing else refers to them.

    Some rounds: listeners hold a finished query for a moment, and its shuffle goes a round after it.
    """
    for _ in range(0 if spark.sparkContext.master.startswith("local[") else 4):  # one process needs no such haste
        time.sleep(0.5)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where it stands."""
    root, paths = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    if root not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(x for x in (root, paths.get("PYTHONPATH")) if x)


def shared_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(schema))


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string), a null text as the empty one; nothing else is read."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_rows(df: DataFrame, rows_of: Callable[[], Callable[[dict], Iterator[dict] | list[dict]]], schema: str) -> DataFrame:
    """mapInArrow over column lists.

    rows_of() is called once a task and gives a function from a batch's columns (name -> list) to
    lists of output columns (name -> list), in the order of schema.
    """
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = rows_of()
        for batch in batches:
            for part in slices(batch):
                columns = step({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                if columns is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about most_bytes, so that a worker's memory does not follow the batch."""
    n = batch.num_rows
    step = max(1, n * most_bytes // max(most_bytes, batch.nbytes))
    for i in range(0, n, step):
        yield batch.slice(i, step)
    give_back()


@cache
def trimmer() -> Callable[[int], int] | None:
    """The C library's call that hands freed memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Hands freed memory back: a worker process outlives its tasks, and what it keeps adds up beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    if trim := trimmer():
        trim(0)
