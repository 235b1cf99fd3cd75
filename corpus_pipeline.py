"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of documents. Where a stage changes a text, n_chars follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm import jaccard, line_dedup, packing, quality, secret_scan
from graphlake.llm.common import importable, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned list rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("whole"))
    return quality.kept_only(rows, labels).select("whole.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; those of which nothing is left go."""
    importable(spark)
    out = line_dedup.dedup_lines(docs)
    left = out.where(~((F.col("n_removed") > 0) & (F.trim("text") == "")))
    columns = {c: F.col(c) if c in ("doc_id", "text") else F.col("rest")[c] for c in docs.columns}
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(columns["n_chars"])
    return left.select(*(e.alias(c) for c, e in columns.items()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id; of several texts under that id, one."""
    importable(spark)
    classes = jaccard.classified(docs)
    kept = classes.where("class_id is null or class_id = doc_id and class_text = text_hash").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_text")).distinct()
    same = F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == kept["kept_text"]
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]) & same, "left_semi")


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark."""
    importable(spark)
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that fill sequences of 4096 tokens."""
    import public_tokenizers

    importable(spark)
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scan", secret_scan_stage),
    ("packing", pack_sequences),
]

#: The learned rules, the near-duplicate clusters and the tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
