"""A content-addressed store as Parquet: (cid, kind, band, length, crc, data), one row a content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signatures import content_id

SMALL = 4096


def band(data: Column) -> Column:
    return F.when(F.length(data) < SMALL, "small").otherwise("blob")


def record_crc(cid: Column, kind: Column, length: Column) -> Column:
    return F.crc32(F.concat_ws("|", cid, kind.cast("string"), length.cast("string")))


def records(data: DataFrame, column: str = "data", kind: int = 0) -> DataFrame:
    """The distinct contents of a column as store records."""
    raw = data.select(F.col(column).cast("binary").alias("data")).where("data is not null")
    raw = raw.select(content_id(F.col("data")).alias("cid"), F.length("data").cast("long").alias("length"), "data").dropDuplicates(["cid", "length"])
    rows = raw.select("cid", F.lit(kind).alias("kind"), band(F.col("data")).alias("band"), "length", "data")
    return rows.withColumn("crc", record_crc(F.col("cid"), F.col("kind"), F.col("length")))


class ContentStore:
    """put() appends what is not there yet; files are cut by records, bands are folders."""

    def __init__(self, spark: SparkSession, path: str, records_per_file: int = 1_000_000):
        self.spark, self.path, self.records_per_file = spark, path, records_per_file

    def all(self) -> DataFrame:
        empty = records(self.spark.createDataFrame([], "data binary"))
        try:
            return self.spark.read.schema(empty.schema).parquet(self.path)
        except Exception as e:  # nothing was put yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return empty

    def put(self, data: DataFrame, column: str = "data", kind: int = 0) -> DataFrame:
        """The ids of the contents, after they are stored."""
        rows = records(data, column, kind)
        new = rows.join(self.all().select("cid"), "cid", "left_anti")
        new.write.mode("append").partitionBy("band").option("maxRecordsPerFile", self.records_per_file).parquet(self.path)
        return rows.select("cid")

    def get(self, cid: str) -> DataFrame:
        return self.all().where(F.col("cid") == cid).select("data")

    def contains(self, cids: DataFrame) -> DataFrame:
        return cids.join(self.all().select("cid"), "cid", "left_semi")

    def sound(self) -> DataFrame:
        """Records whose checksum agrees."""
        return self.all().where(record_crc(F.col("cid"), F.col("kind"), F.col("length")) == F.col("crc"))

    def stats(self) -> DataFrame:
        return self.all().groupBy("band").agg(F.count(F.lit(1)).alias("records"), F.sum("length").alias("bytes"))

    def compact(self, path: str) -> ContentStore:
        """The same contents in fewer files elsewhere."""
        self.all().repartition("band").write.partitionBy("band").parquet(path)
        return ContentStore(self.spark, path, self.records_per_file)
