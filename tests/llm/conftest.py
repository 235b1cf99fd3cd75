import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) rows, with extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    def make(rows, n=3):
        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(n)
        return df.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), "n_words": F.lit("clash"), "bucket": F.lit("clash"), "data": F.lit("clash"), "kept": F.lit("clash"), "rest": F.lit("clash")})

    return make
