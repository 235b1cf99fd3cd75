from graphlake.streaming import versions as streams


def test_versions_append(spark, tmp_path):
    events = streams.event_stream(spark, "/root/testdata/sf0.001/events*")
    streams.append_versions(streams.versions(events), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    streams.append_versions(streams.versions(events), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_latest_versions_stream(spark):
    events = streams.event_stream(spark, "/root/testdata/sf0.001/events*")
    run = streams.latest_versions(streams.versions(events)).writeStream.format("memory").queryName("latest_v").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").groupBy("user_id").count().count()
    assert spark.table("latest_v").count() == batch
