from pyspark.sql import functions as F

from skyquilt.streaming import state


def test_throttled_stream_agrees_with_batch(spark, tmp_path):
    rows = [(i, "ab"[i % 2], i % 5 + 1) for i in range(60)]
    schema = "seq long, step string, units long"
    spark.createDataFrame(rows, schema).coalesce(1).sortWithinPartitions("seq").write.parquet(str(tmp_path / "in"))
    batch = state.throttled(spark.createDataFrame(rows, schema), "step", "seq", "units", 80, 10)
    want = sorted((r.step, r.completed, r.mark) for r in batch.collect())
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = state.throttled_stream(stream, "step", "units", 80, 10).writeStream.format("memory").queryName("throttled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.step, r.completed, r.mark) for r in spark.sql("select * from throttled").collect()) == want and len(want) > 5


def test_retained(spark):
    rows = [("s", i, f"2024-01-01 00:{i:02d}:00", 100.0 * (i + 1)) for i in range(20)] + [("t", 50, "2023-01-01 00:00:00", 1e12)]
    df = spark.createDataFrame(rows, "user string, event_id long, ts string, bytes double").withColumn("ts", F.to_timestamp("ts"))
    got = state.retained(df, "user", F.lit("2024-01-01 00:20:00").cast("timestamp"), most=5, most_bytes=7000.0).collect()
    assert sorted(r.event_id for r in got) == [17, 18, 19]
    late = state.retained(df, "user", F.lit("2024-01-01 00:20:00").cast("timestamp"), most=5, most_bytes=1e15, max_age_s=1e12).collect()
    assert sorted(r.event_id for r in late) == [15, 16, 17, 18, 19, 50]


def test_retained_stream(spark, tmp_path):
    rows = [("s", f"2024-01-01 0{h}:10:00", 5.0) for h in range(4)] * 2
    df = spark.createDataFrame(rows, "user string, ts string, bytes double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = state.retained_stream(stream, "user").writeStream.format("memory").queryName("kept").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from kept").collect()
    assert len(got) == 4 and all(r.images == 2 and r.bytes == 10.0 for r in got)
