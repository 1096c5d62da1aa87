from pyspark.sql import functions as F

from inkwell.streaming import events


def test_stream_equals_batch(spark, sf, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(src))
    end = spark.createDataFrame([(10**9, "x")], "event_id long, event_type string").select("event_id", F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("user_id"), "event_type", F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    end.write.mode("append").parquet(str(src))
    q = events.windowed(events.once(events.read_events(spark, str(src))), late=None).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.window_start, r.event_type): r.n for r in spark.sql("SELECT * FROM w").collect()}
    want = {(r.window_start, r.event_type): r.n for r in events.windowed(spark.read.parquet(f"{sf}/events.parquet")).collect()}
    assert got == want
