from pyspark.sql import functions as F

from logloom.streaming.daily import daily_counts

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = daily_counts(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("daily").start()
    try:
        run.processAllAvailable()
        got = {tuple(r) for r in spark.table("daily").collect()}
    finally:
        run.stop()
    want = {tuple(r) for r in batch.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want
