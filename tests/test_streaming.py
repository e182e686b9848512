from pyspark.sql import functions as F

from tessera.streaming.bars import daily_bars


def test_stream_equals_table(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_id", "value")
    top = table.agg(F.max("ts")).head()[0]
    late = spark.createDataFrame([(0, top, 0, 0.0)], "user_id long, ts timestamp, event_id long, value double").withColumn("ts", F.col("ts") + F.expr("interval 5 days"))
    src = str(tmp_path / "in")
    late = late.withColumn("ts", F.col("ts").cast(table.schema["ts"].dataType))
    table.unionByName(late).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(table.schema).parquet(src)
    q = daily_bars(stream).writeStream.format("memory").queryName("bars").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.instrument, r.datetime): (r.open, r.close, r.volume) for r in spark.table("bars").collect()}
    want = {(r.instrument, r.datetime): (r.open, r.close, r.volume) for r in daily_bars(table).collect()}
    assert got == want and len(want) > 100
