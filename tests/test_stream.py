from pyspark.sql import functions as F

from glyphtrace.streaming.text import signals, windowed, write_findings


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, "a\u200bb" * k if k % 2 else "plain", f"2024-01-01 00:{k:02d}:00") for k in range(20)] + [(20, None, None)]
    batch = spark.createDataFrame(rows, "k long, text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    write_findings(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r["k"] for r in signals(batch).filter("severity <> 'clean'").collect()) == list(range(1, 20, 2))


def test_windows(spark, tmp_path):
    batch = spark.createDataFrame([(k, "\u200b" if k % 2 else "x", f"2024-01-01 00:{k:02d}:00") for k in range(20)], "k long, text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), "ts")
    stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["rows"], r["flagged"]) for r in spark.table("counted").collect()) == [(10, 5), (10, 5)]
