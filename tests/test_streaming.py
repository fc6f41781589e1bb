from pyspark.sql import functions as F

from pagemill.streaming import queue


def test_drain_takes_each_record_once(spark, tmp_path):
    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = spark.range(10).withColumn("status", F.lit("queued"))
    rows.write.parquet(source)
    for expected in (10, 10, 15):
        if expected == 15:
            spark.range(10, 15).withColumn("status", F.lit("queued")).write.mode("append").parquet(source)
        queue.drain(spark, source, rows.schema, sink, mark)
        assert spark.read.parquet(sink).count() == expected


def test_window_counts(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "a", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.n, r.value) for r in queue.counts_by_window(rows).collect()) == [(1, 4.0), (2, 3.0)]
