"""Series and remaining time: the batch, and the stream against it."""

import datetime

from pyspark.sql import functions as F

from vitrine.streaming import progress

T0 = datetime.datetime(2024, 1, 1)
EVENTS = [("a", 0, 838, 300), ("a", 10, 838, 301), ("a", 20, 838, 302), ("a", 30, 500, 303), ("a", 30.4, 500, 304), ("a", 50, 500, 10), ("a", 60, 500, 12), ("b", 0, 5, 1), ("b", 2, 5, 1), ("b", 4, 5, 3)]
SCHEMA = "series_key string, ts timestamp, total long, current long"


def rows():
    return [(k, T0 + datetime.timedelta(seconds=s), t, c) for k, s, t, c in EVENTS]


def test_batch(spark):
    got = progress.with_eta(spark.createDataFrame(rows(), SCHEMA)).orderBy("series_key", "ts").collect()
    assert [r.series for r in got] == [1, 1, 1, 2, 2, 3, 3, 1, 1, 1]
    assert [r.sec_per_item for r in got] == [None, 10.0, 10.0, None, None, None, 5.0, None, None, 2.0]
    assert [r.eta_sec for r in got] == [None, 5380, 5370, None, None, None, 2445, None, None, 6]


def test_stream_equals_batch(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    df = spark.createDataFrame(rows(), SCHEMA)
    df.where("ts < timestamp'2024-01-01 00:00:25'").coalesce(1).write.parquet(str(source))
    stream = progress.stream_eta(spark.readStream.schema(SCHEMA).parquet(str(source)))
    for step in range(2):
        q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(out))
        q.awaitTermination()
        if not step:
            df.where("ts >= timestamp'2024-01-01 00:00:25'").coalesce(1).write.mode("append").parquet(str(source))
    columns = ["series_key", "ts", "total", "current", "series", "sec_per_item", "eta_sec"]
    got = sorted(map(tuple, spark.read.parquet(str(out)).select(columns).collect()), key=str)
    assert got == sorted(map(tuple, progress.with_eta(df).select(columns).collect()), key=str)


def test_small_rules(spark):
    df = spark.createDataFrame([("Completed", False, 5, 10), ("Stopped by user", True, 7, 10), ("Stopped", None, 10, 10), ("Running", False, 3, 10)], "status string, is_paused boolean, current long, total long")
    assert [r[0] for r in df.select(progress.is_finished()).collect()] == [True, False, True, False]
    assert [r.current for r in progress.every_nth(df).collect()] == [5, 10]
    assert df.select(F.count("*")).first()[0] == 4
