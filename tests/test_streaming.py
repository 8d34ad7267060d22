"""A stream that goes on: windows close by later events, and a second run writes only what is new."""

import datetime as dt

from pyspark.sql import functions as F

from scantling.streaming import scoring


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    schema = "ts timestamp, sample_id long, feature_id int, value double"
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    models = spark.createDataFrame([(1, [(0, 1), (1, -1)]), (2, [(2, 1)])], "model_id long, terms array<struct<f:int,c:int>>")
    run = lambda: scoring.written(scoring.scored(spark.readStream.schema(schema).parquet(source), models, "1 day", "0 seconds"), work)
    got = lambda df: sorted((r.d, r.sample_id, r.model_id, r.score) for r in df.select(F.dayofmonth("window_start").alias("d"), "sample_id", "model_id", "score").collect())
    add([(day(1, 1), 7, 0, 5.0), (day(1, 2), 7, 0, 1.0), (day(1, 3), 7, 1, 2.0), (day(1, 4), 8, 3, 9.0), (day(2, 1), 7, 2, 3.0)])
    first = [(1, 7, 1, 4.0), (1, 7, 2, 0.0), (1, 8, 1, 0.0), (1, 8, 2, 0.0)]
    assert got(run()) == first
    assert got(run()) == first  # nothing new
    add([(day(2, 5), 7, 2, 1.0), (day(1, 9), 8, 2, 100.0), (day(3, 1), 9, 0, 1.0)])  # the second is too late
    assert got(run()) == sorted([*first, (2, 7, 1, 0.0), (2, 7, 2, 4.0)])
