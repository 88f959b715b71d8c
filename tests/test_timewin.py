import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftwatch.functions.timewin import (
    WINDOW_MINUTES,
    bin_microseconds,
    look_back,
    since,
    time_bin,
    window_minutes,
    window_minutes_column,
)

NOW = dt.datetime(2024, 6, 26, 20, 0, tzinfo=dt.timezone.utc)


def test_window_names(spark):
    names = [*WINDOW_MINUTES, "", "week"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    rows = df.select("n", window_minutes_column(F.col("n")).alias("m")).collect()
    assert {r.n: r.m for r in rows} == {n: window_minutes(n) for n in names}
    assert window_minutes("1hour") == 60 and window_minutes("week") == 360


def test_bin_widths():
    assert bin_microseconds(5, 1000) == 300_000
    assert bin_microseconds(5, 7) == 42_857_143
    for points in (0, -1, 10**12):
        with pytest.raises(ValueError):
            bin_microseconds(5, points)


def test_look_back_is_strict_and_open_to_the_future(spark):
    offsets = [-61, -60, -59, 0, 5]
    df = spark.createDataFrame(
        [(m, NOW + dt.timedelta(minutes=m)) for m in offsets], "m int, created_at timestamp"
    )
    kept = lambda c: sorted(r.m for r in df.where(c).collect())
    assert kept(look_back("created_at", 60, NOW)) == [-59, 0, 5]
    assert kept(look_back("created_at", 60, NOW, until=NOW)) == [-59, 0]
    assert kept(since("created_at", "2024-06-26T20:00:00")) == [5]
    assert kept(since("created_at", NOW, inclusive=True)) == [0, 5]


def test_bins_start_at_the_epoch(spark):
    width = 42_857_143
    df = spark.createDataFrame([(NOW + dt.timedelta(seconds=i * 7.3),) for i in range(200)], "t timestamp")
    rows = df.select(
        F.unix_micros("t").alias("t"), F.unix_micros(time_bin("t", width)).alias("b")
    ).collect()
    assert all(r.b == r.t // width * width for r in rows)
