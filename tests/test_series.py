import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from driftwatch.operators import series
from driftwatch.operators.joins import dimension_join, measured_bytes
from driftwatch.operators.slots import repeat_rows
from driftwatch.schemas import DRIFT, SERIES, SERVICE

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SERVICE_KEY = {"repository": "test", "name": "test_app", "version": "1.0.0"}


def drift(spark, rows):
    """Rows of (feature, seconds, value[, version])."""
    return spark.createDataFrame(
        [
            (START + dt.timedelta(seconds=r[1]), "test_app", "test", r[3] if len(r) > 3 else "1.0.0", r[0], r[2])
            for r in rows
        ],
        DRIFT,
    )


def test_features_per_version(spark):
    df = drift(
        spark,
        [(f"feature{i}", j, float(i)) for i in range(3) for j in range(5)] + [("feature0", 0, 1.0, "2.0.0")],
    )
    assert series.distinct_features(df, SERVICE_KEY).count() == 3
    assert series.distinct_features(df, {**SERVICE_KEY, "version": "2.0.0"}).count() == 1
    binned = series.binned_drift_series(df, "5minute", 1000, now=START, service=SERVICE_KEY)
    rows = binned.collect()
    assert sorted(r.feature for r in rows) == ["feature0", "feature1", "feature2"]
    assert all(len(r["values"]) == 5 for r in rows)


def test_truncation_skips_and_reports_empty_features(spark):
    df = drift(
        spark,
        [("a", t, float(t)) for t in range(1, 6)]
        + [("b", t, float(t)) for t in range(3, 6)]
        + [("c", -10, 1.0)],
    )
    values = series.feature_values(df, START)
    cut = series.truncated_values(values)
    got = sorted((r.feature, r.value) for r in cut.collect())
    assert got == [(f, v) for f in "ab" for v in (3.0, 4.0, 5.0)]
    empty = series.empty_features(df.select(*SERIES), values)
    assert [r.feature for r in empty.collect()] == ["c"]
    assert sorted(r.feature for r in series.drift_records(df, START, features=["a"]).collect()) == ["a"] * 5


@pytest.mark.parametrize("slot_seconds", [1, 4, 1000])
def test_truncation_against_sorting(spark, slot_seconds):
    rng = random.Random(slot_seconds)
    rows = [
        (f"f{f}", rng.randint(0, 12), rng.choice([None, 1.0, 2.0, 3.0]))
        for f, n in enumerate((40, 25, 33))
        for _ in range(n)
    ]
    got = sorted(
        (r.feature, r.created_at, r.value is None, r.value or 0)
        for r in series.truncated_values(drift(spark, rows), slot_seconds=slot_seconds).collect()
    )
    expected = []
    for f in ("f0", "f1", "f2"):
        own = [r for r in rows if r[0] == f]
        own.sort(key=lambda r: (-r[1], r[2] is None, -(r[2] or 0)))
        expected += [
            (f, (START + dt.timedelta(seconds=t)).replace(tzinfo=None), v is None, v or 0) for _, t, v in own[:25]
        ]
    assert got == sorted(expected)


def test_chunks_laid_end_to_end_are_the_series(spark):
    rng = random.Random(3)
    rows = [("a", rng.randint(0, 500), float(i)) for i in range(250)]
    chunks = series.feature_series(drift(spark, rows), chunk_rows=40).orderBy("chunk").collect()
    assert [len(c["values"]) for c in chunks] == [40] * 6 + [10]
    expected = sorted(rows, key=lambda r: (r[1], r[2]), reverse=True)
    assert [v for c in chunks for v in c["values"]] == [r[2] for r in expected]


def test_ordered_arrays_keep_nulls(spark):
    df = drift(spark, [("a", 1, None), ("a", 2, 2.0)])
    row = series.ordered_arrays(df, SERIES, ["created_at", "value"]).first()
    assert row["value"] == [2.0, None]


def test_repeat_rows(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 25)], "k string, n bigint")
    got = {r.k: r["count"] for r in repeat_rows(df, "n", chunk=10).groupBy("k").count().collect()}
    assert got == {"b": 1, "c": 25}


def test_join_beyond_the_broadcast_limit_gives_the_same_rows(spark):
    """One key holds most of the facts; the salted join spreads it and loses nothing."""
    facts = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), "id"
    )
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("k3", 3)], "k string, w int")
    assert measured_bytes(dim) > 0
    small = dimension_join(facts, dim, ["k"], ["id"])
    large = dimension_join(facts, dim, ["k"], ["id"], limit_bytes=0)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().toString()
    key = ["k", "w", "id"]
    assert large.count() == small.count()
    assert small.select(*key).exceptAll(large.select(*key)).count() == 0
    spread = large.groupBy("k").agg(F.countDistinct(F.pmod(F.xxhash64("id"), F.lit(32))).alias("n"))
    assert {r.k: r.n for r in spread.collect()}["hot"] == 32


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "drift")
    drift(spark, [("a", 1, 1.0)]).write.parquet(path)
    df = series.binned_drift(spark.read.schema(DRIFT).parquet(path), "1hour", 10, now=START, service=SERVICE_KEY)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(created_at" in plan and "EqualTo(name,test_app)" in plan


def test_null_key_parts_make_a_series_of_their_own(spark):
    rows = [(START + dt.timedelta(seconds=20 * i), "a", None, "1", f, float(i)) for i in range(3) for f in ("x", None)]
    df = spark.createDataFrame(rows, "created_at timestamp, name string, repository string, version string, feature string, value double")
    assert series.with_positions(df).count() == 6
    assert series.truncated_values(df).count() == 6
    assert series.empty_features(df, df).count() == 0
    assert {r.feature: r.values for r in series.feature_series(df).collect()} == {"x": [2.0, 1.0, 0.0], None: [2.0, 1.0, 0.0]}


def test_equal_rows_of_one_instant_are_counted_before_ordering(spark):
    df = drift(spark, [("x", 0, 1.0)]).limit(1)
    many = repeat_rows(df.withColumn("n", F.lit(250_000)), "n").drop("n")
    placed = series.with_positions(many.unionByName(df.withColumn("value", F.lit(2.0))))
    found = placed.groupBy("value").agg(F.min("position"), F.max("position"), F.countDistinct("position")).orderBy("value")
    assert [tuple(r) for r in found.collect()] == [(1.0, 2, 250_001, 250_000), (2.0, 1, 1, 1)]


def test_ordering_takes_as_many_parts_as_rows_fill(spark, monkeypatch):
    """Rows come to their slot's number of newer rows in one sort, without a join of all rows."""
    monkeypatch.setattr(series, "PART_ROWS", 50)
    rng = random.Random(3)
    entries = [(rng.choice(["x", "y", None]), rng.randint(0, 300), rng.choice([None, 1.0, 2.0])) for _ in range(1000)]
    rows = [(START + dt.timedelta(seconds=t), "a", "r", "1", f, v) for f, t, v in entries]
    rows.append((None, "a", "r", "1", "x", 3.0))
    df = spark.createDataFrame(rows, "created_at timestamp, name string, repository string, version string, feature string, value double")
    placed = series.with_positions(df)
    assert placed.rdd.getNumPartitions() == 21
    found = {}
    for r in placed.collect():
        found.setdefault(r.feature, []).append((r.position, r.created_at, r.value))
    low = lambda v, least: least if v is None else v
    for own in found.values():
        own.sort(key=lambda e: e[0])
        assert [e[0] for e in own] == list(range(1, len(own) + 1))
        keys = [(low(t, dt.datetime.min), low(v, -1.0)) for _, t, v in own]
        assert keys == sorted(keys, reverse=True)
    assert sum(map(len, found.values())) == 1001


def test_truncation_reads_from_the_oldest_cut(spark, tmp_path):
    rows = [(START + dt.timedelta(days=i), "a", "r", "1", f, float(i)) for i in range(9) for f in ("x", "y") if f == "x" or i > 6]
    df = spark.createDataFrame(rows, "created_at timestamp, name string, repository string, version string, feature string, value double")
    df.withColumn("event_date", F.to_date("created_at")).write.partitionBy("event_date").parquet(str(tmp_path / "t"))
    cut = series.drift_records(spark.read.parquet(str(tmp_path / "t")), START - dt.timedelta(days=1))
    assert sorted((r.feature, r.value) for r in cut.collect()) == [("x", 7.0), ("x", 8.0), ("y", 7.0), ("y", 8.0)]
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "(event_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_bins_beyond_a_chunk_continue_in_further_rows(spark):
    rows = [(START + dt.timedelta(minutes=i), "a", "r", "1", "x", float(i)) for i in range(25)]
    bins = spark.createDataFrame(rows, "created_at timestamp, name string, repository string, version string, feature string, value double")
    chunks = series.binned_arrays(bins, SERIES, ["created_at", "value"], 60_000_000, chunk_bins=10).orderBy("chunk").collect()
    assert [r.chunk for r in chunks] == [0, 1, 2]
    assert [v for r in chunks for v in r.value] == [float(i) for i in range(24, -1, -1)]
