"""Ingest that meets an index of keys in place of the stored values."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.operators.dedupe import key_digest
from driftwatch.sources import messages as msg
from driftwatch.sources.tables import Tables
from driftwatch.streaming import ingest as streams
from test_ingest import batch, envelope, spc


@pytest.fixture
def tables(spark, tmp_path):
    made = Tables(spark, str(tmp_path), key_buckets=4)
    yield made
    spark.sql(f"DROP TABLE IF EXISTS {made.keys.table}")


def lines(spark, *numbers, day=26, null=0):
    at = f"2024-06-{day}T20:43:27.957229"
    records = [spc("f", float(x), at) for x in numbers] + [spc("g", None, at)] * null
    return batch(spark, envelope("SPC", *records))


def held(tables):
    return sorted((r.value if r.value is not None else -1) for r in tables.read("drift").collect())


def test_values_are_stored_once(spark, tables):
    streams.ingest(tables, lines(spark, 1, 2, 2, null=1), "a")
    streams.ingest(tables, lines(spark, 2, 3), "b")
    streams.ingest(tables, lines(spark, 1, 2, 3, day=27), "c")
    assert held(tables) == [-1, 1, 1, 2, 2, 3, 3]
    for again in ("a", "c"):  # a repeated batch replaces itself
        streams.ingest(tables, lines(spark, 1, 2, 2, null=1) if again == "a" else lines(spark, 1, 2, 3, day=27), again)
    assert held(tables) == [-1, 1, 1, 2, 2, 3, 3]
    assert tables.open_batches("drift") == []
    tables.merge_days("drift", "2100-01-01")
    streams.ingest(tables, lines(spark, 1, 2, 2, null=1), "a")
    streams.ingest(tables, lines(spark, 1, 4), "d")
    assert held(tables) == [-1, 1, 1, 2, 2, 3, 3, 4]


def test_a_batch_that_broke_off_loses_nothing(spark, tables, monkeypatch):
    """Keys are entered before values are stored; until then they don't count for anyone."""

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(tables, "write_batch", crash)
        with pytest.raises(KeyboardInterrupt):
            streams.ingest(tables, lines(spark, 1, 2), "a")
    assert tables.open_batches("drift") == ["a"] and tables.keys.stored().count() == 2
    streams.ingest(tables, lines(spark, 2, 3), "b")
    assert held(tables) == [2, 3]
    streams.ingest(tables, lines(spark, 1, 2), "a")
    assert held(tables) == [1, 2, 3]


def test_stored_keys_are_read_where_they_lie(spark, tables):
    streams.ingest(tables, lines(spark, *range(20)), "a")
    values = msg.spc_records(msg.parse_records(lines(spark, 5, 50)))
    keyed = values.withColumn("digest", key_digest())
    missing = tables.keys.missing(keyed, [])
    assert [r.value for r in missing.collect()] == [50.0]
    plan = missing._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.index("Initial Plan") :] if "Initial Plan" in plan else plan
    stored = initial.split("SortMergeJoin", 1)[1].rsplit("Sort [digest", 1)[1]
    assert "SelectedBucketsCount: 4" in plan and "dynamicpruning" in plan
    # Above the stored keys: the days they are pruned by, which are broadcast, and no exchange.
    before_scan = stored[: stored.index("drift_keys")]
    assert "BroadcastHashJoin" in before_scan and "Exchange hashpartitioning(digest" not in before_scan


def test_another_session_and_a_rebuilt_index(spark, tables, tmp_path):
    for name, numbers in (("a", (1, 2)), ("b", (3,)), ("c", (4, 5))):
        streams.ingest(tables, lines(spark, *numbers), name)
    spark.sql(f"DROP TABLE {tables.keys.table}")
    other = Tables(spark, str(tmp_path), key_buckets=4)
    streams.ingest(other, lines(spark, 5, 6), "d")
    assert held(other) == [1, 2, 3, 4, 5, 6]
    keys = lambda: sorted((bytes(r.digest), str(r.event_date)) for r in other.keys.stored().collect())
    before = keys()
    other.keys.rebuild(other.read("drift"))
    assert keys() == before
    files = list((tmp_path / "drift_keys" / "event_date=2024-06-26").glob("*.parquet"))
    assert len(files) <= 4
    streams.ingest(other, lines(spark, 6, 7), "e")
    assert held(other) == [1, 2, 3, 4, 5, 6, 7]
    assert other.read("drift").where(F.col("ingest_batch") == "e").count() == 1


def test_days_of_a_bucket_are_written_side_by_side(spark, tables, tmp_path):
    """Tasks of a write are not as few as buckets; still a bucket of a day is one file."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    other = Tables(spark, str(tmp_path / "other"), key_buckets=1)
    spark.conf.set(setting, "false")
    try:
        messages = [lines(spark, *range(5), day=day) for day in range(1, 13)]
        for made in (other, tables):
            values = msg.spc_records(msg.parse_records(reduce(DataFrame.unionByName, messages)))
            made.keys.add(values.withColumn("digest", key_digest()), "a")
        files = [f for f in (tmp_path / "other" / "drift_keys").glob("event_date=*/*.parquet")]
        assert other.keys.stored().count() == 60 and len(files) == 12
        assert len({f.name.split("-")[1] for f in files}) > 1
        for day in range(1, 13):
            found = [f.name.split(".")[0][-5:] for f in (tmp_path / "drift_keys").glob(f"event_date=2024-06-{day:02d}/*.parquet")]
            assert found and len(found) == len(set(found))  # the number of the bucket
    finally:
        spark.conf.set(setting, before)
        spark.sql(f"DROP TABLE {other.keys.table}")
