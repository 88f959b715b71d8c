"""Rollups that can be added up, bounded state, and row groups that lookups skip."""

import datetime as dt

from pyspark.sql import functions as F

from driftwatch.schemas import DRIFT, SERIES
from driftwatch.session import use_disk_state
from driftwatch.sources import storage
from driftwatch.sources import tables as tbl
from driftwatch.sources.tables import Tables
from driftwatch.streaming import ingest, rollups

HOUR = 3_600_000_000
START = dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc)


def values(spark, *rows):
    """(hours after the start, value)"""
    return spark.createDataFrame([(START + dt.timedelta(hours=h), "n", "r", "v", "f", x) for h, x in rows], DRIFT)


def as_files(spark, folder, parts):
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{folder}/part={k}")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")


def test_late_rows_count_and_folders_stay_few(spark, tmp_path):
    parts = [values(spark, (100 - k, float(k)), (100 - k + 0.5, 1.0), (50, None)) for k in range(0, 60, 10)]
    parts.append(values(spark, (0.2, 5.0), (0.3, 7.0)))
    tables = Tables(spark, str(tmp_path / "tables"))
    stream = as_files(spark, tmp_path / "in", parts)
    sums = lambda rows: rollups.bin_sums(rows, HOUR)
    rollups.start_rollup(stream, tables, "bins", sums, str(tmp_path / "check"), fold_after=7).awaitTermination()
    got = {(r.created_at, r.value) for r in rollups.read_bins(tables, HOUR).collect()}
    at = lambda h: dt.datetime(2024, 6, 1) + dt.timedelta(hours=h)
    want = {(at(100 - k), (k + 1) / 2) for k in range(0, 60, 10) if k != 50} | {(at(50), 25.5), (at(0), 6.0)}
    assert got == want
    days = storage.folders(spark, str(tmp_path / "tables" / "bins"))
    batches = [storage.folders(spark, f"{tmp_path}/tables/bins/{d}") for d in days if d.startswith("event_date")]
    assert batches and all(len(b) == 1 for b in batches)
    # Rows of a bin have become one, and another width is another rollup.
    assert tables.read("bins").count() == len(want)
    assert rollups.read_bins(tables, HOUR // 2).count() == 0


def test_a_batch_stored_again_adds_nothing(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    rows = rollups.bin_sums(values(spark, (1, 2.0), (1, 4.0)), HOUR)
    mean = lambda: [r.value for r in rollups.read_bins(tables, HOUR).collect()]
    for _ in range(2):
        tables.write_batch("bins", rows, "s-0")
    tables.write_batch("bins", rollups.bin_sums(values(spark, (1, 9.0)), HOUR), "s-1")
    assert mean() == [5.0]
    tables.merge_days("bins", "9999-12-31")
    tables.write_batch("bins", rows, "s-0")
    assert mean() == [5.0] and tables.read("bins").count() == 1


def test_request_counters_by_hour(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    log = lambda *rows: spark.createDataFrame(
        [("GET", "/a", "200", latency, START + dt.timedelta(minutes=m)) for m, latency in rows],
        "method string, path string, status string, latency double, created_at timestamp",
    )
    tables.write_batch("requests", rollups.request_sums(log((1, 0.004), (70, 0.2))), "x-0")
    tables.write_batch("requests", rollups.request_sums(log((2, 0.3), (3, None))), "x-1")
    total = {r.le: (r.bucket_count, r.latency_sum) for r in rollups.read_requests(tables).collect()}
    assert total["+Inf"] == (4, 0.504) and total["0.005"] == (1, None) and total["0.25"][0] == 2 and total["10.0"][0] == 3
    hourly = rollups.read_requests(tables, hourly=True).where("le = '+Inf'").orderBy("created_at").collect()
    assert [r.bucket_count for r in hourly] == [3, 1]


def test_state_is_narrow_and_on_disk(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    stream = as_files(spark, tmp_path / "in", [values(spark, (1, 1.0), (1, 1.0), (1, -0.0)), values(spark, (1, 1.0), (1, 0.0), (1, None), (1, None))])
    use_disk_state(spark)
    try:
        query = (
            ingest.dedupe_stream(stream)
            .writeStream.format("parquet")
            .option("path", f"{tmp_path}/out")
            .option("checkpointLocation", f"{tmp_path}/check")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        plan = query._jsq.streamingQuery().lastExecution().executedPlan().toString()
        state = [p["stateOperators"] for p in query.recentProgress if p["stateOperators"]][-1][0]
    finally:
        spark.conf.set(provider, before)
    found = spark.read.schema(DRIFT).parquet(f"{tmp_path}/out")
    assert sorted(repr(r.value) for r in found.collect()) == ["-0.0", "1.0", "None", "None"]
    assert any("rocksdb" in name.lower() for name in state["customMetrics"])
    assert "StreamingDeduplicateWithinWatermark [_digest" in plan


def test_digests_tell_keys_apart(spark):
    t = dt.datetime(2024, 1, 1, 0, 0, 0, 1, tzinfo=dt.timezone.utc)
    rows = [
        (t, "a", "bc", "v", "f", 1.0), (t, "ab", "c", "v", "f", 1.0), (t + dt.timedelta(microseconds=1), "a", "bc", "v", "f", 1.0),
        (t, "a", "bc", "v", "f", 1.0000000000000002), (t, "a", "bc", "v", "f", float("nan")), (t, 'a","repository":"b', "c", "v", "f", 1.0),
    ]
    digests = spark.createDataFrame(rows * 2, DRIFT).select(ingest.key_digest().alias("d")).collect()
    assert len({bytes(r.d) for r in digests}) == len(rows) and all(len(r.d) == 16 for r in digests)


def test_a_lookup_skips_row_groups_by_bloom_filter(spark, tmp_path):
    """Services are spread over the whole range of names, so least and largest name skip nothing."""
    names = F.concat(F.lit("s"), F.lpad((F.col("id") * 2).cast("string"), 6, "0"))
    rows = spark.range(20_000).select(
        F.lit(START).alias("created_at"), names.alias("name"), F.lit("r").alias("repository"), F.lit("v").alias("version"),
        F.lit("f").alias("feature"), F.col("id").cast("double").alias("value"),
    )
    tables = Tables(spark, str(tmp_path))
    tables.write_batch("drift", rows, "b")

    def rows_read(name):
        df = tbl.scan_since(tables.read("drift"), START - dt.timedelta(days=1), {"name": name})
        found = df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        scans = plan.collectLeaves()
        leaf = scans.apply(0)
        return len(found), leaf.metrics().apply("numOutputRows").value()

    present, read = rows_read("s020000")
    assert present == 1 and read > 0
    assert rows_read("s020001") == (0, 0)  # between two names, in no row group
    assert rows.select(*SERIES).count() == 20_000
