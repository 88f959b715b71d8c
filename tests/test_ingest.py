import datetime as dt
import json
import os

from pyspark.sql import functions as F

from driftwatch.operators.dedupe import insert_ignore
from driftwatch.schemas import DRIFT
from driftwatch.sources import messages as msg
from driftwatch.sources import tables as tbl
from driftwatch.sources.tables import Tables
from driftwatch.streaming import ingest as streams


TIME = "2024-06-26T20:43:27.957229"


def spc(feature="feature0", value=1.0, created_at=TIME, name="test_app", key="SPC"):
    return {key: {"record": {"created_at": created_at, "name": name, "repository": "test", "version": "1.0.0",
                             "feature": feature, "value": value}}}


def route():
    return {"OBSERVABILITY": {"record": {
        "name": "test_app", "repository": "test_repo", "version": "1.0.0", "request_count": 1, "error_count": 1,
        "route_metrics": [{
            "route_name": "test_route", "metrics": {"p5": 0.0, "p25": 0.0, "p50": 0.25, "p95": 0.25, "p99": 0.25},
            "request_count": 10, "error_count": 0, "error_latency": 0.0, "status_codes": {"200": 10}}]}}}


def envelope(kind, *records):
    return json.dumps({"record_type": kind, "records": list(records)})


def batch(spark, *texts):
    return spark.createDataFrame(
        [(t, dt.datetime(2024, 6, 27, tzinfo=dt.timezone.utc)) for t in texts], "value string, timestamp timestamp"
    )


def test_decode(spark):
    decoded = msg.decode(batch(
        spark,
        envelope("SPC", spc(), spc("feature1", None)),
        envelope("OBSERVABILITY", route()),
        envelope("SPC"),
    ))
    rows = decoded.spc.orderBy("feature").collect()
    assert [(r.feature, r.value) for r in rows] == [("feature0", 1.0), ("feature1", None)]
    assert rows[0].created_at == dt.datetime.fromisoformat(TIME)
    seen = decoded.observability.first()
    assert seen.created_at == dt.datetime(2024, 6, 27)
    assert seen.route_metrics[0].status_codes == {"200": 10}
    assert decoded.rejects.count() == 0


def test_dead_letters(spark):
    decoded = msg.decode(batch(
        spark,
        "{bad",
        "",
        envelope("PSI", spc(key="PSI")),
        envelope("SPC", route(), spc()),
        envelope("SPC", spc(created_at="soon")),
        envelope("SPC", spc(name="n" * 257)),
        json.dumps({"record_type": "SPC"}),
    ))
    counts = {r.reason: r["count"] for r in decoded.rejects.groupBy("reason").count().collect()}
    assert counts == {
        msg.MALFORMED: 3, msg.UNSUPPORTED: 1, msg.WRONG_VARIANT: 1, msg.BAD_TIMESTAMP: 1, msg.TOO_LONG: 1
    }
    assert decoded.rejects.where("raw is null").count() == 0
    assert decoded.spc.count() == 1 and decoded.observability.count() == 0


def test_fields_of_other_types_and_missing_ones(spark):
    wide, short = route(), route()
    wide["OBSERVABILITY"]["record"]["request_count"] = 3_000_000_000
    del short["OBSERVABILITY"]["record"]["route_metrics"]
    nameless = spc()
    del nameless["SPC"]["record"]["name"]
    decoded = msg.decode(batch(
        spark,
        envelope("SPC", spc(value="abc"), spc()),
        envelope("OBSERVABILITY", wide),
        envelope("OBSERVABILITY", short),
        envelope("SPC", nameless),
        envelope("SPC", spc(feature=None)),
    ))
    counts = {r.reason: r["count"] for r in decoded.rejects.groupBy("reason").count().collect()}
    assert counts == {msg.MALFORMED: 2, msg.MISSING_FIELD: 3}
    assert decoded.spc.count() == 0 and decoded.observability.count() == 0


def test_messages_stay_where_they_are_read(spark, tmp_path):
    """Line numbers come by a broadcast, and only records that are put aside become JSON again."""
    texts = [envelope("SPC", spc("f", float(i)), route()) if i % 7 == 0 else envelope("SPC", spc("f", float(i))) for i in range(90)]
    for file in range(3):
        (tmp_path / f"{file}.json").write_text("\n".join(texts[file * 30 : file * 30 + 30]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        records = msg.parse_records(msg.file_batch(spark, str(tmp_path)))
        plan = records._jdf.queryExecution().executedPlan().toString()
        rows = records.select("spc.value", "reason", "raw", "source", "source_position").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    written = [line for line in plan.splitlines() if "StructsToJson" in line]
    assert len(written) == 1 and "AS arrived_at" in written[0]
    places = {r.value: (os.path.basename(r.source), r.source_position) for r in rows if r.value is not None}
    assert places == {float(i): (f"{i // 30}.json", i % 30) for i in range(90)}
    rejects = [r for r in rows if r.reason is not None]
    assert len(rejects) == 13 and all("OBSERVABILITY" in r.raw for r in rejects)
    assert all(r.raw is None for r in rows if r.reason is None)


def test_batch_of_many_days(spark, tmp_path):
    """Each day is looked up, and nothing else is read."""
    tables = Tables(spark, str(tmp_path))
    start = dt.datetime(2020, 1, 1)
    days = [envelope("SPC", spc(created_at=(start + dt.timedelta(days=d)).isoformat())) for d in range(0, 1000, 2)]
    streams.ingest(tables, batch(spark, *days), "one")
    streams.ingest(tables, batch(spark, *days, envelope("SPC", spc())), "two")
    assert tables.read("drift").count() == 501
    values = msg.spc_records(msg.parse_records(batch(spark, *days)))
    found = streams.on_days_of(tables.read("drift"), values)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()


def test_insert_twice(spark):
    t = dt.datetime(2024, 6, 26, tzinfo=dt.timezone.utc)
    rows = [(t, "n", "r", "v", "f", 1.0)] * 2 + [(t, "n", "r", "v", "f", None)] * 2 + [(t, None, "r", "v", "f", 2.0)]
    incoming = spark.createDataFrame(rows, DRIFT)
    once = insert_ignore(incoming.limit(0), incoming)
    assert once.count() == 4
    assert insert_ignore(once, incoming).count() == 7


def test_replayed_batch_replaces_itself(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    messages = batch(spark, envelope("SPC", spc(), spc(), spc("f", None)), envelope("OBSERVABILITY", route()), "{")
    for _ in range(2):
        streams.ingest(tables, messages, "http-7")
    assert tables.read("drift").count() == 2
    assert tables.read("observability").count() == 1
    assert tables.read("rejects").count() == 1
    # Another batch with the same content adds only what has no complete key.
    streams.ingest(tables, messages, "http-8")
    assert tables.read("drift").count() == 3
    assert tables.read("observability").count() == 2  # handed over without saying where from
    days = [r.event_date for r in tables.read("drift").select("event_date").distinct().collect()]
    assert days == [dt.date(2024, 6, 26)]


def test_stream_in_small_batches_equals_one_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(4):
        lines = [envelope("SPC", spc(f"feature{j}", float(j % 3))) for j in range(i, i + 5)]
        file = source / f"{i}.json"
        file.write_text("\n".join(lines + [envelope("OBSERVABILITY", route()), "{bad"]))
        # Files are taken in the order of their times, which must not coincide.
        os.utime(file, (1_700_000_000 + i,) * 2)
    tables = Tables(spark, str(tmp_path / "tables"))
    for _ in range(2):  # the second run finds nothing new
        stream = msg.file_stream(spark, str(source), max_files=1)
        streams.start_ingest(stream, tables, str(tmp_path / "checkpoint")).awaitTermination()
    assert tables.read("drift").select("ingest_batch").distinct().count() == 4
    assert sorted(r.feature for r in tables.read("drift").collect()) == [f"feature{j}" for j in range(8)]
    assert tables.read("observability").count() == 4 and tables.read("rejects").count() == 4


def test_kafka_options():
    plain = msg.kafka_options("b:9092", ["t"])
    assert plain["kafka.bootstrap.servers"] == "b:9092" and plain["subscribe"] == "t"
    assert not any("sasl" in k for k in plain)
    secure = msg.kafka_options("b", ["t", "u"], "g", "me", 'p"w', overrides={"maxOffsetsPerTrigger": "5"})
    assert secure["subscribe"] == "t,u" and secure["kafka.group.id"] == "g"
    assert 'password="p\\"w"' in secure["kafka.sasl.jaas.config"]
    assert secure["kafka.security.protocol"] == "SASL_SSL" and secure["maxOffsetsPerTrigger"] == "5"


def test_days_are_pruned(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    now = dt.datetime(2024, 6, 26, 12, tzinfo=dt.timezone.utc)
    rows = [(now - dt.timedelta(days=d), "n", "r", "v", "f", float(d)) for d in range(12)]
    tables.write_batch("drift", spark.createDataFrame(rows, DRIFT), "x")
    found = tbl.scan_since(tables.read("drift"), now - dt.timedelta(days=2))
    assert found.count() == 2
    assert len(found.inputFiles()) >= 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    kept = tbl.apply_retention(tables.read("drift"), tbl.RETENTION_DAYS["drift"], now)
    assert kept.count() == 8
    assert tbl.expired_days(tables.read("drift"), 7, now).count() == 4


def test_profile_snapshots(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    assert tables.read("profiles").count() == 0
    one = tables.read("profiles").drop("snapshot").unionByName(
        spark.range(1).select(F.lit("a").alias("name")), allowMissingColumns=True
    )
    tables.write_profiles(one)
    tables.write_profiles(tables.read("profiles").withColumn("name", F.lit("b")))
    assert [r.name for r in tables.read("profiles").collect()] == ["b"]
