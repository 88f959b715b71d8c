"""Changes of stored tables that overlap, repeat or are refused."""

import datetime as dt
import json

from pyspark.sql import functions as F

from driftwatch.operators import profiles as profile_ops
from driftwatch.plans.service import Monitor, service_key
from test_drift_check import DAY, NOW, document
from test_ingest import batch, envelope, route, spc

REQUEST = "profile string, drift_type string"
KEYED = "repository string, name string, version string, "
APP = service_key("repo_a", "test_app", "0.1.0")


def test_changes_made_during_a_check_survive(spark, tmp_path):
    monitor = Monitor(spark, str(tmp_path))
    monitor.insert_profiles(
        spark.createDataFrame([(document(), "SPC"), (document("other"), "SPC")], REQUEST), now=NOW - 2 * DAY
    )
    on = spark.createDataFrame([(*APP.values(), True)], KEYED + "active boolean")
    off = spark.createDataFrame([("other", "test_app", "0.1.0", True)], KEYED + "active boolean")
    monitor.set_profile_status(on)
    store = monitor.tables.append_alerts

    def meanwhile(alerts):
        store(alerts)
        monitor.set_profile_status(off)
        monitor.update_profiles(
            spark.createDataFrame([(*APP.values(), document(rule="changed"), "SPC")], KEYED + REQUEST), now=NOW
        )
        monitor.insert_profiles(spark.createDataFrame([(document("third"), "SPC")], REQUEST), now=NOW)

    monitor.tables.append_alerts = meanwhile
    monitor.run_due_checks(now=NOW)
    rows = {r.repository: r for r in monitor.tables.read("profiles").collect()}
    assert set(rows) == {"repo_a", "other", "third"} and rows["other"].active
    assert '"changed"' in rows["repo_a"].profile
    assert rows["repo_a"].next_run.replace(tzinfo=None) > NOW.replace(tzinfo=None)
    monitor.tables.drop_snapshots(keep=1)
    assert monitor.tables.read("profiles").count() == 3


def test_writers_that_take_the_same_number(spark, tmp_path):
    tables = Monitor(spark, str(tmp_path)).tables
    one = lambda name: tables.read("profiles").drop("snapshot").unionByName(
        spark.range(1).select(F.lit(name).alias("name")), allowMissingColumns=True
    )
    calls = []

    def change(table):
        calls.append(1)
        if len(calls) == 1:
            tables.write_profiles(one("first"))
        return table.unionByName(spark.range(1).select(F.lit("second").alias("name")), allowMissingColumns=True)

    tables.change_profiles(change)
    assert len(calls) == 2
    assert {r.name for r in tables.read("profiles").collect()} == {"first", "second"}


def test_refused_profiles(spark):
    never = json.loads(document("never"))
    never["config"]["alert_config"]["schedule"] = "never"
    requests = spark.createDataFrame(
        [(document(), "SPC"), ("{", "SPC"), ("{}", "SPC"), (json.dumps(never), "SPC"), (None, "SPC")], REQUEST
    )
    refused = {(r.profile, r.reason) for r in profile_ops.profile_rejects(requests, NOW).collect()}
    assert refused == {
        ("{", profile_ops.UNREADABLE_PROFILE),
        ("{}", profile_ops.UNREADABLE_PROFILE),
        (None, profile_ops.UNREADABLE_PROFILE),
        (json.dumps(never), profile_ops.UNREADABLE_SCHEDULE),
    }
    empty = Monitor(spark, "/nowhere").tables.read("profiles").drop("snapshot")
    assert [r.repository for r in profile_ops.insert_profiles(empty, requests, NOW).collect()] == ["repo_a"]


def test_version_comes_from_the_named_field(spark):
    doc = json.loads(document()) | {"schema_version": 9, "client_version": "0.3"}
    requests = spark.createDataFrame([(json.dumps(doc), "SPC")], REQUEST)
    empty = Monitor(spark, "/nowhere").tables.read("profiles").drop("snapshot")
    assert profile_ops.insert_profiles(empty, requests, NOW).first().client_version == "0.3"
    named = profile_ops.insert_profiles(empty, requests, NOW, version_field="schema_version")
    assert named.first().client_version == "9"


def test_repeated_batch_leaves_no_stale_days(spark, tmp_path):
    monitor = Monitor(spark, str(tmp_path))
    messages = batch(spark, envelope("OBSERVABILITY", route()), envelope("SPC", spc()))
    for day in (1, 2):
        monitor.post_records(messages, "http-1", received_at=dt.datetime(2024, 7, day))
    assert [str(r.event_date) for r in monitor.tables.read("observability").collect()] == ["2024-07-02"]
    monitor.post_records(batch(spark, envelope("OBSERVABILITY", route())), "http-1")
    assert monitor.tables.read("drift").count() == 0
    monitor.drop_expired(now=dt.datetime(2024, 8, 1))
    assert monitor.tables.read("observability").count() == 0


def test_alerts_raised_by_the_caller(spark, tmp_path):
    monitor = Monitor(spark, str(tmp_path))
    for k in range(3):
        monitor.insert_alert(APP, "f", {"zone": "Zone 4", "kind": "Consecutive"}, NOW + k * DAY)
    assert [(r.id, r.alert["zone"]) for r in monitor.alerts(APP, limit=2).collect()] == [(3, "Zone 4"), (2, "Zone 4")]


def test_documents_are_pinned_in_files_of_bounded_rows(spark, monkeypatch):
    """A task that reads them sorts documents, which are far wider in memory than as Parquet."""
    pins, real = [], profile_ops.pin
    monkeypatch.setattr(profile_ops, "ROWS_PER_FILE", 5)
    monkeypatch.setattr(profile_ops, "pin", lambda df, **how: pins.append(real(df, **how)) or pins[-1])
    requests = spark.createDataFrame([(document(f"model_{k % 7}"), "SPC") for k in range(40)], REQUEST).coalesce(1)
    empty = Monitor(spark, "/nowhere").tables.read("profiles").drop("snapshot")
    assert profile_ops.insert_profiles(empty, requests, NOW).count() == 7
    documents = [p for p in pins if "profile" in p.columns][0]
    files = documents.groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == 40 and max(r["count"] for r in files) <= 5
