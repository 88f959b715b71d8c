"""A client's day, end to end over stored tables."""

import datetime as dt
import json

from driftwatch.plans.service import Monitor, service_key
from test_drift_check import DAY, NOW, document
from test_ingest import envelope, route

APP = service_key("repo_a", "test_app", "0.1.0")


def test_end_to_end(spark, tmp_path):
    monitor = Monitor(spark, str(tmp_path))
    created = NOW - 2 * DAY
    monitor.insert_profiles(
        spark.createDataFrame([(document(), "SPC")], "profile string, drift_type string"), now=created
    )
    assert monitor.profile(APP).count() == 1
    assert monitor.profile(service_key("a", "b", "c")).count() == 0
    monitor.run_due_checks(now=NOW)
    assert monitor.alerts(APP).count() == 0  # inactive

    def record(feature, second, value):
        at = (NOW - DAY / 2 + dt.timedelta(seconds=second)).replace(tzinfo=None).isoformat()
        return {"SPC": {"record": {"created_at": at, "name": "test_app", "repository": "repo_a",
                                   "version": "0.1.0", "feature": feature, "value": value}}}

    texts = [
        envelope("SPC", *[record(f, i, v) for f, v in (("col_1", -3.5), ("col_2", 0.0), ("col_3", 2.5))])
        for i in range(10)
    ] + [envelope("OBSERVABILITY", route())] * 3
    messages = spark.createDataFrame([(t, NOW) for t in texts], "value string, timestamp timestamp")
    for _ in range(2):
        monitor.post_records(messages, "http-1")

    assert monitor.drift(APP, "24hour", 1000, now=NOW).count() == 3
    assert monitor.drift(None, "5minute", 1000, now=NOW).count() == 0
    seen = monitor.observability(service_key("test_repo", "test_app", "1.0.0"), "1hour", 10, now=NOW).collect()
    assert [(r.route_name, r.total_request_count) for r in seen] == [("test_route", [30])]

    status = spark.createDataFrame([(*APP.values(), True)], "repository string, name string, version string, active boolean")
    monitor.set_profile_status(status)
    errors = monitor.run_due_checks(now=NOW)
    assert errors.count() == 0
    found = monitor.alerts(APP, active=True, limit_timestamp=NOW).collect()
    assert sorted((r.feature, r.alert["zone"]) for r in found) == [("col_1", "Zone 1"), ("col_3", "Zone 4")]
    monitor.run_due_checks(now=NOW)  # no longer due
    assert monitor.alerts(None).count() == 2

    changed = document(rule="test")
    monitor.update_profiles(
        spark.createDataFrame([(*APP.values(), changed, "SPC")],
                              "repository string, name string, version string, profile string, drift_type string")
    )
    assert json.loads(monitor.profile(APP).first().profile)["config"]["alert_config"]["rule"]["rule"] == "test"
    errors = monitor.run_due_checks(now=NOW + 2 * DAY)
    assert [r.reason for r in errors.collect()] == ["malformed rule"]
    assert monitor.expired_days("drift", now=NOW + 30 * DAY).count() >= 1
