import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from driftwatch.operators import alerts as alert_log
from driftwatch.operators import profiles as profile_ops
from driftwatch.plans import drift_check
from driftwatch.schemas import ALERT, DRIFT, PROFILE, SERVICE

NOW = dt.datetime(2024, 6, 26, 20, 43, 27, tzinfo=dt.timezone.utc)
DAY = dt.timedelta(days=1)

# Control limits of the fixture's two monitored features.
LIMITS = {
    "col_1": {
        "center": -3.997113080300062,
        "one_ucl": -1.9742384896265417,
        "one_lcl": -6.019987670973582,
        "two_ucl": 0.048636101046978464,
        "two_lcl": -8.042862261647102,
        "three_ucl": 2.071510691720498,
        "three_lcl": -10.065736852320622,
    },
    "col_3": {
        "center": -3.937652409303277,
        "one_ucl": -2.0275656995100224,
        "one_lcl": -5.8477391190965315,
        "two_ucl": -0.1174789897167674,
        "two_lcl": -7.757825828889787,
        "three_ucl": 1.7926077200764872,
        "three_lcl": -9.66791253868304,
    },
}


def document(repository="repo_a", rule="4 4 4 8 2 4 1 1", monitored=("col_1", "col_3"), features=LIMITS, **extra):
    return json.dumps(
        {
            "features": {k: {"id": k, **v} for k, v in features.items()},
            "config": {
                "sample_size": 25,
                "sample": True,
                "name": "test_app",
                "repository": repository,
                "version": "0.1.0",
                "alert_config": {
                    "dispatch_type": "Console",
                    "schedule": "0 0 0 * * *",
                    "rule": {"rule": rule, "zones_to_monitor": ["Zone 1", "Zone 2", "Zone 3", "Zone 4"]},
                    "features_to_monitor": list(monitored),
                    "dispatch_kwargs": {},
                },
                "feature_map": None,
                "targets": [],
                "drift_type": "SPC",
            },
            "tool_version": "0.1.0",
            **extra,
        }
    )


def profile(repository="repo_a", doc=None, active=True, drift_type="SPC", schedule="0 0 0 * * *"):
    return (
        NOW, NOW, "test_app", repository, "0.1.0", doc or document(repository), active, schedule,
        NOW - DAY, NOW - 2 * DAY, "0.1.0", drift_type,
    )


def profiles(spark, *rows):
    return spark.createDataFrame(list(rows), PROFILE)


def values(spark, repository="repo_a", features=("col_1", "col_3"), start=NOW - DAY):
    level = {"col_1": -3.5, "col_2": -3.5, "col_3": 2.5}
    rows = [
        (start + dt.timedelta(seconds=i), "test_app", repository, "0.1.0", f, level[f])
        for f in features
        for i in range(10)
    ]
    return spark.createDataFrame(rows, DRIFT)


def no_alerts(spark):
    return spark.createDataFrame([], ALERT)


def keys(df):
    return sorted((r.repository, r.feature, r.alert["zone"], r.alert["kind"]) for r in df.collect())


TWO_ALERTS = [
    ("repo_a", "col_1", "Zone 1", "Consecutive"),
    ("repo_a", "col_3", "Zone 4", "Consecutive"),
]


def test_two_alerts(spark):
    table = profiles(spark, profile(), profile("repo_b", active=False))
    drift = values(spark, features=("col_1", "col_2", "col_3"))
    result = drift_check.run_due_checks(table, drift, no_alerts(spark), NOW)
    assert keys(result.alerts) == TWO_ALERTS
    rows = result.alerts.collect()
    assert sorted(r.id for r in rows) == [1, 2]
    assert all(r.status == "active" and r.alert["feature"] == r.feature for r in rows)
    after = {r.repository: r for r in result.profiles.collect()}
    assert after["repo_a"].previous_run == (NOW - DAY).replace(tzinfo=None)
    assert after["repo_a"].next_run == dt.datetime(2024, 6, 27)
    assert after["repo_b"].previous_run == (NOW - 2 * DAY).replace(tzinfo=None)
    assert result.errors.count() == 0


def test_all_values_at_one_instant(spark):
    drift = values(spark).withColumn("created_at", F.lit(NOW - DAY))
    found, _ = drift_check.check_drift(drift, profiles(spark, profile()))
    assert sorted((r.feature, r.zone) for r in found.collect()) == [("col_1", "Zone 1"), ("col_3", "Zone 4")]


def test_repeating_a_run_adds_nothing(spark):
    table, drift = profiles(spark, profile()), values(spark)
    first = drift_check.run_due_checks(table, drift, no_alerts(spark), NOW).alerts
    again = drift_check.run_due_checks(table, drift, first, NOW + dt.timedelta(hours=1)).alerts
    assert first.count() == 2 and again.count() == 0


def test_a_bad_profile_does_not_stop_the_others(spark):
    table = profiles(
        spark,
        profile(),
        profile("rule", document("rule", rule="test")),
        profile("type", drift_type="OTHER"),
        profile("text", "not json"),
        profile("limits", document("limits", features={"col_1": {"center": 1.0}})),
        profile("cron", schedule="never"),
    )
    drift = values(spark)
    for other in ("rule", "type", "limits", "cron"):
        drift = drift.unionByName(values(spark, other))
    result = drift_check.run_due_checks(table, drift, no_alerts(spark), NOW)
    assert keys(result.alerts.where("repository <> 'cron'")) == TWO_ALERTS
    assert {(r.repository, r.reason) for r in result.errors.collect()} == {
        ("rule", "malformed rule"),
        ("type", "unknown drift type"),
        ("text", "unreadable profile"),
        ("limits", "incomplete limits"),
        ("cron", "unreadable schedule"),
    }
    # Failed checks move on to their next run as well, unless there is none.
    moved = {r.repository for r in result.profiles.where("next_run > previous_run + interval 1 day").collect()}
    assert moved == {"repo_a", "rule", "type", "text", "limits"}


def test_data_key_differs_from_table_key(spark):
    """Values are looked up by the key in the document, alerts stored under that of the table."""
    table = profiles(spark, profile("renamed", document("repo_a")))
    result = drift_check.run_due_checks(table, values(spark), no_alerts(spark), NOW)
    assert {r.repository for r in result.alerts.collect()} == {"renamed"}


@pytest.mark.parametrize("strict", [False, True])
def test_feature_without_new_values(spark, strict):
    drift = values(spark, features=["col_3"]).unionByName(
        values(spark, features=["col_1"], start=NOW - 9 * DAY)
    )
    found, errors = drift_check.check_drift(drift, profiles(spark, profile()), strict=strict)
    assert [r.feature for r in found.collect()] == ([] if strict else ["col_3"])
    assert [r.reason for r in errors.collect()] == ["no new values: col_1"]


def test_nothing_to_check(spark):
    found, errors = drift_check.check_drift(values(spark).limit(0), profiles(spark, profile()))
    assert found.count() == 0 and errors.count() == 0


def test_profiles_too_large_to_broadcast(spark):
    table, drift = profiles(spark, profile()), values(spark)
    found, _ = drift_check.check_drift(drift, table, limit_bytes=0)
    assert sorted((r.feature, r.zone) for r in found.collect()) == [("col_1", "Zone 1"), ("col_3", "Zone 4")]


def test_insert_update_and_status(spark):
    requests = spark.createDataFrame(
        [(document("new"), "SPC", 2), (document("new", rule="later"), "SPC", 3), (document(), "SPC", 1)],
        "profile string, drift_type string, arrival int",
    )
    table = profile_ops.insert_profiles(profiles(spark, profile()), requests, NOW, arrival="arrival")
    rows = {r.repository: r for r in table.collect()}
    assert set(rows) == {"repo_a", "new"}
    new = rows["new"]
    assert not new.active and new.next_run == new.previous_run == dt.datetime(2024, 6, 27)
    assert new.client_version == "0.1.0" and '"4 4 4 8 2 4 1 1"' in new.profile
    assert table.where("repository = 'new'").select("profile").first()[0] == document("new")

    change = spark.createDataFrame(
        [("new", "test_app", "0.1.0", document("new", rule="test"), "SPC"), ("x", "y", "z", "{}", "SPC")],
        "repository string, name string, version string, profile string, drift_type string",
    )
    updated = profile_ops.update_profiles(table, change)
    rows = {r.repository: r for r in updated.collect()}
    assert '"test"' in rows["new"].profile and rows["new"].next_run == new.next_run
    assert updated.count() == 2 and rows["repo_a"].profile == document()

    status = spark.createDataFrame(
        [("new", "test_app", "0.1.0", True)], "repository string, name string, version string, active boolean"
    )
    flipped = profile_ops.set_profile_status(updated, status)
    assert {r.repository: r.active for r in flipped.collect()} == {"new": True, "repo_a": True}
    key = dict(zip(SERVICE, ("nowhere", "test_app", "0.1.0")))
    assert profile_ops.get_profile(flipped, key).count() == 0
    assert profile_ops.get_profile(flipped, {**key, "repository": "new"}).count() == 1


def test_due_is_strict_and_active(spark):
    table = profiles(spark, profile("a"), profile("b", active=False), profile("c", active=None))
    due = lambda now: sorted(r.repository for r in profile_ops.due_profiles(table, now).collect())
    assert due(NOW) == ["a"] and due(NOW - DAY) == []


def test_alert_queries(spark):
    service = {"repository": "test", "name": "test_app", "version": "1.0.0"}
    log = no_alerts(spark)
    for i in range(3):
        log = alert_log.insert_alert(log, service, "test", {"zone_name": "test"}, NOW + dt.timedelta(seconds=i))
    assert log.count() == 3 and sorted(r.id for r in log.collect()) == [1, 2, 3]
    last = NOW + dt.timedelta(seconds=2)
    assert alert_log.query_alerts(log, service, limit_timestamp=last).count() == 1
    assert [r.id for r in alert_log.query_alerts(log, service, active=True, limit=2).collect()] == [3, 2]
    assert alert_log.query_alerts(log, {**service, "version": "2"}).count() == 0
    text = spark.createDataFrame([('{"zone":"Zone 1"}',), ("[",)], "alert string")
    assert [r.alert for r in alert_log.read_alert_maps(text).collect()] == [{"zone": "Zone 1"}, {}]
