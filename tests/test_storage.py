"""Stored tables under crashes, replays and writers that race."""

import datetime as dt
import json
import threading

import pytest
from pyspark.sql import functions as F

from driftwatch.plans.service import Monitor, service_key
from driftwatch.schemas import DRIFT
from driftwatch.session import shared_dir
from driftwatch.sources import messages as msg
from driftwatch.sources import storage
from driftwatch.sources.tables import Tables
from driftwatch.streaming import ingest as streams
from test_drift_check import DAY, NOW, document
from test_ingest import envelope, route, spc

DAYS = [dt.datetime(2024, 6, d, 12, tzinfo=dt.timezone.utc) for d in (1, 2)]


def values(spark, *numbers, days=DAYS):
    return spark.createDataFrame([(day, "n", "r", "v", "f", float(x)) for day in days for x in numbers], DRIFT)


def together(*work):
    """Runs functions at once; raises what one of them raised."""
    failed = []

    def guarded(f):
        try:
            f()
        except BaseException as error:
            failed.append(error)

    threads = [threading.Thread(target=guarded, args=(f,)) for f in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if failed:
        raise failed[0]


def test_one_writer_takes_a_name(spark, tmp_path):
    got = []
    together(*[lambda k=k: got.append((storage.commit(spark, f"{tmp_path}/log/1", str(k)), k)) for k in range(8)])
    winners = [k for ok, k in got if ok]
    assert len(winners) == 1 and storage.read_text(spark, f"{tmp_path}/log/1") == str(winners[0])
    assert storage.files(spark, f"{tmp_path}/log") == ["1"]


# Numbers given out once


def test_alert_ids_are_given_once(spark, tmp_path):
    monitor = Monitor(spark, str(tmp_path))
    app = service_key("r", "n", "v")
    for day in (30, 20, 31):
        monitor.insert_alert(app, "f", {"zone": "Zone 4"}, dt.datetime(2024, 1, day))
    assert sorted(r.id for r in monitor.alerts(None).collect()) == [1, 2, 3]
    monitor.drop_expired(now=dt.datetime(2024, 9, 1))
    assert monitor.alerts(None).count() == 0
    monitor.insert_alert(app, "f", {"zone": "Zone 4"}, dt.datetime(2024, 1, 1))
    assert [r.id for r in monitor.alerts(None).collect()] == [4]


def test_ids_of_racing_writers_do_not_meet(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    got = []

    def take(n):
        last = tables.reserve_alert_ids(n)
        got.extend(range(last + 1, last + n + 1))

    together(*[lambda n=n: take(n) for n in (1, 2, 3, 4, 5)])
    assert sorted(got) == list(range(1, 16))
    for _ in range(30):
        tables.reserve_alert_ids(1)
    assert tables.reserve_alert_ids(0) == 45
    assert len(storage.files(spark, f"{tmp_path}/alerts/_log")) <= 11


def test_a_number_that_was_cleaned_up_is_not_taken_again(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    log = f"{tmp_path}/alerts/_log"
    assert tables._take(log, 15, "x")
    assert not tables._take(log, 3, "late") and storage.files(spark, log) == [f"{15:020d}"]


def test_a_log_of_an_earlier_version_is_counted_on(spark, tmp_path):
    monitor = Monitor(spark, str(tmp_path))
    monitor.insert_alert(service_key("r", "n", "v"), "f", {"zone": "Zone 1"}, NOW)
    storage.delete(spark, f"{tmp_path}/alerts/_log")
    assert monitor.tables.reserve_alert_ids(1) == 1


# Profiles


def named(spark, name):
    return spark.range(1).select(F.lit(name).alias("name"))


def test_a_writer_that_died_is_stepped_over(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    add = lambda name: lambda table: table.unionByName(named(spark, name), allowMissingColumns=True)
    tables.change_profiles(add("a"))
    named(spark, "half").write.parquet(f"{tmp_path}/profiles/data-dead")  # never entered into the log
    tables.change_profiles(add("b"))
    assert sorted(r.name for r in tables.read("profiles").collect()) == ["a", "b"]
    tables.drop_snapshots(keep=1)
    left = [f for f in storage.folders(spark, f"{tmp_path}/profiles") if f.startswith("data-")]
    assert len(left) == 2 and "data-dead" in left  # a writer may still be at work there
    assert sorted(r.name for r in tables.read("profiles").collect()) == ["a", "b"]


def test_changes_of_racing_writers_all_count(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    add = lambda name: lambda table: table.unionByName(named(spark, name), allowMissingColumns=True)
    together(*[lambda n=n: tables.change_profiles(add(n)) for n in "abcd"])
    assert sorted(r.name for r in tables.read("profiles").collect()) == list("abcd")
    assert tables.read("profiles").first().snapshot == 4


# Merged batches


def stored(tables):
    return sorted((r.created_at.day, r.value) for r in tables.read("drift").collect())


def three_batches(spark, root):
    tables = Tables(spark, str(root))
    for k, name in enumerate(("http:1", "b", "c")):
        tables.write_batch("drift", values(spark, k, k + 10), name)
    return tables, sorted((d, float(x)) for d in (1, 2) for x in (0, 10, 1, 11, 2, 12))


def batches(spark, root, day="2024-06-01"):
    return storage.folders(spark, f"{root}/drift/event_date={day}")


def test_batches_of_a_day_become_one(spark, tmp_path):
    tables, want = three_batches(spark, tmp_path)
    assert tables.merge_days("drift", "2024-06-02") == ["2024-06-01"]
    assert len(batches(spark, tmp_path)) == 1 and len(batches(spark, tmp_path, "2024-06-02")) == 3
    assert len(storage.matching(spark, f"{tmp_path}/drift/event_date=2024-06-01/*/*.parquet")) == 1
    assert stored(tables) == want
    # A batch that is stored again is known, on all its days.
    tables.write_batch("drift", values(spark, 1, 11), "b")
    assert stored(tables) == want and tables.batch_state("drift", "b") == "merged"
    # Later batches come beside the merged one and are merged with it in turn.
    tables.write_batch("drift", values(spark, 5, days=DAYS[:1]), "d")
    assert tables.merge_days("drift", "2024-06-03") == ["2024-06-01", "2024-06-02"]
    assert len(batches(spark, tmp_path)) == 1 and stored(tables) == sorted([*want, (1, 5.0)])
    assert tables.merge_days("drift", "2024-06-03") == []


def test_half_written_batches_are_not_merged(spark, tmp_path):
    tables, want = three_batches(spark, tmp_path)
    storage.write_text(spark, tables._mark("drift", "c"), "begun")
    assert tables.merge_days("drift", "2024-06-02") == ["2024-06-01"]
    assert sorted(b.split("-")[0] for b in batches(spark, tmp_path)) == ["ingest_batch=c", "ingest_batch=merged"]
    tables.write_batch("drift", values(spark, 2, 12), "c")
    assert stored(tables) == want


@pytest.mark.parametrize("step", ["written", "decided", "moved", "half removed"])
def test_a_crash_half_way_shows_each_row_once(spark, tmp_path, monkeypatch, step):
    tables, want = three_batches(spark, tmp_path)

    class Crash(Exception):
        pass

    def crash(*_):
        raise Crash

    with monkeypatch.context() as m:
        if step == "written":
            m.setattr(storage, "commit", crash)
        if step == "decided":
            m.setattr(storage, "move", crash)
        if step in ("moved", "half removed"):
            delete, calls = storage.delete, []

            def some(spark, path):
                calls.append(path)
                if len(calls) > (step == "half removed"):
                    raise Crash
                delete(spark, path)

            m.setattr(storage, "delete", some)
        with pytest.raises(Crash):
            tables.merge_day("drift", "2024-06-01")
    assert stored(Tables(spark, str(tmp_path))) == want
    tables.merge_day("drift", "2024-06-01")
    assert stored(tables) == want and sum("ingest_batch" in b for b in batches(spark, tmp_path)) == 1


def test_a_merge_that_came_too_late_is_void(spark, tmp_path):
    tables, want = three_batches(spark, tmp_path)
    names = batches(spark, tmp_path)
    tables.merge_day("drift", "2024-06-01")
    folder = f"{tmp_path}/drift/event_date=2024-06-01"
    values(spark, 0, 10, 1, 11, 2, 12, days=DAYS[:1]).write.parquet(f"{folder}/_merge-late")
    plan = {"day": "2024-06-01", "hidden": "_merge-late", "names": names}
    storage.commit(spark, f"{tmp_path}/drift/_merges/2024-06-01", json.dumps(plan))
    assert stored(tables) == want and not storage.exists(spark, f"{folder}/_merge-late")


def test_racing_merges(spark, tmp_path):
    tables, want = three_batches(spark, tmp_path)
    together(*[lambda: tables.merge_day("drift", "2024-06-01")] * 3)
    assert stored(tables) == want and sum("ingest_batch" in b for b in batches(spark, tmp_path)) == 1


def test_the_key_stays_unique_across_merges(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    line = envelope("SPC", spc(value=1.0), spc(value=2.0))
    post = lambda name: streams.ingest(tables, spark.createDataFrame([(line,)], "value string"), name)
    post("one")
    post("two")
    tables.merge_days("drift", "2100-01-01", least=1)
    post("three")
    assert sorted(r.value for r in tables.read("drift").collect()) == [1.0, 2.0]


# Where records come from


def test_lines_keep_their_numbers_however_files_are_split(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name in "ab":
        (source / f"{name}.json").write_text("".join(f"{name}{k}{'x' * (k % 50)}\n" for k in range(400)))
    want = {(f"{n}.json", k, f"{n}{k}{'x' * (k % 50)}") for n in "ab" for k in range(400)}
    for size in ("1g", "1000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = msg.number_lines(msg.file_batch(spark, str(source))).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert {(r.file.rsplit("/", 1)[1], r.line, r.value) for r in rows} == want


def test_the_same_messages_in_another_batch(spark, tmp_path):
    """Equal messages at different offsets are different ones; the same offset again is not."""
    monitor = Monitor(spark, str(tmp_path))
    texts = [envelope("OBSERVABILITY", route(), route()), envelope("OBSERVABILITY", route()), envelope("SPC", spc("f", None)), "{bad"]
    rows = [(t, NOW, "topic", k % 2, k) for k, t in enumerate(texts)]
    schema = "value string, timestamp timestamp, topic string, partition int, offset long"
    kafka = spark.createDataFrame(rows, schema)
    for name in ("b1", "b2"):
        monitor.post_records(kafka, name)
    counts = lambda: [monitor.tables.read(t).count() for t in ("observability", "drift", "rejects")]
    assert counts() == [3, 1, 1]
    one = monitor.tables.read("observability").orderBy("source_position", "record").collect()
    assert [(r.source, r.source_part, r.source_position, r.record) for r in one] == [("topic", 0, 0, 0), ("topic", 0, 0, 1), ("topic", 1, 1, 0)]
    later = spark.createDataFrame([(texts[0], NOW, "topic", 0, 9)], schema)
    monitor.post_records(later.unionByName(kafka), "b3")
    assert counts() == [5, 1, 1]
    monitor.tables.merge_days("observability", "2100-01-01", least=1)
    monitor.post_records(kafka, "b4")
    assert counts() == [5, 1, 1]


# What a run leaves behind


def test_runs_leave_no_folder_and_rejects_expire(spark, tmp_path):
    monitor = Monitor(spark, str(tmp_path / "tables"))
    folders = lambda: {f for f in storage.folders(spark, shared_dir(spark)) if f.startswith("driftwatch-")}
    before = folders()
    monitor.insert_profiles(spark.createDataFrame([(document(), "SPC")], "profile string, drift_type string"), now=NOW - 2 * DAY)
    on = spark.createDataFrame([("repo_a", "test_app", "0.1.0", True)], "repository string, name string, version string, active boolean")
    monitor.set_profile_status(on)
    monitor.post_records(spark.createDataFrame([("{bad", NOW)], "value string, timestamp timestamp"), "x")
    errors = monitor.run_due_checks(now=NOW)
    assert folders() == before and errors.columns == ["repository", "name", "version", "reason"]
    assert errors.count() == monitor.tables.read("errors").count()
    assert monitor.tables.read("rejects").count() == 1
    monitor.drop_expired(now=NOW + 14 * DAY)
    assert monitor.tables.read("rejects").count() == 1
    monitor.drop_expired(now=NOW + 40 * DAY)
    assert monitor.tables.read("rejects").count() == 0 and monitor.tables.read("errors").count() == 0
