"""Queries over the derived monitoring data, in plain long form for comparison.

Each takes a session and the folder of the test tables. Results have scalar columns only, zone-less
UTC timestamps and rounded means.
"""

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.functions.cron import next_runs
from driftwatch.functions.timewin import WINDOW_MINUTES, look_back, window_minutes_column
from driftwatch.operators import alerts as alert_log
from driftwatch.operators import observability as routes
from driftwatch.operators import profiles as profile_ops
from driftwatch.operators import series, spc
from driftwatch.operators.dedupe import insert_ignore
from driftwatch.operators.numbering import number_rows
from driftwatch.plans import drift_check
from driftwatch.schemas import LIMIT_COLUMNS, SERIES, SERVICE
from driftwatch.session import pin, run_dir, use_disk_state, use_utc
from driftwatch.sources import messages as msg
from driftwatch.sources import tables, views
from driftwatch.streaming import ingest as streams
from driftwatch.streaming import rollups

ONE_SERVICE = {"repository": "repo_1", "name": "app", "version": "1.0.0"}
TWO_DAYS_AGO = dt.datetime(2024, 1, 28, tzinfo=dt.timezone.utc)


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Series


def distinct_features(spark, sf_dir):
    return series.distinct_features(views.drift(spark, sf_dir))


def feature_values_since(spark, sf_dir):
    return plain(series.feature_values(views.drift(spark, sf_dir), TWO_DAYS_AGO, ONE_SERVICE, "click"))


def feature_values_positions(spark, sf_dir):
    values = series.feature_values(views.drift(spark, sf_dir), views.BASELINE_END)
    return plain(series.with_positions(values))


def feature_series_chunks(spark, sf_dir):
    """Every element of the arrays, with its place."""
    chunks = series.feature_series(views.drift(spark, sf_dir), chunk_rows=500)
    entries = chunks.select(*SERIES, "chunk", F.posexplode(F.arrays_zip("created_at", "values")).alias("at", "e"))
    return plain(
        entries.select(
            *SERIES, "chunk", F.col("at").cast("bigint").alias("at"), "e.created_at", F.col("e.values").alias("value")
        )
    )


def lineitem_positions(spark, sf_dir):
    """Positions in series whose instants hold thousands of rows; summed up per instant and value."""
    placed = series.with_positions(views.lineitem_drift(spark, sf_dir))
    return plain(
        placed.groupBy(*SERIES, "created_at", "value").agg(
            F.min("position").alias("first"), F.max("position").alias("last"), F.count(F.lit(1)).alias("n")
        )
    )


def drift_records_truncated(spark, sf_dir):
    return plain(series.drift_records(views.drift(spark, sf_dir), views.BASELINE_END))


def drift_records_monitored(spark, sf_dir):
    return plain(
        series.drift_records(
            views.drift(spark, sf_dir), TWO_DAYS_AGO, ONE_SERVICE, ["click", "error", "view"]
        )
    )


def lineitem_records_truncated(spark, sf_dir):
    """Cut series whose instants hold many equal and unequal values; summed up per instant."""
    cut = series.truncated_values(views.lineitem_drift(spark, sf_dir))
    return plain(
        cut.groupBy(*SERIES, "created_at").agg(
            F.count(F.lit(1)).alias("n"),
            F.min("value").alias("smallest"),
            F.round(F.sum("value"), 2).alias("total"),
        )
    )


def binned_feature_values(spark, sf_dir):
    binned = series.binned_drift(
        views.drift(spark, sf_dir), "24hour", 7, now=views.NOW, service=ONE_SERVICE, feature="click"
    )
    return plain(_rounded(binned, "value"))


def binned_drift_records(spark, sf_dir):
    binned = series.binned_drift(views.drift(spark, sf_dir), "5day", 1000, now=views.NOW)
    return plain(_rounded(binned, "value"))


def binned_fractional(spark, sf_dir):
    """Bins of 300 milliseconds."""
    binned = series.binned_drift(views.drift(spark, sf_dir), "5minute", 1000, now=TWO_DAYS_AGO)
    return plain(_rounded(binned, "value"))


def binned_feature_series(spark, sf_dir):
    arrays = series.binned_drift_series(views.drift(spark, sf_dir), "5day", 60, now=views.NOW)
    return plain(
        arrays.select(
            *SERIES, "chunk", F.posexplode(F.arrays_zip("created_at", "values")).alias("at", "e")
        ).select(
            *SERIES,
            "chunk",
            F.col("at").cast("bigint").alias("at"),
            "e.created_at",
            F.round("e.values", 6).alias("value"),
        )
    )


def lineitem_binned(spark, sf_dir):
    day_us = 86_400_000_000
    binned = series.binned_means(
        views.lineitem_drift(spark, sf_dir), 30 * day_us, minutes=10 * 365 * 1440, now="1999-01-01"
    )
    return plain(_rounded(binned, "value"))


def window_coverage(spark, sf_dir):
    """Rows each named window looks back on, with an unknown name falling back."""
    drift = views.drift(spark, sf_dir)
    names = [*WINDOW_MINUTES, "fortnight"]
    counts = drift.agg(
        *[
            F.count_if(look_back("created_at", WINDOW_MINUTES.get(n, 360), views.NOW)).alias(n)
            for n in names
        ]
    )
    entries = F.array(*[F.struct(F.lit(n).alias("time_window"), F.col(f"`{n}`").alias("n")) for n in names])
    return (
        counts.select(F.explode(entries).alias("e"))
        .select("e.*")
        .withColumn("minutes", window_minutes_column(F.col("time_window")))
    )


# Observability


def observability_binned(spark, sf_dir):
    bins = routes.binned_routes(views.observability(spark, sf_dir), "5day", 120, now=views.NOW)
    return plain(
        _rounded(bins.drop("status_counts"), "p5", "p25", "p50", "p95", "p99", "error_latency")
    )


def observability_status_counts(spark, sf_dir):
    bins = routes.binned_routes(views.observability(spark, sf_dir), "5day", 120, now=views.NOW)
    return plain(
        bins.select(*SERVICE, "route_name", "created_at", F.explode("status_counts").alias("s")).select(
            *SERVICE, "route_name", "created_at", "s.status", "s.count"
        )
    )


def observability_series(spark, sf_dir):
    arrays = routes.binned_routes_series(views.observability(spark, sf_dir), "24hour", 10, now=views.NOW)
    columns = ["created_at", "p50", "total_request_count", "status_counts"]
    return plain(
        arrays.select(
            *SERVICE, "route_name", "chunk", F.posexplode(F.arrays_zip(*columns)).alias("at", "e")
        ).select(
            *SERVICE,
            "route_name",
            "chunk",
            F.col("at").cast("bigint").alias("at"),
            "e.created_at",
            F.round("e.p50", 6).alias("p50"),
            "e.total_request_count",
            F.coalesce(F.try_element_at("e.status_counts", F.lit("200")), F.lit(0)).alias("count_200"),
        )
    )


def request_counts(spark, sf_dir):
    return (
        routes.request_rollup(views.request_log(spark, sf_dir))
        .select("method", "path", "status", "requests", F.round("latency_sum", 4).alias("latency_sum"))
    )


def request_histogram(spark, sf_dir):
    return routes.request_histogram(views.request_log(spark, sf_dir)).select(
        "method", "path", "status", "le", "bucket_count"
    )


# Profiles and schedules


def profile_limits(spark, sf_dir):
    settings = profile_ops.profile_settings(views.service_profiles(spark, sf_dir))
    return _rounded(
        profile_ops.monitored_limits(settings).select(*SERVICE, "feature", *LIMIT_COLUMNS), *LIMIT_COLUMNS
    )


def profile_errors(spark, sf_dir):
    profiles = views.user_profiles(views.events(spark, sf_dir))
    return profile_ops.profile_errors(profile_ops.profile_settings(profiles))


def get_profile(spark, sf_dir):
    found = profile_ops.get_profile(
        views.service_profiles(spark, sf_dir), ONE_SERVICE
    )
    doc = "profile"
    return found.select(
        *SERVICE,
        F.get_json_object(doc, "$.config.alert_config.rule.rule").alias("rule"),
        F.round(F.get_json_object(doc, "$.features.click.center").cast("double"), 6).alias("click_center"),
    )


def due_profiles(spark, sf_dir):
    due = profile_ops.due_profiles(views.user_profiles(views.events(spark, sf_dir)), views.NOW)
    return plain(due.select(*SERVICE, "schedule", "previous_run", "next_run", "drift_type"))


def cron_next_run(spark, sf_dir):
    """Active users have schedules that come round once in decades."""
    users = views.user_profiles(views.events(spark, sf_dir))
    rare = F.when(F.col("schedule") == "0 0 0 29 2 *", "0 0 0 29 2 MON").when(
        F.col("schedule") == "0 0 12 1 * ?", "0 0 0 1 1 * 2040"
    )
    users = users.withColumn("schedule", F.coalesce(F.when(F.col("active"), rare), "schedule"))
    upcoming = next_runs(users, views.CHECK_TIME)
    joined = users.select(*SERVICE, "schedule").join(upcoming, "schedule")
    return plain(joined.select(*SERVICE, "schedule", "next_run"))


def advance_schedule(spark, sf_dir):
    users = views.user_profiles(views.events(spark, sf_dir))
    after = profile_ops.advance_schedules(users, views.CHECK_TIME)
    return plain(after.select(*SERVICE, "active", "previous_run", "next_run", "updated_at"))


def insert_profiles(spark, sf_dir):
    """Active users have a profile already; all users ask for one with every event."""
    source = views.events(spark, sf_dir)
    stored = views.user_profiles(source).where("active")
    after = profile_ops.insert_profiles(
        stored, views.profile_requests(source), views.CHECK_TIME, arrival="arrival"
    )
    sample_size = F.get_json_object("profile", "$.config.sample_size").cast("bigint")
    return plain(
        after.select(
            *SERVICE,
            "active",
            "previous_run",
            "next_run",
            "client_version",
            sample_size.alias("sample_size"),
        )
    )


def update_profiles(spark, sf_dir):
    """Purchases update the profile of their user; users without an active profile are unknown."""
    source = views.events(spark, sf_dir)
    stored = views.user_profiles(source).where("active")
    requests = views.profile_requests(source).where("event_type = 'purchase'")
    after = profile_ops.update_profiles(stored, requests, arrival="arrival")
    sample_size = F.get_json_object("profile", "$.config.sample_size").cast("bigint")
    return plain(
        after.select(*SERVICE, "drift_type", "next_run", "updated_at", sample_size.alias("sample_size"))
    )


def profile_rejects(spark, sf_dir):
    """Requests cut short, empty ones, and ones with a schedule that can't be read."""
    arrival = F.col("arrival") % 5
    asked = views.profile_requests(views.events(spark, sf_dir)).withColumn(
        "profile",
        F.when(arrival == 0, F.expr("left(profile, 40)"))
        .when(arrival == 1, F.lit("{}"))
        .when(arrival == 2, F.regexp_replace("profile", '"schedule":"[^"]*"', '"schedule":"now and then"'))
        .otherwise(F.col("profile")),
    )
    refused = profile_ops.profile_rejects(asked, views.CHECK_TIME)
    return refused.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def set_profile_status(spark, sf_dir):
    """Clicks switch a profile on, errors switch it off; the last one counts."""
    source = views.events(spark, sf_dir)
    requests = views.profile_requests(source).where("event_type in ('click', 'error')")
    after = profile_ops.set_profile_status(views.user_profiles(source), requests, arrival="arrival")
    return after.select(*SERVICE, "active")


# Drift checks


def _samples(spark, sf_dir):
    settings = profile_ops.profile_settings(views.service_profiles(spark, sf_dir))
    return drift_check.monitored_samples(
        views.drift(spark, sf_dir), drift_check.numbered_limits(settings)
    )


def monitored_values(spark, sf_dir):
    return plain(_samples(spark, sf_dir).select(*SERIES, "created_at", "value"))


def spc_zones(spark, sf_dir):
    return plain(spc.classify(_samples(spark, sf_dir)).select(*SERIES, "created_at", "value", "code"))


def _runs(spark, sf_dir, kind):
    settings = profile_ops.profile_settings(views.service_profiles(spark, sf_dir))
    found = drift_check.spc_runs(views.drift(spark, sf_dir), drift_check.numbered_limits(settings))
    return found.where(F.col("kind") == kind).select(*SERIES, "zone", "longest")


def spc_consecutive(spark, sf_dir):
    return _runs(spark, sf_dir, spc.CONSECUTIVE)


def spc_alternating(spark, sf_dir):
    return _runs(spark, sf_dir, spc.ALTERNATING)


def spc_alerts(spark, sf_dir):
    found, _ = drift_check.check_drift(
        views.drift(spark, sf_dir), views.service_profiles(spark, sf_dir)
    )
    return found


def lineitem_spc_runs(spark, sf_dir):
    """Runs over instants shared by many samples, series cut to equal length."""
    settings = profile_ops.profile_settings(views.lineitem_profiles(spark, sf_dir))
    return drift_check.spc_runs(
        views.lineitem_drift(spark, sf_dir), drift_check.numbered_limits(settings)
    )


def _due_run(spark, sf_dir):
    stored = views.alerts(spark, sf_dir)
    return stored, drift_check.run_due_checks(
        views.service_profiles(spark, sf_dir), views.drift(spark, sf_dir), stored, views.CHECK_TIME
    )


def drift_run_alerts(spark, sf_dir):
    """Alerts a scheduled run appends to the log. Ids continue those of the log without gaps."""
    _, result = _due_run(spark, sf_dir)
    entry = lambda key: F.element_at("alert", key).alias(key)
    return plain(
        result.alerts.select(
            *SERVICE, "feature", entry("zone"), entry("kind"), "status", "created_at", "scheduled_at"
        )
    )


def drift_run_alert_ids(spark, sf_dir):
    _, result = _due_run(spark, sf_dir)
    return result.alerts.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("id").alias("distinct_ids"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
    )


def stored_alert_ids(spark, sf_dir):
    """All alerts are stored three times: as they are, ten days back, and after the log was emptied.
    Every id is given once."""
    store = tables.Tables(spark, run_dir(use_utc(spark)))
    source = views.alerts(spark, sf_dir).withColumn("event", F.col("id"))
    n, given = source.count(), []
    for back in (0, 10, 5):
        last = store.reserve_alert_ids(n)
        dated = source.withColumn("created_at", F.col("created_at") - F.make_dt_interval(days=F.lit(back)))
        numbered = number_rows(dated.drop("id"), ["event"], "id", last)
        store.append_alerts(numbered.drop("event"))
        given.append(pin(store.read("alerts").where((F.col("id") > last) & (F.col("id") <= last + n)).select("id")))
        if back:
            store.drop_expired("alerts", views.NOW + dt.timedelta(days=100))
    ids = given[0].unionByName(given[1]).unionByName(given[2])
    left = store.read("alerts").agg(F.count(F.lit(1)).alias("left"))
    return ids.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("id").alias("distinct_ids"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
    ).crossJoin(left)


def drift_run_errors(spark, sf_dir):
    """Purchases fall silent after the baseline, and the profile of one service has a rule that can't be
    read."""
    drift = views.drift(spark, sf_dir)
    heard = drift.where((F.col("feature") != "purchase") | (F.col("created_at") <= F.lit(views.BASELINE_END)))
    broken = F.regexp_replace("profile", views.RULE, "eight of nine")
    profiles = views.service_profiles(spark, sf_dir).withColumn(
        "profile", F.when(F.col("repository") == "repo_2", broken).otherwise(F.col("profile"))
    )
    stored = views.alerts(spark, sf_dir)
    return drift_check.run_due_checks(profiles, heard, stored, views.CHECK_TIME, history=drift).errors


def drift_run_profiles(spark, sf_dir):
    profiles = views.service_profiles(spark, sf_dir)
    after = profile_ops.advance_schedules(profiles, views.CHECK_TIME)
    return plain(after.select(*SERVICE, "previous_run", "next_run", "updated_at"))


# Alerts


def query_alerts(spark, sf_dir):
    found = alert_log.query_alerts(
        views.alerts(spark, sf_dir), ONE_SERVICE, active=True, limit_timestamp=TWO_DAYS_AGO, limit=50
    )
    return plain(
        found.select(
            *SERIES,
            "created_at",
            "status",
            "id",
            F.element_at("alert", "zone").alias("zone"),
            F.element_at("alert", "kind").alias("kind"),
        )
    )


def query_alerts_any_status(spark, sf_dir):
    found = alert_log.query_alerts(views.alerts(spark, sf_dir), active=False)
    return plain(found.select(*SERIES, "created_at", "status", "id"))


# Messages, inserts and tables


def decode_values(spark, sf_dir):
    return plain(msg.decode(views.messages(spark, sf_dir)).spc)


def decode_routes(spark, sf_dir):
    decoded = msg.decode(views.messages(spark, sf_dir)).observability
    return plain(
        decoded.select(
            "created_at", *SERVICE, "request_count", "error_count", F.explode("route_metrics").alias("r")
        ).select(
            "created_at",
            *SERVICE,
            "request_count",
            "error_count",
            "r.route_name",
            F.round("r.metrics.p95", 6).alias("p95"),
            F.coalesce(F.try_element_at("r.status_codes", F.lit("200")), F.lit(0)).alias("ok_count"),
        )
    )


def decode_rejects(spark, sf_dir):
    rejects = msg.decode(views.messages(spark, sf_dir)).rejects
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _null_keyed(drift: DataFrame) -> DataFrame:
    """Sign-ups lose their value, so that their key is incomplete."""
    return drift.withColumn("value", F.when(F.col("feature") != "signup", F.col("value")))


def insert_ignore_duplicates(spark, sf_dir):
    """Half of the values are stored; all of them arrive, clicks twice."""
    drift = _null_keyed(views.drift(spark, sf_dir))
    stored = drift.where(F.col("created_at") < F.lit(TWO_DAYS_AGO))
    incoming = drift.unionByName(drift.where("feature = 'click'"))
    return plain(
        insert_ignore(stored, incoming)
        .groupBy(*SERIES, F.to_date("created_at").cast("timestamp").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    )


def scan_service(spark, sf_dir):
    dated = tables.with_event_date(views.drift(spark, sf_dir))
    return plain(tables.scan_since(dated, TWO_DAYS_AGO, ONE_SERVICE).drop("event_date"))


def retention_filter(spark, sf_dir):
    days = tables.RETENTION_DAYS["drift"]
    return plain(
        tables.apply_retention(views.drift(spark, sf_dir), days, views.NOW).drop("event_date")
    )


def partitioned_table(spark, sf_dir):
    """Values stored by day and read back for one window."""
    store = tables.Tables(spark, run_dir(use_utc(spark)))
    store.write_batch("drift", views.drift(spark, sf_dir), "first-0")
    found = tables.scan_window(store.read("drift"), 5 * 1440, views.NOW)
    return plain(found.select("created_at", *SERIES, "value"))


def compacted_table(spark, sf_dir):
    """Values stored in four batches, whose days are then merged; a batch is stored again after that."""
    store = tables.Tables(spark, run_dir(use_utc(spark)))
    drift = pin(views.drift(spark, sf_dir))
    part = F.pmod(F.xxhash64(*SERIES, "created_at", "value"), F.lit(4))
    for k in range(4):
        store.write_batch("drift", drift.where(part == k), f"part/{k}")
    store.merge_days("drift", "2100-01-01")
    store.write_batch("drift", drift.where(part == 2), "part/2")
    return plain(store.read("drift").select("created_at", *SERIES, "value"))


# Streams


def _ingested_twice(spark, sf_dir, key_buckets=None):
    """All messages arrive as files, and once more under another batch name."""
    run = run_dir(use_utc(spark))
    views.messages(spark, sf_dir).select("value").write.text(f"{run}/messages")
    store = tables.Tables(spark, f"{run}/tables", key_buckets)
    for name in ("one", "two"):
        stream = msg.file_stream(spark, f"{run}/messages")
        streams.start_ingest(stream, store, f"{run}/checkpoint-{name}", name).awaitTermination()
    return store


def stream_ingest(spark, sf_dir):
    """Values are stored once; those without a value once for each message."""
    return plain(_ingested_twice(spark, sf_dir).read("drift").select("created_at", *SERIES, "value"))


def stream_ingest_indexed(spark, sf_dir):
    """The same, with an index of stored keys in place of the values."""
    store = _ingested_twice(spark, sf_dir, key_buckets=8)
    spark.sql(f"DROP TABLE {store.keys.table}")
    return plain(store.read("drift").select("created_at", *SERIES, "value"))


def stream_ingest_routes(spark, sf_dir):
    """Route metrics, of which equal ones are different requests, and rejects are stored once for each
    message."""
    store = _ingested_twice(spark, sf_dir)
    found = store.read("observability").select(*SERVICE, "request_count", "error_count", F.explode("route_metrics").alias("r"))
    metrics = found.groupBy(*SERVICE, "r.route_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("request_count").alias("request_count"),
        F.sum("error_count").alias("error_count"),
        F.round(F.sum("r.metrics.p95"), 4).alias("p95"),
    )
    rejects = store.read("rejects").groupBy(F.col("reason").alias("route_name")).agg(F.count(F.lit(1)).alias("n"))
    return metrics.unionByName(rejects, allowMissingColumns=True)


def stream_dedupe(spark, sf_dir):
    """Sign-ups without a value all pass; of the others repeats are dropped."""
    run = run_dir(use_disk_state(use_utc(spark)))
    source = spark.readStream.schema(views.EVENTS).parquet(f"{sf_dir}/events.parquet*")
    repeated = source.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    deduped = streams.dedupe_stream(_null_keyed(views.to_drift(repeated)), "60 days")
    query = (
        deduped.writeStream.format("parquet")
        .option("path", f"{run}/out")
        .option("checkpointLocation", f"{run}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    found = spark.read.schema(tables.schemas.DRIFT).parquet(f"{run}/out")
    return plain(found.select("created_at", *SERIES, "value"))


def stream_binned(spark, sf_dir):
    run = run_dir(use_utc(spark))
    source = spark.readStream.schema(views.EVENTS).parquet(f"{sf_dir}/events.parquet*")
    bins = streams.binned_stream(views.to_drift(source), 3_600_000_000, "60 days")
    streams.write_updates(bins, f"{run}/bins", f"{run}/checkpoint").awaitTermination()
    latest = streams.latest_updates(spark.read.parquet(f"{run}/bins"))
    return plain(_rounded(latest, "value"))


def _newest_first(rows: DataFrame, run: str) -> None:
    """Rows as files of a folder, one for each part of the time they cover and the newest first, so
    that all but the first come late."""
    week = F.floor(F.dayofyear("created_at") / 7)
    weeks = sorted((r[0] for r in rows.select(week).distinct().collect() if r[0] is not None), reverse=True)
    for k, number in enumerate(weeks):
        rows.where(week == number).coalesce(1).write.parquet(f"{run}/in/part={k:03d}")


def _as_it_comes(spark, run: str, rows: DataFrame) -> DataFrame:
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(f"{run}/in/part=*")


def stream_binned_late(spark, sf_dir):
    """Rows arrive weeks late, and every one counts."""
    run = run_dir(use_utc(spark))
    drift = views.drift(spark, sf_dir)
    _newest_first(drift, run)
    store = tables.Tables(spark, f"{run}/tables")
    sums = lambda rows: rollups.bin_sums(rows, 3_600_000_000)
    stream = _as_it_comes(spark, run, drift)
    rollups.start_rollup(stream, store, "bins", sums, f"{run}/checkpoint", fold_after=2).awaitTermination()
    return plain(_rounded(rollups.read_bins(store, 3_600_000_000), "value"))


def stream_request_histogram(spark, sf_dir):
    """Latency buckets of a log of requests that arrives in parts, the oldest last."""
    run = run_dir(use_utc(spark))
    log = views.request_log(spark, sf_dir)
    _newest_first(log, run)
    store = tables.Tables(spark, f"{run}/tables")
    stream = _as_it_comes(spark, run, log)
    rollups.start_rollup(stream, store, "requests", rollups.request_sums, f"{run}/checkpoint", fold_after=3).awaitTermination()
    return rollups.read_requests(store).select("method", "path", "status", "le", "bucket_count")


QUERIES = {
    f.__name__: f
    for f in (
        distinct_features,
        feature_values_since,
        feature_values_positions,
        feature_series_chunks,
        lineitem_positions,
        drift_records_truncated,
        drift_records_monitored,
        lineitem_records_truncated,
        binned_feature_values,
        binned_drift_records,
        binned_fractional,
        binned_feature_series,
        lineitem_binned,
        window_coverage,
        observability_binned,
        observability_status_counts,
        observability_series,
        request_counts,
        request_histogram,
        profile_limits,
        profile_errors,
        get_profile,
        due_profiles,
        cron_next_run,
        advance_schedule,
        insert_profiles,
        update_profiles,
        profile_rejects,
        set_profile_status,
        monitored_values,
        spc_zones,
        spc_consecutive,
        spc_alternating,
        spc_alerts,
        lineitem_spc_runs,
        drift_run_alerts,
        drift_run_alert_ids,
        stored_alert_ids,
        drift_run_errors,
        drift_run_profiles,
        query_alerts,
        query_alerts_any_status,
        decode_values,
        decode_routes,
        decode_rejects,
        insert_ignore_duplicates,
        scan_service,
        retention_filter,
        partitioned_table,
        compacted_table,
        stream_ingest,
        stream_ingest_indexed,
        stream_ingest_routes,
        stream_dedupe,
        stream_binned,
        stream_binned_late,
        stream_request_histogram,
    )
}
