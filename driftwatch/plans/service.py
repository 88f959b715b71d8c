"""The operations a monitoring client calls, over stored tables."""

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.functions.timewin import as_timestamp, window_minutes
from driftwatch.operators import alerts as alert_log
from driftwatch.operators import observability as routes
from driftwatch.operators import profiles as profile_ops
from driftwatch.operators import series
from driftwatch.plans.drift_check import run_due_checks
from driftwatch.schemas import SERVICE
from driftwatch.session import owned_folders, pin, use_utc
from driftwatch.sources import tables as tbl
from driftwatch.streaming.ingest import ingest


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def service_key(repository: str, name: str, version: str) -> dict:
    return dict(zip(SERVICE, (repository, name, version)))


class Monitor:
    """Reads prune by day; a ``service`` of None means all services at once."""

    def __init__(self, spark: SparkSession, root: str, key_buckets: int | None = None):
        self.tables = tbl.Tables(use_utc(spark), root, key_buckets)

    def post_records(self, messages: DataFrame, batch: str, received_at=None) -> None:
        """Store a batch of JSON messages. Posting the same batch again replaces what was stored of it.

        ``received_at`` is when the batch arrived; give the same again with a repeated batch, or a
        column ``timestamp`` with the messages, and nothing changes.
        """
        if received_at is not None:
            messages = messages.withColumn("timestamp", as_timestamp(received_at))
        ingest(self.tables, messages, batch)

    def drift(self, service: dict | None, time_window: str, max_data_points: int, now=None) -> DataFrame:
        """Binned means of every feature, newest bin first."""
        now = now or utc_now()
        recent = tbl.scan_window(self.tables.read("drift"), window_minutes(time_window), now, service)
        return series.binned_drift_series(recent, time_window, max_data_points, now=now)

    def observability(
        self, service: dict | None, time_window: str, max_data_points: int, now=None
    ) -> DataFrame:
        """Binned metrics of every route, newest bin first."""
        now = now or utc_now()
        recent = tbl.scan_window(
            self.tables.read("observability"), window_minutes(time_window), now, service
        )
        return routes.binned_routes_series(recent, time_window, max_data_points, now=now)

    def profile(self, service: dict) -> DataFrame:
        return profile_ops.get_profile(self.tables.read("profiles"), service)

    def insert_profiles(
        self, requests: DataFrame, now=None, arrival: str | None = None, version_field: str = "client_version"
    ) -> DataFrame:
        """Store new profiles; returns the requests refused, with a reason."""
        now = now or utc_now()
        with owned_folders(self.tables.spark):
            self.tables.change_profiles(
                lambda table: profile_ops.insert_profiles(table, requests, now, arrival, version_field)
            )
        return profile_ops.profile_rejects(requests, now)

    def update_profiles(self, requests: DataFrame, arrival: str | None = None, now=None) -> DataFrame:
        """Replace documents; returns the requests refused, with a reason."""
        now = now or utc_now()
        self.tables.change_profiles(
            lambda table: profile_ops.update_profiles(table, requests, arrival, now)
        )
        return profile_ops.profile_rejects(requests, now)

    def set_profile_status(self, requests: DataFrame, arrival: str | None = None) -> None:
        self.tables.change_profiles(
            lambda table: profile_ops.set_profile_status(table, requests, arrival)
        )

    def insert_alert(self, service: dict, feature: str, alert: dict, now=None) -> None:
        """Store an alert that the caller raises."""
        log = self.tables.read("alerts").drop("event_date").limit(0)
        last = self.tables.reserve_alert_ids(1)
        self.tables.append_alerts(alert_log.insert_alert(log, service, feature, alert, now or utc_now(), last))

    def alerts(
        self,
        service: dict | None,
        active: bool | None = None,
        limit_timestamp=None,
        limit: int | None = None,
    ) -> DataFrame:
        table = self.tables.read("alerts")
        if limit_timestamp is not None:
            table = tbl.scan_since(table, limit_timestamp, inclusive=True)
        return alert_log.query_alerts(table, service, active, limit_timestamp, limit)

    def run_due_checks(self, now=None, **options) -> DataFrame:
        """Check all due profiles, store alerts and then run dates, and return the errors.

        Values older than the oldest previous run are not read, and of the history, which is searched
        for silent features only, no day past its retention. Alerts are keyed by the instant a run was due
        and stored after it, so of their log only days since the oldest due instant are read.
        The alerts are pinned before they are stored, so that numbering them does not depend on the
        log they are added to. Afterwards only the run dates of the profiles checked are changed, on
        what the table holds by then. Intermediate tables of the run are removed at its end.
        """
        now = now or utc_now()
        with owned_folders(self.tables.spark):
            profiles = pin(self._profiles())
            due = profile_ops.due_profiles(profiles, now)
            oldest, first_due = due.agg(
                F.min(F.unix_micros("previous_run")), F.min(F.unix_micros("next_run"))
            ).first()
            drift, log = self.tables.read("drift"), self.tables.read("alerts")
            history = tbl.apply_retention(drift, tbl.RETENTION_DAYS["drift"], now)
            if oldest is not None:
                drift = tbl.scan_since(drift, F.timestamp_micros(F.lit(oldest)))
                log = log.where(F.col("event_date") >= F.to_date(F.timestamp_micros(F.lit(first_due))))
            result = run_due_checks(
                profiles,
                drift,
                log.drop("event_date"),
                now,
                history=history,
                last_id=self.tables.reserve_alert_ids,
                **options,
            )
            self.tables.append_alerts(pin(result.alerts))
            errors = self.tables.append_errors(result.errors, now)
            dates = pin(profile_ops.run_dates(profiles, now))
            self.tables.change_profiles(lambda table: profile_ops.apply_run_dates(table, dates, now))
            return errors

    def merge_batches(self, now=None, least: int = 2) -> None:
        """Merge the ingest batches of past days into one a day, so that files stay few."""
        today = (now or utc_now()).date()
        for name in tbl.BATCHED:
            self.tables.merge_days(name, today, least)

    def drop_expired(self, now=None) -> None:
        """Remove days that have outlived their retention, and old snapshots of the profiles."""
        for name in tbl.RETENTION_DAYS:
            self.tables.drop_expired(name, now or utc_now())
        self.tables.drop_snapshots()

    def expired_days(self, name: str, now=None) -> DataFrame:
        """Days of a table that have outlived their retention, for the job that drops folders."""
        return tbl.expired_days(self.tables.read(name), tbl.RETENTION_DAYS[name], now or utc_now())

    def _profiles(self) -> DataFrame:
        return self.tables.read("profiles").drop("snapshot")
