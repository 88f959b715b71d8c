"""Scheduled drift checks over all due profiles in one job."""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.timewin import as_timestamp
from driftwatch.operators import alerts as alert_log
from driftwatch.operators import profiles as profile_ops
from driftwatch.operators.joins import BROADCAST_BYTES, dimension_join
from driftwatch.operators.slots import SLOT_SECONDS
from driftwatch.operators.spc import classify, longest_runs, raise_alerts
from driftwatch.schemas import SERIES, SERVICE
from driftwatch.session import pin

DATA_KEY = [f"data_{c}" for c in SERVICE]


class CheckResult(NamedTuple):
    alerts: DataFrame
    profiles: DataFrame
    errors: DataFrame


def numbered_limits(settings: DataFrame) -> DataFrame:
    """Limits of all monitored series with a ``series_id`` and a ``service_id``.

    Samples then travel through the shuffles with two numbers in place of four texts. The numbers
    are arbitrary but unique, and fixed once the limits are pinned.
    """
    services = settings.withColumn("service_id", F.monotonically_increasing_id())
    limits = profile_ops.monitored_limits(services, keep=["service_id"])
    return pin(limits.withColumn("series_id", F.monotonically_increasing_id()))


def monitored_samples(
    drift: DataFrame, limits: DataFrame, limit_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Values since each profile's previous run, with the limits of their feature."""
    facts = drift.select(
        *[F.col(c).alias(f"data_{c}") for c in SERVICE], "feature", "created_at", "value"
    )
    return dimension_join(
        facts,
        limits,
        DATA_KEY + ["feature"],
        spread_by=["created_at", "value"],
        extra=F.col("created_at") > F.col("previous_run"),
        limit_bytes=limit_bytes,
    )


def spc_runs(
    drift: DataFrame,
    limits: DataFrame,
    slot_seconds: int = SLOT_SECONDS,
    limit_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Longest runs of every monitored series, under the names of its profile and feature."""
    samples = classify(monitored_samples(drift, limits, limit_bytes))
    runs = longest_runs(
        samples, ["service_id"], ["service_id", "series_id"], slot_seconds=slot_seconds
    )
    return runs.join(limits.select(*SERIES, "series_id"), "series_id").select(
        *SERIES, "kind", "zone", "longest"
    )


def spc_alerts(drift: DataFrame, settings: DataFrame, **options) -> DataFrame:
    """Alerts of control-chart profiles: zones, runs, rule."""
    runs = spc_runs(drift, numbered_limits(settings), **options)
    return raise_alerts(runs, profile_ops.rules(settings), SERVICE)


# One check per drift type; a profile of any other type is reported as an error.
CHECKS = {profile_ops.SPC: spc_alerts}


def empty_monitored(
    drift: DataFrame,
    settings: DataFrame,
    history: DataFrame | None = None,
    limit_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Monitored features without values since the previous run, though they had some before.

    The silent ones are found among the recent values, which a check reads anyway; ``history`` is
    searched for them alone, and where there are none, for nothing.
    """
    limits = profile_ops.monitored_limits(settings).select(*SERIES, *DATA_KEY, "previous_run")
    key = DATA_KEY + ["feature"]

    def rows_of(table: DataFrame, dimension: DataFrame, when: Column) -> DataFrame:
        facts = table.select(
            *[F.col(c).alias(f"data_{c}") for c in SERVICE], "feature", "created_at"
        )
        found = dimension_join(facts, dimension, key, ["created_at"], when, limit_bytes=limit_bytes)
        return found.select(*SERIES).distinct()

    heard = rows_of(drift, limits, F.col("created_at") > F.col("previous_run"))
    silent = pin(limits.join(heard, SERIES, "left_anti"))
    past = drift if history is None else history
    return rows_of(past, silent, F.col("created_at") <= F.col("previous_run"))


def check_drift(
    drift: DataFrame,
    profiles: DataFrame,
    strict: bool = False,
    history: DataFrame | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Alerts and errors of the given profiles. One bad profile does not affect the others.

    A feature without new values is left out and reported; with ``strict`` it fails its service.
    ``history`` tells which features ever had values, where ``drift`` holds recent ones only.
    """
    settings = pin(profile_ops.profile_settings(profiles))
    empty = empty_monitored(drift, settings, history, options.get("limit_bytes", BROADCAST_BYTES))
    errors = profile_ops.profile_errors(settings).unionByName(
        empty.select(*SERVICE, F.concat(F.lit("no new values: "), "feature").alias("reason"))
    )
    if strict:
        settings = settings.join(empty.select(*SERVICE).distinct(), SERVICE, "left_anti")
    found = None
    for drift_type, check in CHECKS.items():
        part = check(drift, settings.where(F.col("drift_type") == drift_type), **options)
        found = part if found is None else found.unionByName(part)
    return found, errors


def run_due_checks(
    profiles: DataFrame,
    drift: DataFrame,
    alerts: DataFrame,
    now,
    last_id: int | Callable[[int], int] | None = None,
    **options,
) -> CheckResult:
    """Check every due profile: alerts to append, the profile table afterwards, and errors.

    Store the alerts before the profiles. A crash in between repeats the run, and alerts are keyed by
    the instant the run was due, so the repetition adds nothing. ``last_id`` is the last alert id
    given out, where ``alerts`` is only part of the log, or a function that reserves ids.
    """
    now = as_timestamp(now)
    due = profile_ops.due_profiles(profiles, now)
    raised, errors = check_drift(drift, due, **options)
    raised = raised.join(due.select(*SERVICE, F.col("next_run").alias("scheduled_at")), SERVICE)
    return CheckResult(
        alert_log.new_alerts(alerts, raised, now, last_id),
        profile_ops.advance_schedules(profiles, now),
        errors.unionByName(profile_ops.schedule_errors(profiles, now)),
    )
