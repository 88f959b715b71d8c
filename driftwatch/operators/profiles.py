"""Drift profiles: documents, limits, rules, schedules and the changes made to them.

Changes are functions from the old table to the new one; ``sources.tables`` stores the result.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.cron import next_runs
from driftwatch.functions.timewin import as_timestamp, now_or
from driftwatch.operators.series import of_service
from driftwatch.schemas import LIMIT_COLUMNS, PROFILE_DOCUMENT, SERVICE
from driftwatch.session import pin

SPC = "SPC"
DEFAULT_CLIENT_VERSION = "0.1.0"


def parse_documents(profiles: DataFrame) -> DataFrame:
    """Adds ``doc``, the typed profile document, beside the raw text."""
    return profiles.withColumn("doc", F.from_json("profile", PROFILE_DOCUMENT))


def _document_version(field: str) -> Column:
    """The client's version, as the top-level ``field`` of the document gives it."""
    return F.coalesce(F.get_json_object("profile", f"$.{field}"), F.lit(DEFAULT_CLIENT_VERSION))


def _rule() -> Column:
    return F.transform(
        F.split(F.trim("doc.config.alert_config.rule.rule"), r"\s+"), lambda n: n.try_cast("int")
    )


def _rule_is_valid() -> Column:
    return F.coalesce(
        (F.size("rule") == 8) & F.forall("rule", lambda n: n.isNotNull()), F.lit(False)
    )


def profile_settings(profiles: DataFrame) -> DataFrame:
    """One row per profile with what a check needs, and ``error`` where it cannot run.

    The key of the table and the key inside the document may differ: values are looked up by the
    latter (``data_*``), alerts are stored under the former.
    """
    config = "doc.config"
    settings = parse_documents(profiles).select(
        *SERVICE,
        "drift_type",
        "schedule",
        "previous_run",
        "next_run",
        *[F.col(f"{config}.{c}").alias(f"data_{c}") for c in SERVICE],
        F.col("doc.features").alias("features"),
        F.coalesce(
            F.col(f"{config}.alert_config.features_to_monitor"), F.array().cast("array<string>")
        ).alias("features_to_monitor"),
        F.col(f"{config}.alert_config.rule.zones_to_monitor").alias("zones_to_monitor"),
        _rule().alias("rule"),
    )
    incomplete = F.exists(
        F.map_values("features"), lambda f: F.greatest(*[f[c].isNull() for c in LIMIT_COLUMNS])
    )
    unkeyed = F.greatest(*[F.col(f"data_{c}").isNull() for c in SERVICE])
    error = (
        F.when(~F.coalesce(F.col("drift_type") == SPC, F.lit(False)), "unknown drift type")
        .when(F.col("features").isNull() | unkeyed, "unreadable profile")
        .when(incomplete, "incomplete limits")
        .when(~_rule_is_valid(), "malformed rule")
    )
    return settings.withColumn("error", error)


def profile_errors(settings: DataFrame) -> DataFrame:
    return settings.where(F.col("error").isNotNull()).select(*SERVICE, F.col("error").alias("reason"))


def monitored_limits(settings: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per profile and monitored feature with its control limits and the columns to ``keep``."""
    keep = keep or []
    monitored = (F.size("features_to_monitor") == 0) | F.array_contains(
        "features_to_monitor", F.col("feature")
    )
    return (
        settings.where(F.col("error").isNull())
        .select(
            *SERVICE,
            *[f"data_{c}" for c in SERVICE],
            "previous_run",
            *keep,
            "features_to_monitor",
            F.explode("features").alias("feature", "limits"),
        )
        .where(monitored)
        .select(
            *SERVICE,
            *[f"data_{c}" for c in SERVICE],
            "feature",
            "previous_run",
            *keep,
            *[F.col(f"limits.{c}").alias(c) for c in LIMIT_COLUMNS],
        )
    )


def rules(settings: DataFrame) -> DataFrame:
    return settings.where(F.col("error").isNull()).select(*SERVICE, "rule", "zones_to_monitor")


def get_profile(profiles: DataFrame, service: dict) -> DataFrame:
    """The document of one service; no row when there is none."""
    return of_service(profiles, service).select(*SERVICE, "profile")


def due_profiles(profiles: DataFrame, now=None) -> DataFrame:
    """Active profiles whose next run has passed, all of them at once."""
    return profiles.where(F.col("active") & (F.col("next_run") < now_or(now)))


#: Requests in a file of those that are pinned. Documents resemble each other, so as Parquet they are tiny
#: beside what they are in memory, and a file of them all would make tasks that sort millions.
ROWS_PER_FILE = 10_000
UNREADABLE_PROFILE, UNREADABLE_SCHEDULE = "unreadable profile", "unreadable schedule"


def _with_reason(requests: DataFrame, now, once: bool = True) -> DataFrame:
    """Requests with the service their document names (``_repository`` and so on) and ``_reason``, why
    they are refused, if they are.

    The schedules are looked at apart. So that documents are parsed ``once``, what is needed of them is
    pinned, and so are the schedules.
    """
    parsed = parse_documents(requests).select(
        *requests.columns,
        *[F.col(f"doc.config.{c}").alias(f"_{c}") for c in SERVICE],
        F.col("doc.config.alert_config.schedule").alias("_schedule"),
    )
    parsed = pin(parsed, rows_per_file=ROWS_PER_FILE) if once else parsed
    upcoming = next_runs(parsed, now, "_schedule").select(
        F.col("schedule").alias("_schedule"), F.col("next_run").alias("_upcoming")
    )
    # Of a table the size is known when the join is planned, so that documents are not dealt out by schedule
    # first where there are few schedules.
    upcoming = pin(upcoming) if once else upcoming
    keyless = F.greatest(*[F.col(f"_{c}").isNull() for c in SERVICE])
    reason = F.when(keyless, UNREADABLE_PROFILE).when(F.col("_upcoming").isNull(), UNREADABLE_SCHEDULE)
    return parsed.join(upcoming, "_schedule", "left").withColumn("_reason", reason)


def profile_rejects(requests: DataFrame, now) -> DataFrame:
    """``profile`` and ``reason`` of requests that inserts and updates refuse: the document cannot be
    read or lacks its key, or its schedule cannot be read or never comes round."""
    refused = _with_reason(requests, as_timestamp(now), once=False).where(F.col("_reason").isNotNull())
    return refused.select("profile", F.col("_reason").alias("reason"))


def insert_profiles(
    profiles: DataFrame,
    requests: DataFrame,
    now,
    arrival: str | None = None,
    version_field: str = "client_version",
) -> DataFrame:
    """The table after inserting the requested profiles that it lacks.

    ``requests`` has ``profile`` (document text) and ``drift_type``. New profiles are inactive, and
    both run dates are the next instant of their schedule. Of several requests for one service the
    first by ``arrival`` counts. Requests that ``profile_rejects`` names are not stored.
    """
    now = as_timestamp(now)
    accepted = _with_reason(requests, now).where(F.col("_reason").isNull())
    keyed = accepted.select(
        *[F.col(f"_{c}").alias(c) for c in SERVICE],
        "profile",
        "drift_type",
        (F.col(arrival) if arrival else F.lit(0)).alias("_arrival"),
    )
    # Only the keys are read from every request; the rest comes from the documents that remain.
    first = (
        keyed.dropna(subset=SERVICE)
        .groupBy(*SERVICE)
        .agg(F.min_by(F.struct("profile", "drift_type"), F.struct("_arrival", "profile")).alias("p"))
        .select(*SERVICE, "p.*")
    )
    fresh = first.join(profiles.select(*SERVICE), SERVICE, "left_anti")
    # Pinned because the schedules are looked at apart: one row per new service, however many
    # requests there were.
    detailed = pin(
        parse_documents(fresh).select(
            *SERVICE,
            "profile",
            "drift_type",
            F.col("doc.config.alert_config.schedule").alias("schedule"),
            _document_version(version_field).alias("client_version"),
        )
    )
    scheduled = detailed.join(next_runs(detailed, now), "schedule", "left")
    rows = scheduled.select(
        now.alias("created_at"),
        now.alias("updated_at"),
        "name",
        "repository",
        "version",
        "profile",
        F.lit(False).alias("active"),
        "schedule",
        "next_run",
        F.col("next_run").alias("previous_run"),
        "client_version",
        "drift_type",
    )
    return profiles.unionByName(rows.select(*profiles.columns))


def update_profiles(
    profiles: DataFrame, requests: DataFrame, arrival: str | None = None, now=None
) -> DataFrame:
    """The table with ``profile`` and ``drift_type`` replaced; everything else stays.

    ``requests`` has the service key, ``profile`` and ``drift_type``. The last request by
    ``arrival`` counts; one for an unknown service changes nothing. Requests that
    ``profile_rejects`` names change nothing either.
    """
    accepted = _with_reason(requests, now_or(now)).where(F.col("_reason").isNull())
    requests = accepted.select(*requests.columns)
    order = F.struct((F.col(arrival) if arrival else F.lit(0)).alias("a"), F.col("profile"))
    last = (
        requests.groupBy(*SERVICE)
        .agg(F.max_by(F.struct("profile", "drift_type"), order).alias("_new"))
    )
    joined = profiles.join(last, SERVICE, "left")
    replaced = {
        c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
        for c in ("profile", "drift_type")
    }
    return joined.select(*[replaced.get(c, F.col(c)) for c in profiles.columns])


def set_profile_status(profiles: DataFrame, requests: DataFrame, arrival: str | None = None) -> DataFrame:
    """The table with ``active`` set as ``requests`` (service key, ``active``) say."""
    order = F.struct((F.col(arrival) if arrival else F.lit(0)).alias("a"), F.col("active"))
    last = requests.groupBy(*SERVICE).agg(F.max_by("active", order).alias("_active"))
    joined = profiles.join(last, SERVICE, "left")
    return joined.select(
        *[
            F.coalesce("_active", "active").alias("active") if c == "active" else F.col(c)
            for c in profiles.columns
        ]
    )


def advance_schedules(profiles: DataFrame, now) -> DataFrame:
    """The table after a check: due profiles take their next run as the previous one and get the
    next instant of their schedule. A schedule that cannot be read leaves the profile as it is."""
    now = as_timestamp(now)
    due = F.coalesce(F.col("active") & (F.col("next_run") < now), F.lit(False))
    upcoming = next_runs(profiles.where(due), now).withColumnRenamed("next_run", "_upcoming")
    moves = due & F.col("_upcoming").isNotNull()
    changed = {
        "previous_run": F.when(moves, F.col("next_run")).otherwise(F.col("previous_run")),
        "next_run": F.when(moves, F.col("_upcoming")).otherwise(F.col("next_run")),
        "updated_at": F.when(moves, now).otherwise(F.col("updated_at")),
    }
    joined = profiles.join(upcoming, "schedule", "left")
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in profiles.columns])


def run_dates(profiles: DataFrame, now) -> DataFrame:
    """Service, ``checked`` (the next run that was due) and ``upcoming`` of due profiles whose schedule
    goes on: what ``apply_run_dates`` needs of a check."""
    due = due_profiles(profiles, now)
    upcoming = next_runs(due, now).where(F.col("next_run").isNotNull())
    return due.join(upcoming.withColumnRenamed("next_run", "upcoming"), "schedule").select(
        *SERVICE, F.col("next_run").alias("checked"), "upcoming"
    )


def apply_run_dates(profiles: DataFrame, dates: DataFrame, now) -> DataFrame:
    """The table with new run dates of the profiles checked, and nothing else changed. A profile whose
    next run is no longer the one that was checked is left alone."""
    now = as_timestamp(now)
    moves = F.col("checked") == F.col("next_run")
    changed = {
        "previous_run": F.when(moves, F.col("checked")).otherwise(F.col("previous_run")),
        "next_run": F.when(moves, F.col("upcoming")).otherwise(F.col("next_run")),
        "updated_at": F.when(moves, now).otherwise(F.col("updated_at")),
    }
    joined = profiles.join(dates, SERVICE, "left")
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in profiles.columns])


def schedule_errors(profiles: DataFrame, now) -> DataFrame:
    """Due profiles whose schedule has no next instant."""
    due = due_profiles(profiles, now)
    return (
        due.join(next_runs(due, now).withColumnRenamed("next_run", "_upcoming"), "schedule", "left")
        .where(F.col("_upcoming").isNull())
        .select(*SERVICE, F.lit("unreadable schedule").alias("reason"))
    )
