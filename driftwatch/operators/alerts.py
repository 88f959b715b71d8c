"""The alert log."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.timewin import as_timestamp, since
from driftwatch.operators.numbering import number_rows
from driftwatch.operators.series import of_service
from driftwatch.schemas import SERVICE
from driftwatch.session import pin

ACTIVE = "active"
_IDENTITY = SERVICE + ["feature", "scheduled_at", "_zone", "_kind"]


def _with_identity(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("_zone", F.try_element_at("alert", F.lit("zone"))).withColumn(
        "_kind", F.try_element_at("alert", F.lit("kind"))
    )


def new_alerts(
    existing: DataFrame, raised: DataFrame, created_at, start: int | Callable[[int], int] | None = None
) -> DataFrame:
    """Alert rows to append for what a run raised.

    Ids follow ``start``, the last one given out: a number, or a function that takes as many new ids
    as there are alerts and returns the id before them.

    ``raised`` has the service, ``feature``, ``zone``, ``kind`` and ``scheduled_at``, the instant the
    run was due. Running the same check again raises the same keys and appends nothing.
    """
    rows = raised.select(
        as_timestamp(created_at).alias("created_at"),
        "name",
        "repository",
        "version",
        "feature",
        F.create_map(
            F.lit("zone"), "zone", F.lit("kind"), "kind", F.lit("feature"), "feature"
        ).alias("alert"),
        F.lit(ACTIVE).alias("status"),
        "scheduled_at",
    )
    known = _with_identity(existing).select(*_IDENTITY)
    fresh = _with_identity(rows).join(known, _IDENTITY, "left_anti")
    # Numbering uses its input twice. Alerts are few, the check that raises them is not repeated.
    fresh = pin(fresh)
    if start is None:
        start = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    elif callable(start):
        start = start(fresh.count())
    return number_rows(fresh, _IDENTITY, "id", start).select(*existing.columns)


def insert_alert(
    existing: DataFrame, service: dict, feature: str, alert: dict, created_at, start: int | None = None
) -> DataFrame:
    """The log with one more alert, for callers that raise alerts themselves. ``start`` is the last id
    given out, if it is known."""
    if start is None:
        start = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    spark = existing.sparkSession
    row = spark.range(1).select(
        as_timestamp(created_at).alias("created_at"),
        *[F.lit(service[c]).alias(c) for c in SERVICE],
        F.lit(feature).alias("feature"),
        F.create_map(*[F.lit(x) for pair in sorted(alert.items()) for x in pair]).alias("alert"),
        F.lit(ACTIVE).alias("status"),
        F.lit(start + 1).cast("bigint").alias("id"),
        F.lit(None).cast("timestamp").alias("scheduled_at"),
    )
    return existing.unionByName(row)


def query_alerts(
    alerts: DataFrame,
    service: dict | None = None,
    active: bool | None = None,
    limit_timestamp=None,
    limit: int | None = None,
) -> DataFrame:
    """Alerts, newest first. ``active`` false or absent means any status; the time bound is inclusive."""
    rows = of_service(alerts, service)
    if active:
        rows = rows.where(F.col("status") == ACTIVE)
    if limit_timestamp is not None:
        rows = rows.where(since("created_at", limit_timestamp, inclusive=True))
    rows = rows.orderBy(F.desc("created_at"), F.desc("id"))
    return rows if limit is None else rows.limit(limit)


def read_alert_maps(alerts: DataFrame, column: str = "alert") -> DataFrame:
    """Alert text to a map of strings; text that cannot be read gives an empty map."""
    parsed = F.from_json(column, "map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    return alerts.withColumn(column, F.coalesce(parsed, empty))
