"""Feature-value series: distinct features, raw values, truncated values and binned means.

Functions work on all services at once; ``service`` narrows them to one.
"""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions.timewin import bin_microseconds, look_back, since, time_bin, window_minutes
from driftwatch.operators.joins import dimension_join, same_keys_join
from driftwatch.operators.slots import (
    SLOT_SECONDS,
    repeat_rows,
    shortest_series,
    slot_offsets,
    with_slot,
)
from driftwatch.schemas import SERIES, SERVICE
from driftwatch.session import pin

CHUNK_BINS = 100_000
#: Rows that one task orders, about.
PART_ROWS = 1_000_000


def of_service(df: DataFrame, service: dict | None) -> DataFrame:
    """Keep one service, given as ``{"repository": .., "name": .., "version": ..}``, or all."""
    for column, wanted in (service or {}).items():
        df = df.where(F.col(column) == F.lit(wanted))
    return df


def distinct_features(drift: DataFrame, service: dict | None = None) -> DataFrame:
    return of_service(drift, service).select(*SERIES).distinct()


def feature_values(
    drift: DataFrame, moment, service: dict | None = None, feature: str | None = None
) -> DataFrame:
    """Raw values since a moment, one row each: a filtered scan without any shuffle."""
    rows = of_service(drift, service).where(since("created_at", moment))
    if feature is not None:
        rows = rows.where(F.col("feature") == feature)
    return rows.select(*SERIES, "created_at", "value")


def with_positions(
    values: DataFrame, group: list[str] = SERIES, slot_seconds: int = SLOT_SECONDS
) -> DataFrame:
    """Adds ``position`` in the series, 1 being the newest; equal times put the larger value first.

    Equal rows are counted together before they are ordered, and told apart again after it, so an
    instant that many rows share costs as much as its distinct rows. The number of newer rows comes to a
    slot as a row ahead of the others, so they are dealt out and sorted once, with their key in them
    once. There are as many parts as rows fill.
    """
    counted = with_slot(values, slot_seconds).groupBy(*values.columns, "slot").agg(F.count(F.lit(1)).alias("n"))
    offsets = slot_offsets(counted, group, size=F.col("n"))
    ahead = offsets.select(*group, "slot", F.col("newer").alias("n"), F.lit(True).alias("_ahead"))
    rows = counted.withColumn("_ahead", F.lit(False)).unionByName(ahead, allowMissingColumns=True)
    parts = max(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(values.count() / PART_ROWS))
    others = [F.desc_nulls_last(c) for c in values.columns if c not in {*group, "created_at", "value"}]
    before = (
        Window.partitionBy(*group, "slot")
        .orderBy(F.desc("_ahead"), F.desc("created_at"), F.desc_nulls_last("value"), *others)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ordered = rows.repartition(parts, *group, "slot").withColumn("newer", F.sum("n").over(before)).where(~F.col("_ahead"))
    return repeat_rows(ordered, "n", number="position").select(
        *values.columns, (F.col("newer") + F.col("position")).cast("bigint").alias("position")
    )


def feature_series(
    values: DataFrame,
    group: list[str] = SERIES,
    chunk_rows: int = 100_000,
    slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """Raw series as parallel arrays, newest first.

    A series longer than ``chunk_rows`` continues in further rows: chunk 0 holds the newest values,
    and the chunks laid end to end are the whole series. Arrays thus stay bounded.
    """
    chunk = F.floor((F.col("position") - 1) / chunk_rows).cast("bigint")
    return ordered_arrays(
        with_positions(values, group, slot_seconds).withColumn("chunk", chunk),
        group + ["chunk"],
        ["created_at", "value"],
        order="position",
        newest_first=False,
    ).withColumnRenamed("value", "values")


def ordered_arrays(
    df: DataFrame, group: list[str], columns: list[str], order: str = "created_at", newest_first=True
) -> DataFrame:
    """Parallel arrays per group in ``order``, keeping NULL members.

    For groups of bounded size, such as the bins of a window.
    """
    entry = F.struct(order, *[c for c in columns if c != order])
    collected = df.groupBy(*group).agg(
        F.sort_array(F.collect_list(entry), asc=not newest_first).alias("_entries")
    )
    return collected.select(*group, *[F.col(f"_entries.{c}").alias(c) for c in columns])


def binned_arrays(
    bins: DataFrame, group: list[str], columns: list[str], width_us: int, chunk_bins: int = CHUNK_BINS
) -> DataFrame:
    """Parallel arrays of bins per group, newest bin first.

    Look-backs are open towards the future, so a group may have any number of bins. Those more than
    ``chunk_bins`` bin widths older than its newest bin continue in further rows, numbered by ``chunk``.
    """
    newest = F.max("created_at").over(Window.partitionBy(*group))
    age = F.unix_micros(newest) - F.unix_micros("created_at")
    chunk = F.floor(age / F.lit(width_us * chunk_bins)).cast("bigint")
    return ordered_arrays(bins.withColumn("chunk", chunk), group + ["chunk"], columns)


def truncated_values(
    values: DataFrame,
    service: list[str] = SERVICE,
    slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """Values with every series cut to the length of its service's shortest one, newest kept.

    One pass counts rows per slot and finds, per series, the slot where the cut falls. The second
    reads from the oldest cut on, and only its days where ``values`` has ``event_date``. Rows of newer
    slots pass through unmoved; only the cut slot is ordered, after equal rows have been counted
    together.
    """
    group = service + ["feature"]
    offsets = slot_offsets(with_slot(values.select(*group, "created_at"), slot_seconds), group)
    cuts = pin(
        same_keys_join(offsets, shortest_series(offsets, service), service)
        .where(F.col("newer") < F.col("keep"))
        .groupBy(*group)
        .agg(
            F.min("slot").alias("cut_slot"),
            (F.max("keep") - F.max("newer")).alias("room"),
        )
    )
    oldest = cuts.agg(F.min("cut_slot")).first()[0]
    if oldest is not None:
        start = F.timestamp_micros(F.lit(oldest * slot_seconds * 1_000_000))
        values = values.where(F.col("created_at") >= start)
        if "event_date" in values.columns:
            values = values.where(F.col("event_date") >= F.to_date(start))
    slotted = with_slot(values.select(*group, "created_at", "value"), slot_seconds)
    placed = dimension_join(slotted, cuts, group, spread_by=["created_at", "value"])
    kept = placed.where(F.col("slot") > F.col("cut_slot")).select(*group, "created_at", "value")

    newest_first = (
        Window.partitionBy(*group)
        .orderBy(F.desc("created_at"), F.desc_nulls_last("value"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    edge = (
        placed.where(F.col("slot") == F.col("cut_slot"))
        .groupBy(*group, "room", "created_at", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(newest_first), F.lit(0)))
        .withColumn("take", F.least(F.col("n"), F.col("room") - F.col("before")))
    )
    return kept.unionByName(repeat_rows(edge, "take").select(*group, "created_at", "value"))


def drift_records(
    drift: DataFrame,
    moment,
    service: dict | None = None,
    features: list[str] | None = None,
) -> DataFrame:
    """Raw values since a moment for the monitored features, cut to equal length per service.

    An absent or empty feature list means every feature.
    """
    values = of_service(drift, service).where(since("created_at", moment))
    if features:
        values = values.where(F.col("feature").isin(list(features)))
    return truncated_values(values)


def empty_features(wanted: DataFrame, values: DataFrame) -> DataFrame:
    """Series of ``wanted`` that have no values; they do not take part in the truncation."""
    key = F.struct(*SERIES).alias("key")
    found = values.select(key).distinct()
    return wanted.select(key).distinct().join(found, "key", "left_anti").select("key.*")


def binned_means(
    drift: DataFrame,
    width_us: int,
    minutes: int,
    now=None,
    service: dict | None = None,
    feature: str | None = None,
    until=None,
) -> DataFrame:
    """Mean value per bin and series. Partial means are formed before the shuffle."""
    rows = of_service(drift, service)
    if feature is not None:
        rows = rows.where(F.col("feature") == feature)
    return (
        rows.where(look_back("created_at", minutes, now, until))
        .groupBy(*SERIES, time_bin("created_at", width_us).alias("created_at"))
        .agg(F.avg("value").alias("value"))
    )


def binned_drift(
    drift: DataFrame,
    time_window: str,
    max_data_points: int,
    now=None,
    service: dict | None = None,
    feature: str | None = None,
    until=None,
) -> DataFrame:
    """Binned means of a named window, one row per bin."""
    minutes = window_minutes(time_window)
    return binned_means(
        drift, bin_microseconds(minutes, max_data_points), minutes, now, service, feature, until
    )


def binned_drift_series(drift: DataFrame, time_window: str, max_data_points: int, **options) -> DataFrame:
    """Binned means as parallel arrays per series, newest bin first; see ``binned_arrays`` for ``chunk``."""
    bins = binned_drift(drift, time_window, max_data_points, **options)
    width = bin_microseconds(window_minutes(time_window), max_data_points)
    return binned_arrays(bins, SERIES, ["created_at", "value"], width).withColumnRenamed("value", "values")
