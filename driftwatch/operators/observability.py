"""Rollups of route metrics and of a request log."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.timewin import bin_microseconds, look_back, time_bin, window_minutes
from driftwatch.operators.series import binned_arrays, of_service
from driftwatch.schemas import SERVICE

PERCENTILES = ["p5", "p25", "p50", "p95", "p99"]

# Upper bounds of the latency histogram, in seconds.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def route_measures(
    observability: DataFrame, width_us: int, minutes: int, now=None, service=None, until=None
) -> DataFrame:
    """One row per record and route in the window, with its bin. Records without routes vanish."""
    return (
        of_service(observability, service)
        .where(look_back("created_at", minutes, now, until))
        .select(
            *SERVICE,
            time_bin("created_at", width_us).alias("created_at"),
            F.explode("route_metrics").alias("r"),
        )
        .select(
            *SERVICE,
            "created_at",
            F.col("r.route_name").alias("route_name"),
            *[F.col(f"r.metrics.{p}").alias(p) for p in PERCENTILES],
            F.col("r.request_count").alias("request_count"),
            F.col("r.error_count").alias("error_count"),
            F.col("r.error_latency").alias("error_latency"),
            F.col("r.status_codes").alias("status_codes"),
        )
    )


def route_bins(measures: DataFrame) -> DataFrame:
    """Means, totals and status counts per (service, route, bin), in one pass over the measures.

    Every measure yields one row with its metrics and one row per status code; grouping by status
    first lets sums of both kinds form before the shuffle, and spares a join of two aggregates of
    the same input. A bin without status codes has an empty list.
    """
    key = SERVICE + ["route_name", "created_at"]
    averaged = PERCENTILES + ["error_latency"]
    summed = ["request_count", "error_count"]
    metrics = F.struct(
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("bigint").alias("hits"),
        *[F.col(c) for c in averaged + summed],
    )
    codes = F.transform(
        F.map_entries("status_codes"),
        lambda e: F.struct(
            e["key"].alias("status"),
            e["value"].alias("hits"),
            *[F.lit(None).cast("double").alias(c) for c in averaged],
            *[F.lit(None).cast("bigint").alias(c) for c in summed],
        ),
    )
    no_codes = F.array().cast(
        "array<struct<status:string,hits:bigint,"
        + ",".join(f"{c}:double" for c in averaged)
        + ","
        + ",".join(f"{c}:bigint" for c in summed)
        + ">>"
    )
    parts = F.concat(F.array(metrics), F.coalesce(codes, no_codes))
    by_status = (
        measures.select(*key, F.explode(parts).alias("m"))
        .groupBy(*key, F.col("m.status").alias("status"))
        .agg(
            F.sum("m.hits").alias("count"),
            *[F.avg(f"m.{c}").alias(c) for c in averaged],
            *[F.sum(f"m.{c}").alias(c) for c in summed],
        )
    )
    # Per bin there is one row of metrics, the one without status; max() merely picks it.
    own = F.col("status").isNull()
    return by_status.groupBy(*key).agg(
        *[F.max(F.when(own, F.col(p))).alias(p) for p in PERCENTILES],
        F.max(F.when(own, F.col("request_count"))).alias("total_request_count"),
        F.max(F.when(own, F.col("error_count"))).alias("total_error_count"),
        F.max(F.when(own, F.col("error_latency"))).alias("error_latency"),
        F.sort_array(
            F.collect_list(F.when(~own, F.struct("status", "count")))
        ).alias("status_counts"),
    )


def binned_routes(
    observability: DataFrame,
    time_window: str,
    max_data_points: int,
    now=None,
    service=None,
    until=None,
) -> DataFrame:
    """One row per route and bin; ``status_counts`` is an array of (status, count)."""
    minutes = window_minutes(time_window)
    width = bin_microseconds(minutes, max_data_points)
    return route_bins(route_measures(observability, width, minutes, now, service, until))


def binned_routes_series(observability: DataFrame, time_window: str, max_data_points: int, **options) -> DataFrame:
    """One row per route with ten parallel arrays, newest bin first; status counts become maps.

    See ``binned_arrays`` for ``chunk``.
    """
    columns = (
        ["created_at"]
        + PERCENTILES
        + ["total_request_count", "total_error_count", "error_latency", "status_counts"]
    )
    series = binned_arrays(
        binned_routes(observability, time_window, max_data_points, **options),
        SERVICE + ["route_name"],
        columns,
        bin_microseconds(window_minutes(time_window), max_data_points),
    )
    return series.withColumn(
        "status_counts", F.transform("status_counts", lambda s: F.map_from_entries(s))
    )


def request_rollup(requests: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Request count, latency sum and cumulative latency buckets per (method, path, status)."""
    labels = ["method", "path", "status"] + (extra or [])
    return requests.groupBy(*labels).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("latency").alias("latency_sum"),
        *[F.count_if(F.col("latency") <= b).alias(f"le_{b}") for b in LATENCY_BOUNDS],
    )


def request_histogram(requests: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The rollup with one row per bucket; ``+Inf`` counts every request."""
    labels = ["method", "path", "status"] + (extra or [])
    buckets = [
        F.struct(F.lit(str(b)).alias("le"), F.col(f"`le_{b}`").alias("bucket_count"))
        for b in LATENCY_BOUNDS
    ] + [F.struct(F.lit("+Inf").alias("le"), F.col("requests").alias("bucket_count"))]
    return (
        request_rollup(requests, extra)
        .select(*labels, "requests", "latency_sum", F.explode(F.array(*buckets)).alias("b"))
        .select(*labels, "requests", "latency_sum", "b.le", "b.bucket_count")
    )
