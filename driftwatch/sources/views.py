"""Monitoring data derived from general-purpose tables.

The library's inputs are drift values, profiles, route metrics, request logs, alerts and messages.
These views derive all of them from ``events`` and ``lineitem``, row by row where possible, so that
queries over them work on every row of those tables.
"""

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.session import use_utc

# Zone-less timestamps in the files are UTC; reading them as such keeps filters pushable.
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
LINEITEM = (
    "l_orderkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp"
)


def _utc(*parts: int) -> dt.datetime:
    return dt.datetime(*parts, tzinfo=dt.timezone.utc)


# "Now" lies before the last events, so look-backs also meet rows from the future.
NOW = _utc(2024, 1, 30)
CHECK_TIME = _utc(2024, 1, 31, 0, 0, 30)
BASELINE_END = _utc(2024, 1, 8)
RULE = "8 16 4 8 2 4 1 1"

# Schedules of the per-user profiles, by user_id modulo their number.
SCHEDULES = [
    "0 0 0 * * *",
    "0 0 * * * *",
    "0 */15 * * * *",
    "0 30 6 * * MON",
    "0 0 12 1 * ?",
    "0 0 0 29 2 *",
]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return use_utc(spark).read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return use_utc(spark).read.schema(LINEITEM).parquet(f"{sf_dir}/lineitem.parquet")


def k_of(props: str = "props") -> Column:
    return F.get_json_object(props, "$.k").cast("int")


def _repository() -> Column:
    return F.concat(F.lit("repo_"), (F.col("user_id") % 3).cast("string"))


def to_drift(source: DataFrame) -> DataFrame:
    """Each event is a value of the feature named after its type."""
    return source.select(
        F.col("ts").alias("created_at"),
        F.lit("app").alias("name"),
        _repository().alias("repository"),
        F.lit("1.0.0").alias("version"),
        F.col("event_type").alias("feature"),
        "value",
    )


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_drift(events(spark, sf_dir))


def lineitem_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four numeric columns as features; thousands of rows share each instant."""
    values = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"l_{c}").alias("value"))
            for c in ("quantity", "extendedprice", "discount", "tax")
        ]
    )
    return (
        lineitem(spark, sf_dir)
        .select(
            F.col("l_shipdate").alias("created_at"),
            F.lit("lineitem").alias("name"),
            F.concat(F.lit("flag_"), "l_returnflag").alias("repository"),
            F.lit("1.0.0").alias("version"),
            F.explode(values).alias("v"),
        )
        .select("created_at", "name", "repository", "version", "v.feature", "v.value")
    )


def baseline_profiles(
    values: DataFrame, baseline_end, previous_run, next_run, monitored: list[str] | None = None
) -> DataFrame:
    """One active profile per service, with limits from the values before ``baseline_end``."""
    key = ["repository", "name", "version"]
    stats = (
        values.where(F.col("created_at") < F.lit(baseline_end))
        .groupBy(*key, "feature")
        .agg(
            F.round(F.avg("value"), 4).alias("center"),
            F.round(F.stddev_samp("value"), 4).alias("sd"),
        )
    )
    limits = F.struct(
        F.col("feature").alias("id"),
        "center",
        *[
            (F.col("center") + sign * sigma * F.col("sd")).alias(f"{word}_{side}")
            for sigma, word in ((1, "one"), (2, "two"), (3, "three"))
            for sign, side in ((1, "ucl"), (-1, "lcl"))
        ],
    )
    # A service has a handful of features, so its document stays small.
    documents = stats.groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", limits))).alias("features")
    )
    config = F.struct(
        F.lit(25).alias("sample_size"),
        F.lit(True).alias("sample"),
        *key,
        F.struct(
            F.lit("Console").alias("dispatch_type"),
            F.lit("0 0 0 * * *").alias("schedule"),
            F.struct(
                F.lit(RULE).alias("rule"),
                F.array(*[F.lit(f"Zone {z}") for z in range(1, 5)]).alias("zones_to_monitor"),
            ).alias("rule"),
            F.array(*[F.lit(f) for f in monitored or []]).cast("array<string>").alias("features_to_monitor"),
        ).alias("alert_config"),
        F.lit("SPC").alias("drift_type"),
    )
    return documents.select(
        F.lit(baseline_end).alias("created_at"),
        F.lit(baseline_end).alias("updated_at"),
        "name",
        "repository",
        "version",
        F.to_json(F.struct("features", config.alias("config"))).alias("profile"),
        F.lit(True).alias("active"),
        F.lit("0 0 0 * * *").alias("schedule"),
        F.lit(next_run).alias("next_run"),
        F.lit(previous_run).alias("previous_run"),
        F.lit("0.1.0").alias("client_version"),
        F.lit("SPC").alias("drift_type"),
    )


def service_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline_profiles(
        drift(spark, sf_dir),
        BASELINE_END,
        previous_run=BASELINE_END,
        next_run=_utc(2024, 1, 30),
        monitored=["click", "error", "purchase", "view"],
    )


def lineitem_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline_profiles(
        lineitem_drift(spark, sf_dir),
        _utc(1996, 1, 1),
        previous_run=_utc(1996, 1, 1),
        next_run=_utc(2001, 1, 1),
    )


def schedule_of(user_id: str = "user_id") -> Column:
    return F.array(*[F.lit(s) for s in SCHEDULES])[(F.col(user_id) % len(SCHEDULES)).cast("int")]


def user_document(sample_size: Column) -> Column:
    """A profile document for the model of one user."""
    return F.to_json(
        F.struct(
            F.create_map().cast("map<string,struct<center:double>>").alias("features"),
            F.struct(
                sample_size.alias("sample_size"),
                _repository().alias("repository"),
                F.concat(F.lit("model_"), F.col("user_id").cast("string")).alias("name"),
                F.lit("1.0.0").alias("version"),
                F.struct(schedule_of().alias("schedule")).alias("alert_config"),
            ).alias("config"),
            F.lit("0.3.1").alias("client_version"),
        )
    )


def user_profiles(source: DataFrame) -> DataFrame:
    """A stored profile per user, with run dates taken from the user's events."""
    users = source.groupBy("user_id").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("next_run")
    )
    return users.select(
        "created_at",
        F.col("created_at").alias("updated_at"),
        F.concat(F.lit("model_"), F.col("user_id").cast("string")).alias("name"),
        _repository().alias("repository"),
        F.lit("1.0.0").alias("version"),
        user_document(F.lit(0).cast("bigint")).alias("profile"),
        (F.col("user_id") % 4 != 0).alias("active"),
        schedule_of().alias("schedule"),
        "next_run",
        F.col("created_at").alias("previous_run"),
        F.lit("0.1.0").alias("client_version"),
        F.when(F.col("user_id") % 10 == 9, "OTHER").otherwise("SPC").alias("drift_type"),
    )


def profile_requests(source: DataFrame) -> DataFrame:
    """Each event asks for a profile of its user's model; the event number is the arrival order."""
    return source.select(
        _repository().alias("repository"),
        F.concat(F.lit("model_"), F.col("user_id").cast("string")).alias("name"),
        F.lit("1.0.0").alias("version"),
        user_document(F.col("event_id")).alias("profile"),
        F.lit("SPC").alias("drift_type"),
        (F.col("event_type") == "click").alias("active"),
        "event_type",
        "user_id",
        F.col("event_id").alias("arrival"),
    )


def status_codes() -> Column:
    """A status-code map per event: always 200, sometimes 404 and 500."""
    k = k_of().cast("bigint")
    none = F.lit(None).cast("struct<key:string,value:bigint>")
    entry = lambda code, n: F.struct(F.lit(code).alias("key"), n.alias("value"))
    return F.map_from_entries(
        F.array_compact(
            F.array(
                entry("200", k + 1),
                F.when(k % 10 == 0, entry("404", k + 2)).otherwise(none),
                F.when(F.col("event_type") == "error", entry("500", F.lit(3).cast("bigint"))).otherwise(none),
            )
        )
    )


def route_metrics() -> Column:
    """Two routes per event: one named after its type, and a health check without status codes."""
    k = k_of().cast("bigint")
    zero = F.lit(0).cast("bigint")
    factors = {"p5": 0.5, "p25": 0.75, "p50": 1.0, "p95": 1.5, "p99": 2.0}
    route = F.struct(
        F.concat(F.lit("/"), "event_type").alias("route_name"),
        F.struct(*[(F.col("value") * f).alias(p) for p, f in factors.items()]).alias("metrics"),
        (k + 10).alias("request_count"),
        (k % 5).alias("error_count"),
        (F.col("value") / 10).alias("error_latency"),
        status_codes().alias("status_codes"),
    )
    health = F.struct(
        F.lit("/health").alias("route_name"),
        F.struct(*[(F.col("value") * 0.25).alias(p) for p in factors]).alias("metrics"),
        F.lit(1).cast("bigint").alias("request_count"),
        zero.alias("error_count"),
        F.lit(0.0).alias("error_latency"),
        F.create_map().cast("map<string,bigint>").alias("status_codes"),
    )
    return F.array(route, health)


def observability(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = k_of()
    return events(spark, sf_dir).select(
        F.col("ts").alias("created_at"),
        _repository().alias("repository"),
        F.lit("app").alias("name"),
        F.lit("1.0.0").alias("version"),
        (k + 11).alias("request_count"),
        (k % 5).alias("error_count"),
        route_metrics().alias("route_metrics"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = k_of()
    return events(spark, sf_dir).select(
        F.when(F.col("event_type").isin("signup", "purchase"), "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("/"), "event_type").alias("path"),
        F.when(F.col("event_type") == "error", "500")
        .when(k % 10 == 0, "404")
        .otherwise("200")
        .alias("status"),
        (F.col("value") / 50).alias("latency"),
        F.col("ts").alias("created_at"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an alert of its service, with zone and kind from its payload."""
    k = k_of()
    zone = F.concat(F.lit("Zone "), (k % 4 + 1).cast("string"))
    kind = F.when(k % 2 == 0, "Consecutive").otherwise("Alternating")
    return events(spark, sf_dir).select(
        F.col("ts").alias("created_at"),
        F.lit("app").alias("name"),
        _repository().alias("repository"),
        F.lit("1.0.0").alias("version"),
        F.col("event_type").alias("feature"),
        F.create_map(
            F.lit("zone"), zone, F.lit("kind"), kind, F.lit("feature"), F.col("event_type")
        ).alias("alert"),
        F.when(k < 50, "active").otherwise("acknowledged").alias("status"),
        F.col("event_id").alias("id"),
        F.date_trunc("day", "ts").alias("scheduled_at"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a JSON message, good or bad depending on its type and payload.

    Errors become route metrics, sign-ups become various bad messages, all others feature values:
    one named after the type, one for the payload.
    """
    k = k_of()
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

    def spc(created_at: Column, feature: Column, value: Column) -> Column:
        return F.struct(
            F.struct(
                F.struct(
                    created_at.alias("created_at"),
                    F.lit("app").alias("name"),
                    _repository().alias("repository"),
                    F.lit("1.0.0").alias("version"),
                    feature.alias("feature"),
                    value.alias("value"),
                ).alias("record")
            ).alias("SPC")
        )

    def envelope(record_type: str, *records: Column) -> Column:
        return F.to_json(
            F.struct(F.lit(record_type).alias("record_type"), F.array(*records).alias("records"))
        )

    def route_record(request_count: Column) -> Column:
        record = F.struct(
            F.lit("app").alias("name"),
            _repository().alias("repository"),
            F.lit("1.0.0").alias("version"),
            request_count.alias("request_count"),
            (k % 5).alias("error_count"),
            route_metrics().alias("route_metrics"),
        )
        return F.struct(F.struct(record.alias("record")).alias("OBSERVABILITY"))

    route = route_record(k + 11)
    overflowing = route_record(F.lit(3_000_000_000))
    values = envelope(
        "SPC",
        spc(stamp, F.col("event_type"), F.col("value")),
        spc(stamp, F.concat("event_type", F.lit("_k")), k.cast("double")),
    )
    signup = F.col("event_type") == "signup"
    text = (
        F.when(F.col("event_type") == "error", envelope("OBSERVABILITY", route))
        .when(signup & (k < 20), F.concat(F.lit("{bad "), F.col("event_id").cast("string")))
        .when(signup & (k < 40), envelope("PSI", spc(stamp, F.col("event_type"), F.col("value"))))
        .when(signup & (k < 60), envelope("SPC", route))
        .when(signup & (k < 70), envelope("SPC", spc(F.lit("yesterday"), F.col("event_type"), F.col("value"))))
        .when(signup & (k < 74), envelope("SPC", spc(stamp, F.lit(None).cast("string"), F.col("value"))))
        .when(signup & (k < 77), envelope("SPC", spc(stamp, F.col("event_type"), F.lit("abc"))))
        .when(signup & (k < 80), envelope("OBSERVABILITY", overflowing))
        .otherwise(values)
    )
    return events(spark, sf_dir).select(text.alias("value"), F.col("ts").alias("timestamp"))
