"""Table and document schemas, and the keys that decide what counts as a duplicate.

Schemas are spelled out, never inferred: inference would read the data twice and could change from
one batch to the next.
"""

SERVICE = ["repository", "name", "version"]
SERIES = SERVICE + ["feature"]

DRIFT = (
    "created_at timestamp, name string, repository string, version string, "
    "feature string, value double"
)
DRIFT_KEY = ["created_at", "name", "repository", "feature", "value", "version"]

PROFILE = (
    "created_at timestamp, updated_at timestamp, name string, repository string, version string, "
    "profile string, active boolean, schedule string, next_run timestamp, previous_run timestamp, "
    "client_version string, drift_type string"
)

ALERT = (
    "created_at timestamp, name string, repository string, version string, feature string, "
    "alert map<string,string>, status string, id bigint, scheduled_at timestamp"
)

# The field names of the JSON documents that clients send.
ROUTE_METRIC = (
    "struct<route_name:string, "
    "metrics:struct<p5:double,p25:double,p50:double,p95:double,p99:double>, "
    "request_count:bigint, error_count:bigint, error_latency:double, "
    "status_codes:map<string,bigint>>"
)
SPC_RECORD = (
    "struct<created_at:string, name:string, repository:string, version:string, "
    "feature:string, value:double>"
)
OBSERVABILITY_RECORD = (
    "struct<name:string, repository:string, version:string, request_count:int, error_count:int, "
    f"route_metrics:array<{ROUTE_METRIC}>>"
)
MESSAGE = (
    "record_type string, records array<struct<"
    f"SPC:struct<record:{SPC_RECORD}>, OBSERVABILITY:struct<record:{OBSERVABILITY_RECORD}>>>"
)
FEATURE_LIMITS = (
    "struct<id:string, center:double, one_ucl:double, one_lcl:double, two_ucl:double, "
    "two_lcl:double, three_ucl:double, three_lcl:double, timestamp:string>"
)
PROFILE_DOCUMENT = (
    f"features map<string,{FEATURE_LIMITS}>, "
    "config struct<sample_size:int, sample:boolean, name:string, repository:string, "
    "version:string, alert_config:struct<dispatch_type:string, schedule:string, "
    "rule:struct<rule:string, zones_to_monitor:array<string>>, "
    "features_to_monitor:array<string>, dispatch_kwargs:map<string,string>>, "
    "targets:array<string>, drift_type:string>"
)

OBSERVABILITY = (
    "created_at timestamp, repository string, name string, version string, request_count int, "
    f"error_count int, route_metrics array<{ROUTE_METRIC}>"
)

# Rollups of which stored parts are added up: their keys, and the columns to sum.
BINS = (
    "repository string, name string, version string, feature string, width_us bigint, created_at timestamp, "
    "total double, n bigint"
)
REQUESTS = (
    "method string, path string, status string, le string, created_at timestamp, bucket_count bigint, "
    "latency_sum double"
)
ADDITIVE = {
    "bins": (SERIES + ["width_us", "created_at"], ["total", "n"]),
    "requests": (["method", "path", "status", "le", "created_at"], ["bucket_count", "latency_sum"]),
}

LIMIT_COLUMNS = [
    "center",
    "one_ucl",
    "one_lcl",
    "two_ucl",
    "two_lcl",
    "three_ucl",
    "three_lcl",
]

# Where a record came from: topic, partition and offset of its message, or file, 0 and line; and its
# place in the message. NULL where a client hands messages over itself.
ORIGIN = ["source", "source_part", "source_position", "record"]
ORIGIN_TYPES = "source string, source_part int, source_position bigint, record int"

# Widest text each column takes.
MAX_TEXT = 256
