"""The same queries as ANSI SQL over the test tables, for an independent check in DuckDB."""

_SERVICE = "repository, name, version"
_SERIES = f"{_SERVICE}, feature"

_DRIFT = """drift AS (
  SELECT ts AS created_at, 'app' AS name, 'repo_' || CAST(user_id % 3 AS VARCHAR) AS repository,
         '1.0.0' AS version, event_type AS feature, value
  FROM events)"""

_LINEITEM_DRIFT = """wide AS (
  SELECT l_shipdate AS created_at, 'lineitem' AS name, 'flag_' || l_returnflag AS repository,
         '1.0.0' AS version,
         unnest(['quantity', 'extendedprice', 'discount', 'tax']) AS feature,
         unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value
  FROM lineitem)"""

_EVENTS_K = """ek AS (
  SELECT *, 'repo_' || CAST(user_id % 3 AS VARCHAR) AS repository, 'app' AS name,
         '1.0.0' AS version, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""

_ONE = "repository = 'repo_1' AND name = 'app' AND version = '1.0.0'"
_EPOCH = "TIMESTAMP '1970-01-01'"
_NOW = "TIMESTAMP '2024-01-30'"
_CHECK = "TIMESTAMP '2024-01-31 00:00:30'"
_SINCE = "TIMESTAMP '2024-01-28'"
_BASELINE = "TIMESTAMP '2024-01-08'"
_LINEITEM_BASELINE = "TIMESTAMP '1996-01-01'"


def _bin(width_us: int) -> str:
    return f"time_bucket(to_microseconds({width_us}), created_at, {_EPOCH})"


def _truncated(source: str, where: str) -> str:
    return f"""
ranked AS (
  SELECT {_SERIES}, created_at, value,
         row_number() OVER (PARTITION BY {_SERIES} ORDER BY created_at DESC, value DESC NULLS LAST) AS rn,
         count(*) OVER (PARTITION BY {_SERIES}) AS total
  FROM {source} WHERE {where}),
cut AS (
  SELECT {_SERIES}, created_at, value FROM (
    SELECT *, min(total) OVER (PARTITION BY {_SERVICE}) AS keep FROM ranked)
  WHERE rn <= keep)"""


_ROUTES = """routes AS (
  SELECT ts AS created_at, repository, name, version, '/' || event_type AS route_name,
         value * 0.5 AS p5, value * 0.75 AS p25, value * 1.0 AS p50, value * 1.5 AS p95,
         value * 2.0 AS p99, k + 10 AS request_count, k % 5 AS error_count,
         value / 10 AS error_latency, k, event_type
  FROM ek
  UNION ALL
  SELECT ts, repository, name, version, '/health', value * 0.25, value * 0.25, value * 0.25,
         value * 0.25, value * 0.25, 1, 0, 0.0, NULL, NULL
  FROM ek),
codes AS (
  SELECT created_at, repository, name, version, route_name, '200' AS status, k + 1 AS hits
  FROM routes WHERE k IS NOT NULL
  UNION ALL
  SELECT created_at, repository, name, version, route_name, '404', k + 2
  FROM routes WHERE k % 10 = 0
  UNION ALL
  SELECT created_at, repository, name, version, route_name, '500', 3
  FROM routes WHERE event_type = 'error')"""


def _route_bins(width_us: int, minutes: int) -> str:
    window = f"created_at > {_NOW} - INTERVAL {minutes} MINUTE"
    return f"""
metrics AS (
  SELECT {_SERVICE}, route_name, {_bin(width_us)} AS bin,
         avg(p5) AS p5, avg(p25) AS p25, avg(p50) AS p50, avg(p95) AS p95, avg(p99) AS p99,
         CAST(sum(request_count) AS BIGINT) AS total_request_count,
         CAST(sum(error_count) AS BIGINT) AS total_error_count,
         avg(error_latency) AS error_latency
  FROM routes WHERE {window} GROUP BY ALL),
statuses AS (
  SELECT {_SERVICE}, route_name, {_bin(width_us)} AS bin, status, CAST(sum(hits) AS BIGINT) AS count
  FROM codes WHERE {window} GROUP BY ALL)"""


_REQUESTS = """requests AS (
  SELECT CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END AS method,
         '/' || event_type AS path,
         CASE WHEN event_type = 'error' THEN '500' WHEN k % 10 = 0 THEN '404' ELSE '200' END AS status,
         value / 50 AS latency
  FROM ek)"""

# Upper bounds of the latency histogram, in seconds.
_BOUNDS = ["0.005", "0.01", "0.025", "0.05", "0.1", "0.25", "0.5", "1.0", "2.5", "5.0", "10.0"]

_BUCKETS = " UNION ALL ".join(
    [
        f"SELECT method, path, status, '{b}' AS le, count(*) FILTER (latency <= {b}) AS bucket_count "
        "FROM requests GROUP BY ALL"
        for b in _BOUNDS
    ]
    + ["SELECT method, path, status, '+Inf', count(*) FROM requests GROUP BY ALL"]
)


def _limits(source: str, baseline_end: str) -> str:
    sides = ", ".join(
        f"center {sign} {n} * sd AS {word}_{side}"
        for n, word in ((1, "one"), (2, "two"), (3, "three"))
        for sign, side in (("+", "ucl"), ("-", "lcl"))
    )
    return f"""
stats AS (
  SELECT {_SERIES}, round(avg(value), 4) AS center, round(stddev_samp(value), 4) AS sd
  FROM {source} WHERE created_at < {baseline_end} GROUP BY ALL),
limits AS (SELECT {_SERIES}, center, {sides} FROM stats)"""


_ZONE = """CASE WHEN value IS NULL OR isnan(value) THEN NULL
  WHEN value > three_ucl THEN 4 WHEN value < three_lcl THEN -4 WHEN value >= two_ucl THEN 3
  WHEN value >= one_ucl THEN 2 WHEN value > center THEN 1 WHEN value <= two_lcl THEN -3
  WHEN value <= one_lcl THEN -2 WHEN value < center THEN -1 ELSE 0 END"""


def _samples(source: str, since: str, features: str = "") -> str:
    """Samples cut to the shortest series of their service, with codes."""
    return f"""
samples AS (
  SELECT d.repository, d.name, d.version, d.feature, d.created_at, d.value,
         CAST({_ZONE} AS INTEGER) AS code
  FROM {source} d JOIN limits USING ({_SERIES})
  WHERE created_at > {since} {features}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {_SERIES} ORDER BY created_at DESC, value DESC NULLS LAST) AS rn,
         count(*) OVER (PARTITION BY {_SERIES}) AS total
  FROM samples),
kept AS (
  SELECT * FROM (SELECT *, min(total) OVER (PARTITION BY {_SERVICE}) AS keep FROM ranked) WHERE rn <= keep)"""


_RUNS = f"""
marked AS (
  SELECT *, lag(code) OVER w AS previous FROM kept WINDOW w AS (PARTITION BY {_SERIES} ORDER BY rn)),
islands AS (
  SELECT *,
    sum(CASE WHEN code = previous THEN 0 ELSE 1 END)
      OVER (PARTITION BY {_SERIES} ORDER BY rn ROWS UNBOUNDED PRECEDING) AS run,
    sum(CASE WHEN code = -previous AND code <> 0 THEN 0 ELSE 1 END)
      OVER (PARTITION BY {_SERIES} ORDER BY rn ROWS UNBOUNDED PRECEDING) AS chain
  FROM marked),
runs AS (
  SELECT {_SERIES}, 'Consecutive' AS kind, CAST(abs(code) AS INTEGER) AS zone, max(n) AS longest
  FROM (SELECT {_SERIES}, run, code, count(*) AS n FROM islands GROUP BY ALL)
  WHERE abs(code) BETWEEN 1 AND 4 GROUP BY {_SERIES}, abs(code)
  UNION ALL
  SELECT {_SERIES}, 'Alternating' AS kind, CAST(zone AS INTEGER) AS zone, max(n) AS longest
  FROM (SELECT {_SERIES}, chain, abs(code) AS zone, count(*) AS n FROM islands GROUP BY ALL)
  WHERE zone BETWEEN 1 AND 4 GROUP BY {_SERIES}, zone),
rule AS (
  SELECT * FROM (VALUES
    ('Consecutive', 1, 8), ('Alternating', 1, 16), ('Consecutive', 2, 4), ('Alternating', 2, 8),
    ('Consecutive', 3, 2), ('Alternating', 3, 4), ('Consecutive', 4, 1), ('Alternating', 4, 2))
    AS r(kind, zone, needed)),
raised AS (
  SELECT {_SERIES}, 'Zone ' || CAST(zone AS VARCHAR) AS zone, kind
  FROM runs JOIN rule USING (kind, zone) WHERE longest >= needed)"""

_MONITORED = "AND feature IN ('click', 'error', 'purchase', 'view')"
_EVENT_CHECK = (
    f"WITH {_DRIFT}, {_limits('drift', _BASELINE)}, {_samples('drift', _BASELINE, _MONITORED)}"
)
_LINEITEM_CHECK = (
    f"WITH {_LINEITEM_DRIFT}, {_limits('wide', _LINEITEM_BASELINE)}, "
    + _samples("wide", _LINEITEM_BASELINE)
)

_USERS = """users AS (
  SELECT user_id, 'repo_' || CAST(user_id % 3 AS VARCHAR) AS repository,
         'model_' || CAST(user_id AS VARCHAR) AS name, '1.0.0' AS version,
         user_id % 4 <> 0 AS active, min(ts) AS previous_run, max(ts) AS next_run,
         CASE WHEN user_id % 10 = 9 THEN 'OTHER' ELSE 'SPC' END AS drift_type,
         CASE user_id % 6 WHEN 0 THEN '0 0 0 * * *' WHEN 1 THEN '0 0 * * * *'
           WHEN 2 THEN '0 */15 * * * *' WHEN 3 THEN '0 30 6 * * MON'
           WHEN 4 THEN '0 0 12 1 * ?' ELSE '0 0 0 29 2 *' END AS schedule
  FROM events GROUP BY user_id)"""

# First instant of each schedule after the time of the check, a Wednesday just past midnight.
_UPCOMING = f"""upcoming AS (
  SELECT DISTINCT schedule, CASE user_id % 6
    WHEN 0 THEN date_trunc('day', {_CHECK}) + INTERVAL 1 DAY
    WHEN 1 THEN date_trunc('hour', {_CHECK}) + INTERVAL 1 HOUR
    WHEN 2 THEN time_bucket(INTERVAL 15 MINUTE, {_CHECK}, {_EPOCH}) + INTERVAL 15 MINUTE
    WHEN 3 THEN CAST(date_trunc('week', {_CHECK}) AS TIMESTAMP) + INTERVAL 7 DAY + INTERVAL 390 MINUTE
    WHEN 4 THEN CAST(date_trunc('month', {_CHECK}) AS TIMESTAMP) + INTERVAL 1 MONTH + INTERVAL 12 HOUR
    ELSE TIMESTAMP '2024-02-29' END AS upcoming
  FROM users)"""

_MESSAGES = """messages AS (
  SELECT *, CASE
    WHEN event_type = 'error' THEN 'routes'
    WHEN event_type <> 'signup' OR k >= 80 THEN 'values'
    WHEN k < 20 THEN 'malformed' WHEN k < 40 THEN 'unsupported_type'
    WHEN k < 60 THEN 'wrong_variant' WHEN k < 70 THEN 'bad_timestamp'
    WHEN k < 74 THEN 'missing_field' ELSE 'malformed' END AS fate
  FROM ek),
decoded AS (
  SELECT ts AS created_at, name, repository, version, event_type AS feature, value
  FROM messages WHERE fate = 'values'
  UNION ALL
  SELECT ts, name, repository, version, event_type || '_k', CAST(k AS DOUBLE)
  FROM messages WHERE fate = 'values')"""

_NULL_KEYED = f"""keyed AS (
  SELECT created_at, name, repository, version, feature,
         CASE WHEN feature <> 'signup' THEN value END AS value FROM drift)"""


ORACLE = {
    "distinct_features": f"WITH {_DRIFT} SELECT DISTINCT {_SERIES} FROM drift",
    "feature_values_since": f"""WITH {_DRIFT}
        SELECT {_SERIES}, created_at, value FROM drift
        WHERE {_ONE} AND feature = 'click' AND created_at > {_SINCE}""",
    "feature_values_positions": f"""WITH {_DRIFT}
        SELECT {_SERIES}, created_at, value,
               row_number() OVER (PARTITION BY {_SERIES} ORDER BY created_at DESC, value DESC) AS position
        FROM drift WHERE created_at > {_BASELINE}""",
    "feature_series_chunks": f"""WITH {_DRIFT},
        placed AS (
          SELECT *, row_number() OVER (PARTITION BY {_SERIES} ORDER BY created_at DESC, value DESC) AS p
          FROM drift)
        SELECT {_SERIES}, CAST((p - 1) // 500 AS BIGINT) AS chunk, (p - 1) % 500 AS at, created_at, value
        FROM placed""",
    "lineitem_positions": f"""WITH {_LINEITEM_DRIFT},
        placed AS (
          SELECT *, row_number() OVER (PARTITION BY {_SERIES} ORDER BY created_at DESC, value DESC) AS p
          FROM wide)
        SELECT {_SERIES}, created_at, value, min(p) AS first, max(p) AS last, count(*) AS n
        FROM placed GROUP BY ALL""",
    "drift_records_truncated": f"WITH {_DRIFT}, {_truncated('drift', f'created_at > {_BASELINE}')} SELECT * FROM cut",
    "drift_records_monitored": f"""WITH {_DRIFT},
        {_truncated('drift', f"created_at > {_SINCE} AND {_ONE} AND feature IN ('click', 'error', 'view')")}
        SELECT * FROM cut""",
    "lineitem_records_truncated": f"""WITH {_LINEITEM_DRIFT}, {_truncated('wide', 'true')}
        SELECT {_SERIES}, created_at, count(*) AS n, min(value) AS smallest, round(sum(value), 2) AS total
        FROM cut GROUP BY ALL""",
    "binned_feature_values": f"""WITH {_DRIFT}
        SELECT {_SERIES}, {_bin(round(1440 * 60e6 / 7))} AS created_at, round(avg(value), 6) AS value
        FROM drift WHERE {_ONE} AND feature = 'click'
          AND created_at > {_NOW} - INTERVAL 1440 MINUTE GROUP BY {_SERIES}, 5""",
    "binned_drift_records": f"""WITH {_DRIFT}
        SELECT {_SERIES}, {_bin(432_000_000)} AS created_at, round(avg(value), 6) AS value
        FROM drift WHERE created_at > {_NOW} - INTERVAL 7200 MINUTE GROUP BY {_SERIES}, 5""",
    "binned_fractional": f"""WITH {_DRIFT}
        SELECT {_SERIES}, {_bin(300_000)} AS created_at, round(avg(value), 6) AS value
        FROM drift WHERE created_at > {_SINCE} - INTERVAL 5 MINUTE GROUP BY {_SERIES}, 5""",
    "binned_feature_series": f"""WITH {_DRIFT},
        bins AS (
          SELECT {_SERIES}, {_bin(7_200_000_000)} AS bin, avg(value) AS value
          FROM drift WHERE created_at > {_NOW} - INTERVAL 7200 MINUTE GROUP BY ALL)
        SELECT {_SERIES}, CAST(0 AS BIGINT) AS chunk,
               row_number() OVER (PARTITION BY {_SERIES} ORDER BY bin DESC) - 1 AS at,
               bin AS created_at, round(value, 6) AS value
        FROM bins""",
    "lineitem_binned": f"""WITH {_LINEITEM_DRIFT}
        SELECT {_SERIES}, {_bin(30 * 86_400_000_000)} AS created_at, round(avg(value), 6) AS value
        FROM wide WHERE created_at > TIMESTAMP '1999-01-01' - INTERVAL 5256000 MINUTE
        GROUP BY {_SERIES}, 5""",
    "window_coverage": f"""WITH named AS (
          SELECT * FROM (VALUES ('5minute', 5), ('15minute', 15), ('30minute', 30), ('1hour', 60),
            ('3hour', 180), ('6hour', 360), ('12hour', 720), ('24hour', 1440), ('2day', 2880),
            ('5day', 7200), ('fortnight', 360)) AS w(time_window, minutes))
        SELECT time_window, CAST(minutes AS INTEGER) AS minutes, count(*) AS n
        FROM named JOIN events ON ts > {_NOW} - to_minutes(minutes) GROUP BY ALL""",
    "observability_binned": f"""WITH {_EVENTS_K}, {_ROUTES}, {_route_bins(3_600_000_000, 7200)}
        SELECT {_SERVICE}, route_name, bin AS created_at, round(p5, 6) AS p5, round(p25, 6) AS p25,
               round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99,
               total_request_count, total_error_count, round(error_latency, 6) AS error_latency
        FROM metrics""",
    "observability_status_counts": f"""WITH {_EVENTS_K}, {_ROUTES}, {_route_bins(3_600_000_000, 7200)}
        SELECT {_SERVICE}, route_name, bin AS created_at, status, count FROM statuses""",
    "observability_series": f"""WITH {_EVENTS_K}, {_ROUTES}, {_route_bins(8_640_000_000, 1440)},
        ok AS (SELECT * FROM statuses WHERE status = '200')
        SELECT {_SERVICE}, route_name, CAST(0 AS BIGINT) AS chunk,
               row_number() OVER (PARTITION BY {_SERVICE}, route_name ORDER BY bin DESC) - 1 AS at,
               bin AS created_at, round(p50, 6) AS p50, total_request_count, coalesce(ok.count, 0) AS count_200
        FROM metrics LEFT JOIN ok USING ({_SERVICE}, route_name, bin)""",
    "request_counts": f"""WITH {_EVENTS_K}, {_REQUESTS}
        SELECT method, path, status, count(*) AS requests, round(sum(latency), 4) AS latency_sum
        FROM requests GROUP BY ALL""",
    "request_histogram": f"WITH {_EVENTS_K}, {_REQUESTS} {_BUCKETS}",
    "profile_limits": f"""WITH {_DRIFT}, {_limits('drift', _BASELINE)}
        SELECT {_SERIES}, round(center, 6) AS center, round(one_ucl, 6) AS one_ucl,
               round(one_lcl, 6) AS one_lcl, round(two_ucl, 6) AS two_ucl, round(two_lcl, 6) AS two_lcl,
               round(three_ucl, 6) AS three_ucl, round(three_lcl, 6) AS three_lcl
        FROM limits WHERE feature IN ('click', 'error', 'purchase', 'view')""",
    "profile_errors": f"""WITH {_USERS}
        SELECT {_SERVICE}, CASE drift_type WHEN 'SPC' THEN 'malformed rule'
               ELSE 'unknown drift type' END AS reason FROM users""",
    "get_profile": f"""WITH {_DRIFT}, {_limits('drift', _BASELINE)}
        SELECT {_SERVICE}, '8 16 4 8 2 4 1 1' AS rule, round(center, 6) AS click_center
        FROM limits WHERE {_ONE} AND feature = 'click'""",
    "due_profiles": f"""WITH {_USERS}
        SELECT {_SERVICE}, schedule, previous_run, next_run, drift_type
        FROM users WHERE active AND next_run < {_NOW}""",
    "cron_next_run": f"""WITH {_USERS}, {_UPCOMING}
        SELECT {_SERVICE},
               CASE WHEN active AND user_id % 6 = 5 THEN '0 0 0 29 2 MON'
                    WHEN active AND user_id % 6 = 4 THEN '0 0 0 1 1 * 2040' ELSE schedule END AS schedule,
               CASE WHEN active AND user_id % 6 = 5 THEN TIMESTAMP '2044-02-29'
                    WHEN active AND user_id % 6 = 4 THEN TIMESTAMP '2040-01-01' ELSE upcoming END AS next_run
        FROM users JOIN upcoming USING (schedule)""",
    "advance_schedule": f"""WITH {_USERS}, {_UPCOMING}
        SELECT {_SERVICE}, active,
               CASE WHEN active THEN next_run ELSE previous_run END AS previous_run,
               CASE WHEN active THEN upcoming ELSE next_run END AS next_run,
               CASE WHEN active THEN {_CHECK} ELSE previous_run END AS updated_at
        FROM users JOIN upcoming USING (schedule)""",
    "insert_profiles": f"""WITH {_USERS}, {_UPCOMING},
        first_event AS (SELECT user_id, min(event_id) AS sample_size FROM events GROUP BY user_id)
        SELECT {_SERVICE}, active, CASE WHEN active THEN previous_run ELSE upcoming END AS previous_run,
               CASE WHEN active THEN next_run ELSE upcoming END AS next_run,
               CASE WHEN active THEN '0.1.0' ELSE '0.3.1' END AS client_version,
               CASE WHEN active THEN 0 ELSE sample_size END AS sample_size
        FROM users JOIN upcoming USING (schedule) JOIN first_event USING (user_id)""",
    "profile_rejects": """
        SELECT CASE WHEN event_id % 5 < 2 THEN 'unreadable profile' ELSE 'unreadable schedule' END AS reason, count(*) AS n
        FROM events WHERE event_id % 5 < 3 GROUP BY 1""",
    "update_profiles": f"""WITH {_USERS},
        purchases AS (
          SELECT user_id, max(event_id) AS sample_size FROM events
          WHERE event_type = 'purchase' GROUP BY user_id)
        SELECT {_SERVICE}, CASE WHEN sample_size IS NULL THEN drift_type ELSE 'SPC' END AS drift_type,
               next_run, previous_run AS updated_at, coalesce(sample_size, 0) AS sample_size
        FROM users LEFT JOIN purchases USING (user_id) WHERE active""",
    "set_profile_status": f"""WITH {_USERS},
        switched AS (
          SELECT user_id, arg_max(event_type, event_id) = 'click' AS wanted FROM events
          WHERE event_type IN ('click', 'error') GROUP BY user_id)
        SELECT {_SERVICE}, coalesce(wanted, active) AS active
        FROM users LEFT JOIN switched USING (user_id)""",
    "monitored_values": f"""WITH {_DRIFT}
        SELECT {_SERIES}, created_at, value FROM drift WHERE created_at > {_BASELINE} {_MONITORED}""",
    "spc_zones": f"{_EVENT_CHECK} SELECT {_SERIES}, created_at, value, code FROM samples",
    "spc_consecutive": f"""{_EVENT_CHECK}, {_RUNS}
        SELECT {_SERIES}, zone, longest FROM runs WHERE kind = 'Consecutive'""",
    "spc_alternating": f"""{_EVENT_CHECK}, {_RUNS}
        SELECT {_SERIES}, zone, longest FROM runs WHERE kind = 'Alternating'""",
    "spc_alerts": f"{_EVENT_CHECK}, {_RUNS} SELECT * FROM raised",
    "lineitem_spc_runs": f"{_LINEITEM_CHECK}, {_RUNS} SELECT {_SERIES}, kind, zone, longest FROM runs",
    "drift_run_alerts": f"""{_EVENT_CHECK}, {_RUNS}, {_EVENTS_K},
        known AS (
          SELECT DISTINCT repository, feature, zone, kind FROM (
            SELECT repository, event_type AS feature, 'Zone ' || CAST(k % 4 + 1 AS VARCHAR) AS zone,
                   CASE WHEN k % 2 = 0 THEN 'Consecutive' ELSE 'Alternating' END AS kind
            FROM ek WHERE date_trunc('day', ts) = {_NOW}))
        SELECT {_SERIES}, zone, kind, 'active' AS status, {_CHECK} AS created_at, {_NOW} AS scheduled_at
        FROM raised WHERE NOT EXISTS (
          SELECT 1 FROM known WHERE known.repository = raised.repository
            AND known.feature = raised.feature AND known.zone = raised.zone AND known.kind = raised.kind)""",
    "drift_run_alert_ids": f"""{_EVENT_CHECK}, {_RUNS}, {_EVENTS_K},
        known AS (
          SELECT DISTINCT repository, feature, zone, kind FROM (
            SELECT repository, event_type AS feature, 'Zone ' || CAST(k % 4 + 1 AS VARCHAR) AS zone,
                   CASE WHEN k % 2 = 0 THEN 'Consecutive' ELSE 'Alternating' END AS kind
            FROM ek WHERE date_trunc('day', ts) = {_NOW})),
        fresh AS (
          SELECT * FROM raised WHERE NOT EXISTS (
            SELECT 1 FROM known WHERE known.repository = raised.repository
              AND known.feature = raised.feature AND known.zone = raised.zone AND known.kind = raised.kind))
        SELECT count(*) AS n, count(*) AS distinct_ids,
               CASE WHEN count(*) > 0 THEN (SELECT max(event_id) FROM events) + 1 END AS first_id,
               CASE WHEN count(*) > 0 THEN (SELECT max(event_id) FROM events) + count(*) END AS last_id
        FROM fresh""",
    "stored_alert_ids": """
        SELECT 3 * count(*) AS n, 3 * count(*) AS distinct_ids, 1 AS first_id, 3 * count(*) AS last_id, 0 AS left
        FROM events""",
    "drift_run_errors": f"""WITH {_DRIFT}
        SELECT DISTINCT {_SERVICE}, 'no new values: purchase' AS reason FROM drift
        WHERE feature = 'purchase' AND created_at < {_BASELINE} AND repository <> 'repo_2'
        UNION
        SELECT DISTINCT {_SERVICE}, 'malformed rule' FROM drift
        WHERE repository = 'repo_2' AND created_at < {_BASELINE}""",
    "drift_run_profiles": f"""WITH {_DRIFT}
        SELECT DISTINCT {_SERVICE}, {_NOW} AS previous_run, TIMESTAMP '2024-02-01' AS next_run,
               {_CHECK} AS updated_at FROM drift WHERE created_at < {_BASELINE}""",
    "query_alerts": f"""WITH {_EVENTS_K}
        SELECT {_SERVICE}, event_type AS feature, ts AS created_at, 'active' AS status, event_id AS id,
               'Zone ' || CAST(k % 4 + 1 AS VARCHAR) AS zone,
               CASE WHEN k % 2 = 0 THEN 'Consecutive' ELSE 'Alternating' END AS kind
        FROM ek WHERE {_ONE} AND k < 50 AND ts >= {_SINCE}
        ORDER BY ts DESC, event_id DESC LIMIT 50""",
    "query_alerts_any_status": f"""WITH {_EVENTS_K}
        SELECT {_SERVICE}, event_type AS feature, ts AS created_at,
               CASE WHEN k < 50 THEN 'active' ELSE 'acknowledged' END AS status, event_id AS id
        FROM ek""",
    "decode_values": f"WITH {_EVENTS_K}, {_MESSAGES} SELECT * FROM decoded",
    "decode_routes": f"""WITH {_EVENTS_K}, {_MESSAGES}
        SELECT ts AS created_at, {_SERVICE}, k + 11 AS request_count, k % 5 AS error_count,
               '/error' AS route_name, round(value * 1.5, 6) AS p95, CAST(k + 1 AS BIGINT) AS ok_count
        FROM messages WHERE fate = 'routes'
        UNION ALL
        SELECT ts, {_SERVICE}, k + 11, k % 5, '/health', round(value * 0.25, 6), 0
        FROM messages WHERE fate = 'routes'""",
    "decode_rejects": f"""WITH {_EVENTS_K}, {_MESSAGES}
        SELECT fate AS reason, count(*) AS n FROM messages
        WHERE fate NOT IN ('routes', 'values') GROUP BY fate""",
    "insert_ignore_duplicates": f"""WITH {_DRIFT}, {_NULL_KEYED},
        stored AS (SELECT * FROM keyed WHERE created_at < {_SINCE}),
        incoming AS (
          SELECT * FROM keyed UNION ALL SELECT * FROM keyed WHERE feature = 'click'),
        after_insert AS (
          SELECT * FROM stored
          UNION ALL
          SELECT * FROM (SELECT DISTINCT * FROM incoming WHERE value IS NOT NULL) i
          WHERE NOT EXISTS (
            SELECT 1 FROM stored s WHERE s.created_at = i.created_at AND s.name = i.name
              AND s.repository = i.repository AND s.feature = i.feature AND s.value = i.value
              AND s.version = i.version)
          UNION ALL
          SELECT * FROM incoming WHERE value IS NULL)
        SELECT {_SERIES}, CAST(date_trunc('day', created_at) AS TIMESTAMP) AS day, count(*) AS n,
               round(sum(value), 4) AS total
        FROM after_insert GROUP BY ALL""",
    "scan_service": f"""WITH {_DRIFT}
        SELECT created_at, name, repository, version, feature, value FROM drift
        WHERE {_ONE} AND created_at > {_SINCE}""",
    "retention_filter": f"""WITH {_DRIFT}
        SELECT created_at, name, repository, version, feature, value FROM drift
        WHERE created_at >= {_NOW} - INTERVAL 7 DAY""",
    "partitioned_table": f"""WITH {_DRIFT}
        SELECT created_at, {_SERIES}, value FROM drift WHERE created_at > {_NOW} - INTERVAL 5 DAY""",
    "compacted_table": f"WITH {_DRIFT} SELECT created_at, {_SERIES}, value FROM drift",
    "stream_ingest": f"""WITH {_EVENTS_K}, {_MESSAGES}
        SELECT DISTINCT * FROM decoded WHERE value IS NOT NULL
        UNION ALL SELECT * FROM decoded WHERE value IS NULL""",
    "stream_ingest_indexed": f"""WITH {_EVENTS_K}, {_MESSAGES}
        SELECT DISTINCT * FROM decoded WHERE value IS NOT NULL
        UNION ALL SELECT * FROM decoded WHERE value IS NULL""",
    "stream_ingest_routes": f"""WITH {_EVENTS_K}, {_MESSAGES}
        SELECT {_SERVICE}, route_name, count(*) AS n, CAST(sum(k + 11) AS BIGINT) AS request_count,
               CAST(sum(k % 5) AS BIGINT) AS error_count,
               round(sum(value * CASE route_name WHEN '/error' THEN 1.5 ELSE 0.25 END), 4) AS p95
        FROM messages, (VALUES ('/error'), ('/health')) AS r(route_name)
        WHERE fate = 'routes' GROUP BY {_SERVICE}, route_name
        UNION ALL
        SELECT NULL, NULL, NULL, fate, count(*), NULL, NULL, NULL FROM messages
        WHERE fate NOT IN ('routes', 'values') GROUP BY fate""",
    "stream_dedupe": f"""WITH {_DRIFT}, {_NULL_KEYED}
        SELECT DISTINCT * FROM keyed WHERE value IS NOT NULL
        UNION ALL
        SELECT k.* FROM keyed k JOIN (VALUES (1), (2)) AS copies(n) ON true WHERE value IS NULL""",
    "stream_request_histogram": f"WITH {_EVENTS_K}, {_REQUESTS} {_BUCKETS}",
    "stream_binned_late": f"""WITH {_DRIFT}
        SELECT {_SERIES}, {_bin(3_600_000_000)} AS created_at, round(avg(value), 6) AS value
        FROM drift GROUP BY {_SERIES}, 5""",
    "stream_binned": f"""WITH {_DRIFT}
        SELECT {_SERIES}, {_bin(3_600_000_000)} AS created_at, round(avg(value), 6) AS value
        FROM drift GROUP BY {_SERIES}, 5""",
}
