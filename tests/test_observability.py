import datetime as dt

from pyspark.sql import functions as F

from driftwatch.functions.timewin import bin_microseconds
from driftwatch.operators import observability as ob
from driftwatch.schemas import OBSERVABILITY

START = dt.datetime(2024, 6, 26, 20, 0, tzinfo=dt.timezone.utc)


# The route metrics of the bulk fixture.
ROUTES = [
    ("route1", (10.5, 20.5, 30.5, 40.5, 50.5), 50, 2, 5.5, {"200": 45, "500": 2, "404": 3}),
    ("route2", (15.5, 25.5, 35.5, 45.5, 55.5), 50, 3, 6.5, {"200": 47, "500": 1, "404": 2}),
]


def bulk(spark, routes=ROUTES, n=1000):
    """A record every seven seconds."""
    rows = [
        (START + dt.timedelta(seconds=7 * i), "example-repo-1", "example-service-1", "1.0.0", 100 + i, 5 + i, routes)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, OBSERVABILITY)


def test_one_minute_bins(spark):
    df = bulk(spark)
    rows = ob.route_bins(ob.route_measures(df, 60_000_000, 5, now=START)).collect()
    assert len(rows) == 2 * 117
    first = next(r for r in rows if r.route_name == "route1" and r.created_at == START.replace(tzinfo=None))
    assert [first[p] for p in ob.PERCENTILES] == [10.5, 20.5, 30.5, 40.5, 50.5]
    assert (first.total_request_count, first.total_error_count, first.error_latency) == (450, 18, 5.5)
    assert {s.status: s["count"] for s in first.status_counts} == {"200": 405, "404": 27, "500": 18}


def test_series_of_two_routes(spark):
    df = bulk(spark)
    rows = ob.binned_routes_series(df, "5minute", 1000, now=START).collect()
    assert bin_microseconds(5, 1000) == 300_000
    assert sorted(r.route_name for r in rows) == ["route1", "route2"]
    for r in rows:
        assert r.total_request_count == [50] * 1000
        assert r.created_at == sorted(r.created_at, reverse=True)
        assert r.status_counts[0] == next(x[5] for x in ROUTES if x[0] == r.route_name)


def test_missing_codes_and_routes(spark):
    bare = [("quiet", (1.0, None, 1.0, 1.0, 1.0), 1, 0, None, {})]
    row = ob.binned_routes_series(bulk(spark, bare, 3), "1hour", 1, now=START).first()
    assert row.status_counts == [{}] and row.p25 == [None] and row.total_request_count == [3]
    assert ob.binned_routes_series(bulk(spark, [], 3), "1hour", 1, now=START).count() == 0
    nothing = [("none", (1.0,) * 5, 1, 0, 0.0, None)]
    assert ob.binned_routes_series(bulk(spark, nothing, 3), "1hour", 1, now=START).first().status_counts == [{}]


def test_request_histogram(spark):
    log = spark.createDataFrame(
        [("GET", "/a", "200", v) for v in (0.001, 0.005, 0.3, 11.0)], "method string, path string, status string, latency double"
    )
    rows = {r.le: r.bucket_count for r in ob.request_histogram(log).collect()}
    assert rows["0.005"] == 2 and rows["0.25"] == 2 and rows["0.5"] == 3 and rows["10.0"] == 3 and rows["+Inf"] == 4
    assert ob.request_rollup(log).select(F.round("latency_sum", 3)).first()[0] == 11.306
