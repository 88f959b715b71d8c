import datetime as dt

import pytest

from driftwatch.functions.cron import next_runs

NOW = dt.datetime(2024, 6, 26, 20, 43, 27, tzinfo=dt.timezone.utc)  # a Wednesday

CASES = {
    "0 0 0 * * *": "2024-06-27 00:00:00",
    "0 0 * * * *": "2024-06-26 21:00:00",
    "0 */15 * * * *": "2024-06-26 20:45:00",
    "27 43 20 * * *": "2024-06-27 20:43:27",
    "28 43 20 * * *": "2024-06-26 20:43:28",
    "0 30 6 * * MON": "2024-07-01 06:30:00",
    "0 30 6 * * 2": "2024-07-01 06:30:00",
    "0 0 9-17/4 * * mon-fri": "2024-06-27 09:00:00",
    "0 0 12 1 * ?": "2024-07-01 12:00:00",
    "5,10 1 3 1 JAN *": "2025-01-01 03:01:05",
    "0 0 0 29 2 *": "2028-02-29 00:00:00",
    "0 0 0 13 * 6": "2024-09-13 00:00:00",
    "0 0 0 1 1 * 2030": "2030-01-01 00:00:00",
    "0 0 0 29 2 MON": "2044-02-29 00:00:00",
    "0 0 0 1 1 * 2040": "2040-01-01 00:00:00",
    "0 0 0 31 dec * 2100": "2100-12-31 00:00:00",
    "0 0 0 * february Tuesday": "2025-02-04 00:00:00",
    "0 50/5 * * * *": "2024-06-26 20:50:00",
    "@hourly": "2024-06-26 21:00:00",
    "@daily": "2024-06-27 00:00:00",
    "@weekly": "2024-06-30 00:00:00",
    "@monthly": "2024-07-01 00:00:00",
    "@yearly": "2025-01-01 00:00:00",
    # Nothing comes of these.
    "0 0 0 31 2 *": None,
    "0 0 0 1 1 * 2020": None,
    "* * * * *": None,
    "0 0 25 * * *": None,
    "0 0 0 * * 0": None,
    "0 10-5 * * * *": None,
    "0 0 x * * *": None,
    "0 */0 * * * *": None,
    "": None,
    "test": None,
    "0 0 0 * * monkey": None,
    "0 0 0 * * mo": None,
    "0 0 0 * decade *": None,
}


def test_next_run(spark):
    df = spark.createDataFrame([(s,) for s in [*CASES, *CASES]], "schedule string")
    rows = next_runs(df, NOW).collect()
    assert len(rows) == len(CASES)
    found = {r.schedule: r.next_run and str(r.next_run) for r in rows}
    assert found == CASES


@pytest.mark.parametrize("now", ["2024-12-31T23:59:59", "2024-02-28T23:59:59.999999", "2024-03-01T00:00:00"])
def test_against_stepping_through_seconds(spark, now):
    """Fields as sets, and every second of the next days tried in turn."""
    specs = {
        "*/20 59 * * * *": ({0, 20, 40}, {59}, range(24), range(1, 32), range(1, 13)),
        "0 0,30 */6 * * *": ({0}, {0, 30}, {0, 6, 12, 18}, range(1, 32), range(1, 13)),
        "15 10 4 1-3 * *": ({15}, {10}, {4}, {1, 2, 3}, range(1, 13)),
        "0 0 0 29 * *": ({0}, {0}, {0}, {29}, range(1, 13)),
    }
    start = dt.datetime.fromisoformat(now)
    expected = {}
    for text, (secs, mins, hours, days, months) in specs.items():
        t = start.replace(microsecond=0) + dt.timedelta(seconds=1)
        while t.day not in days or t.month not in months:
            t = dt.datetime(t.year, t.month, t.day) + dt.timedelta(days=1)
        while not (
            t.second in secs and t.minute in mins and t.hour in hours and t.day in days and t.month in months
        ):
            t += dt.timedelta(seconds=1)
        expected[text] = t
    df = spark.createDataFrame([(s,) for s in specs], "schedule string")
    assert {r.schedule: r.next_run for r in next_runs(df, now).collect()} == expected
