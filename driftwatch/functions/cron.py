"""Next run of a cron schedule, as plain column expressions.

A schedule has six fields (second, minute, hour, day of month, month, day of week), optionally a
seventh for the year, and is read in UTC. Day of month and day of week must both match. Days of the
week count from 1 = Sunday, as Spark's ``dayofweek`` does.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.timewin import as_timestamp

# Fixed values of the cron notation.
SHORTHANDS = {
    "@yearly": "0 0 0 1 1 * *",
    "@monthly": "0 0 0 1 * * *",
    "@weekly": "0 0 0 * * 1 *",
    "@daily": "0 0 0 * * * *",
    "@hourly": "0 0 * * * * *",
}
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "sunday monday tuesday wednesday thursday friday saturday".split()
FIELDS = {
    "seconds": (0, 59),
    "minutes": (0, 59),
    "hours": (0, 23),
    "days": (1, 31),
    "months": (1, 12),
    "weekdays": (1, 7),
    "years": (1970, 2100),
}
NAMES = {"months": MONTHS, "weekdays": WEEKDAYS}

_PART = r"^(\*|\?|[0-9a-z]+)(?:-([0-9a-z]+))?(?:/([0-9]+))?$"


def _number(text: Column, field: str) -> Column:
    value = text.try_cast("int")
    if field in NAMES:
        numbers = {name[:n]: k for k, name in enumerate(NAMES[field], 1) for n in (3, len(name))}
        named = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
        value = F.coalesce(value, F.try_element_at(named, text))
    return value


def _expand(part: Column, field: str) -> Column:
    """Values one comma-separated part stands for; NULL when it is not valid."""
    first, last = FIELDS[field]
    start, end, step = (F.regexp_extract(part, _PART, i) for i in (1, 2, 3))
    any_value = start.isin("*", "?")
    low = F.when(any_value, F.lit(first)).otherwise(_number(start, field))
    high = (
        F.when(end != "", _number(end, field))
        .when(any_value | (step != ""), F.lit(last))
        .otherwise(low)
    )
    by = F.when(step == "", F.lit(1)).otherwise(step.try_cast("int"))
    valid = (low >= first) & (high <= last) & (low <= high) & (by > 0) & ~(any_value & (end != ""))
    return F.when(valid, F.sequence(low, high, by))


def _field(parts: Column, index: int, field: str) -> Column:
    text = F.try_element_at(parts, F.lit(index + 1))
    if field == "years":
        text = F.coalesce(text, F.lit("*"))
    values = F.transform(F.split(text, ","), lambda part: _expand(part, field))
    return F.array_sort(F.array_distinct(F.flatten(values)))


def parse(schedule: Column) -> Column:
    """A struct with the allowed values of every field; NULL where one cannot be read."""
    text = F.lower(F.trim(schedule))
    shorthand = F.create_map(*[F.lit(part) for pair in SHORTHANDS.items() for part in pair])
    parts = F.split(F.coalesce(F.try_element_at(shorthand, text), text), r"\s+")
    good_count = F.size(parts).isin(6, 7)
    return F.struct(
        *[
            F.when(good_count, _field(parts, i, field)).alias(field)
            for i, field in enumerate(FIELDS)
        ]
    )


def _next_above(values: Column, floor: Column) -> Column:
    return F.array_min(F.filter(values, lambda v: v > floor))


def _time(hour: Column, minute: Column, second: Column) -> Column:
    return hour * 3600 + minute * 60 + second


def _upcoming(fields: Column, now: Column) -> Column:
    """First instant strictly after ``now`` that the parsed fields allow."""
    values = {field: fields[field] for field in FIELDS}
    first_hour, first_minute, first_second = (
        F.array_min(values[f]) for f in ("hours", "minutes", "seconds")
    )
    hour, minute, second = F.hour(now), F.minute(now), F.second(now)
    in_hour = F.array_contains(values["hours"], hour)
    in_minute = in_hour & F.array_contains(values["minutes"], minute)
    today_time = F.coalesce(
        F.when(in_minute, _time(hour, minute, _next_above(values["seconds"], second))),
        F.when(in_hour, _time(hour, _next_above(values["minutes"], minute), first_second)),
        _time(_next_above(values["hours"], hour), first_minute, first_second),
    )

    def day_matches(day: Column) -> Column:
        return (
            F.array_contains(values["months"], F.month(day))
            & F.array_contains(values["days"], F.dayofmonth(day))
            & F.array_contains(values["weekdays"], F.dayofweek(day))
            & F.array_contains(values["years"], F.year(day))
        )

    today = F.to_date(now)

    # The last day of the last year a schedule can name.
    end = F.make_date(F.lit(FIELDS["years"][1]), F.lit(12), F.lit(31))

    def first_day(start: int, stop: Column) -> Column:
        first = F.date_add(today, start)
        days = F.when(first <= stop, F.sequence(first, stop))
        return F.array_min(F.filter(days, day_matches))

    # coalesce stops at the first hit, so only sparse schedules search the longer horizons.
    later_day = F.coalesce(
        first_day(1, F.date_add(today, 7)),
        first_day(8, F.date_add(today, 366)),
        first_day(367, F.date_add(today, 366 * 8)),
        first_day(366 * 8 + 1, end),
    )
    midnight = F.unix_seconds(F.date_trunc("day", now))
    return F.coalesce(
        F.when(day_matches(today), F.timestamp_seconds(midnight + today_time)),
        F.timestamp_seconds(
            F.unix_seconds(later_day.cast("timestamp")) + _time(first_hour, first_minute, first_second)
        ),
    )


def next_runs(schedules: DataFrame, now, column: str = "schedule") -> DataFrame:
    """``(schedule, next_run)`` for every distinct schedule: the first instant strictly after ``now``.

    Schedules that cannot be read, or never come round, get a NULL ``next_run``.
    """
    now = as_timestamp(now)
    distinct = schedules.select(F.col(column).alias("schedule")).where(F.col(column).isNotNull()).distinct()

    def upcoming(fields: Column) -> Column:
        readable = F.lit(True)
        for field in FIELDS:
            readable = readable & fields[field].isNotNull()
        return F.when(readable, _upcoming(fields, now))

    # Going through a one-element array binds the parsed fields to a name. Written out in place,
    # they would be parsed again for every day that is tried.
    found = F.transform(F.array(parse(F.col("schedule"))), upcoming)
    return distinct.select("schedule", found[0].alias("next_run"))
