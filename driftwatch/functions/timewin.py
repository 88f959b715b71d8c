"""Time windows, bins and look-back filters."""

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Window names a request may use, in minutes; any other name means six hours.
WINDOW_MINUTES = {
    "5minute": 5,
    "15minute": 15,
    "30minute": 30,
    "1hour": 60,
    "3hour": 180,
    "6hour": 360,
    "12hour": 720,
    "24hour": 1440,
    "2day": 2880,
    "5day": 7200,
}
DEFAULT_WINDOW_MINUTES = 360


def window_minutes(name: str) -> int:
    return WINDOW_MINUTES.get(name, DEFAULT_WINDOW_MINUTES)


def window_minutes_column(name: Column) -> Column:
    """The same lookup per row."""
    pairs = [F.lit(part) for pair in WINDOW_MINUTES.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit(DEFAULT_WINDOW_MINUTES))


def bin_microseconds(minutes: int, max_data_points: int) -> int:
    """Bin width that spreads a window over at most ``max_data_points`` bins.

    Widths are fractional in general, so they are kept in whole microseconds.
    """
    if max_data_points <= 0:
        raise ValueError("max_data_points must be positive")
    width = round(minutes * 60_000_000 / max_data_points)
    if width < 1:
        raise ValueError("bins would be narrower than one microsecond")
    return width


def time_bin(created_at, width_us: int) -> Column:
    """Start of the bin, counted from the epoch."""
    return F.window(created_at, f"{width_us} microseconds")["start"]


def as_timestamp(moment) -> Column:
    """A datetime (naive means UTC), ISO text or Column, as a timestamp Column."""
    if isinstance(moment, Column):
        return moment
    if isinstance(moment, dt.datetime):
        if moment.tzinfo is None:
            moment = moment.replace(tzinfo=dt.timezone.utc)
        return F.lit(moment)
    return F.to_timestamp(F.lit(moment))


def now_or(moment=None) -> Column:
    return F.current_timestamp() if moment is None else as_timestamp(moment)


def look_back(created_at, minutes: int, now=None, until=None) -> Column:
    """Rows newer than ``now - minutes``: strict, and open towards the future unless ``until`` is set."""
    span = F.make_dt_interval(mins=F.lit(minutes))
    kept = F.col(created_at) > now_or(now) - span
    if until is not None:
        kept = kept & (F.col(created_at) <= as_timestamp(until))
    return kept


def since(created_at, moment, inclusive: bool = False) -> Column:
    bound = as_timestamp(moment)
    return F.col(created_at) >= bound if inclusive else F.col(created_at) > bound


def day_of(moment) -> Column:
    """Partition value of a moment; filtering ``event_date`` on it is what prunes folders."""
    return F.to_date(as_timestamp(moment))
