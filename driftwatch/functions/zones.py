"""Control-chart zones of a value."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONES = [1, 2, 3, 4]


def zone_code(value: Column, limit=F.col) -> Column:
    """Signed zone: 1 to 4 above the centre, -1 to -4 below, 0 on it.

    NULL for a missing value and for NaN; such samples interrupt a run. ``limit`` turns a limit name
    into its column.
    """
    code = (
        F.when(value > limit("three_ucl"), 4)
        .when(value < limit("three_lcl"), -4)
        .when(value >= limit("two_ucl"), 3)
        .when(value >= limit("one_ucl"), 2)
        .when(value > limit("center"), 1)
        .when(value <= limit("two_lcl"), -3)
        .when(value <= limit("one_lcl"), -2)
        .when(value < limit("center"), -1)
        .otherwise(0)
    )
    return F.when(value.isNotNull() & ~F.isnan(value), code)


def zone_label(zone: Column) -> Column:
    return F.concat(F.lit("Zone "), zone.cast("string"))
