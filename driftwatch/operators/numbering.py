"""Gapless numbers without bringing all rows into one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BUCKETS = 256


def number_rows(df: DataFrame, key: list[str], name: str, start: int = 0) -> DataFrame:
    """Adds ``name``: ``start + 1`` onwards, given out per hash bucket of the unique ``key``.

    Only the counts of the buckets, of which there is a fixed number, meet in one task. The numbers
    depend on the rows alone, so a task that is run again gives out the same ones.
    """
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(_BUCKETS)))
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    in_bucket = Window.partitionBy("_bucket").orderBy(*key)
    number = F.lit(start) + F.col("_offset") + F.row_number().over(in_bucket)
    # Broadcast is safe: the offsets have one row per bucket, _BUCKETS at most.
    return (
        bucketed.join(F.broadcast(offsets), "_bucket")
        .withColumn(name, number.cast("bigint"))
        .drop("_bucket", "_offset")
    )
