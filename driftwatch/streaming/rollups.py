"""Rollups of streams that can be added up: binned values and request counters.

Each micro-batch is rolled up by itself and stored as what it adds. Sums and counts of all batches
together are those of all rows, so a row may come as late as it likes, no state is held between
batches, and a batch that is stored twice replaces itself. Batches are folded into one a day as they
come, so the stored folders do not grow with the number of batches.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftwatch.functions.timewin import time_bin
from driftwatch.operators.observability import request_histogram
from driftwatch.schemas import ADDITIVE, SERIES
from driftwatch.sources.tables import Tables, added_up


def bin_sums(values: DataFrame, width_us: int) -> DataFrame:
    """Sums and counts of values per series and bin, for table ``bins``."""
    binned = values.select(
        *SERIES, F.lit(width_us).cast("bigint").alias("width_us"), time_bin("created_at", width_us).alias("created_at"), "value"
    )
    return binned.groupBy(*ADDITIVE["bins"][0]).agg(F.sum("value").alias("total"), F.count("value").alias("n"))


def request_sums(requests: DataFrame) -> DataFrame:
    """Requests per method, path, status, latency bound and hour, for table ``requests``. The latency
    sum is kept with the bound that counts every request."""
    hourly = requests.withColumn("hour", F.date_trunc("hour", "created_at"))
    every = F.col("le") == "+Inf"
    return request_histogram(hourly, ["hour"]).select(
        "method",
        "path",
        "status",
        "le",
        F.col("hour").alias("created_at"),
        F.col("bucket_count").cast("bigint").alias("bucket_count"),
        F.when(every, F.col("latency_sum")).alias("latency_sum"),
    )


def start_rollup(
    rows: DataFrame,
    tables: Tables,
    name: str,
    roll_up: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    source: str = "stream",
    fold_after: int = 8,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Store what each micro-batch of ``rows`` adds to table ``name``, and fold the stored batches
    together after every ``fold_after`` of them. Batches are stored as ``<source>-<number>``."""

    def store(df: DataFrame, batch: int) -> None:
        tables.write_batch(name, roll_up(df), f"{source}-{batch}")
        if (batch + 1) % fold_after == 0:
            tables.merge_days(name, "9999-12-31")

    return (
        rows.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_bins(tables: Tables, width_us: int) -> DataFrame:
    """Binned means over everything that has been added."""
    bins = added_up("bins", tables.read("bins").where(F.col("width_us") == width_us))
    return bins.select(*SERIES, "created_at", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("value"))


def read_requests(tables: Tables, hourly: bool = False) -> DataFrame:
    """Cumulative latency buckets per method, path and status, and by hour if asked for."""
    keys, sums = ADDITIVE["requests"]
    keys = keys if hourly else [k for k in keys if k != "created_at"]
    return tables.read("requests").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
