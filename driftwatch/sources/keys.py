"""An index of the keys of stored values."""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.operators.dedupe import complete, key_digest
from driftwatch.schemas import DRIFT_KEY
from driftwatch.sources import storage


class KeyIndex:
    """Digests of stored keys with their batch, by day, in buckets sorted by digest.

    A batch of values meets the stored keys of its days by a merge join: its own digests are dealt out
    and ordered, and the stored ones are read as they lie. The index can be made anew, day by day, from
    the values it tells of.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"drift_keys_{hashlib.md5(f'{path} {buckets}'.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, ingest_batch STRING, event_date DATE) USING parquet "
            f"PARTITIONED BY (event_date) CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def stored(self) -> DataFrame:
        """The index as other sessions have left it too."""
        if storage.exists(self.spark, self.path):
            self.spark.sql(f"MSCK REPAIR TABLE {self.table} SYNC PARTITIONS")
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def missing(self, keyed: DataFrame, ignored: list[str]) -> DataFrame:
        """Rows of ``keyed``, which have ``digest`` and ``created_at``, whose key is not stored. Keys of the
        batches ``ignored``, which are not done, don't count."""
        days = keyed.select(F.to_date("created_at").alias("event_date")).distinct()
        # A condition that looks selective, so that other days are pruned; there are no more days than
        # the calendar has.
        days = days.where(F.col("event_date") > F.lit("0001-01-01").cast("date"))
        known = self.stored().join(F.broadcast(days), "event_date", "left_semi")
        known = known.where(~F.col("ingest_batch").isin(ignored)) if ignored else known
        return keyed.join(known.select("digest").hint("merge"), "digest", "left_anti").select(*keyed.columns)

    def add(self, keyed: DataFrame, batch: str) -> None:
        rows = keyed.select("digest", F.lit(batch).alias("ingest_batch"), F.to_date("created_at").alias("event_date"))
        self._dealt(rows).write.insertInto(self.table)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """One task for each bucket of a day, which so gets one file; days are written side by side."""
        return rows.repartition("event_date", F.pmod(F.hash("digest"), F.lit(self.buckets)))

    def rebuild(self, values: DataFrame) -> None:
        """Replaces the days that the stored ``values`` lie on: one file a bucket and day, each key once."""
        rows = values.where(complete(DRIFT_KEY)).withColumn("digest", key_digest())
        rows = rows.groupBy("digest").agg(F.max("ingest_batch").alias("ingest_batch"), F.max("event_date").alias("event_date"))
        before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            self._dealt(rows).write.insertInto(self.table, overwrite=True)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
