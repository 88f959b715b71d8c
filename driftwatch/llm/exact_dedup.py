"""Exact duplicates by a persistent index of text digests, in DataFrame operations only.

The index is a table bucketed and sorted by digest. A batch is reduced to its distinct digests,
those already stored are dropped by a sort-merge anti-join, which reads the stored buckets in their
order without a shuffle, and the rest is appended.

Edge cases: null texts equal empty ones. A null id loses to any id; if all ids of a group are null,
its rows all count as kept in the report. Rows repeated with id and text are one document, so
each is reported alike, and ``distinct_documents`` keeps one of them. An empty batch adds nothing. Texts
of any length are hashed whole. Other columns are not read by the index and pass through
``distinct_documents`` as they are, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.session import pin, run_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: str) -> Column:
    """The text with A-Z lower-cased and all else as it is; null as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    ascii_only = F.octet_length(whole) == F.length(whole)
    return F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, UPPER, UPPER.lower()))


class DigestIndex:
    """Digests seen so far, each with the id that stays and the number of rows of its first batch.

    ``path`` lies in storage that all executors share. ``buckets`` is fixed when the index is made
    and must be given again when it is opened; left out, it is the session's shuffle partitions,
    so that a batch is aggregated, joined and written in one partitioning. ``close`` takes the table out
    of the session's catalog and leaves the index where it is.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = path
        self.table = f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, copies BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def stored(self) -> DataFrame:
        return self.spark.table(self.table)

    def _insert(self, rows: DataFrame) -> None:
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            rows = rows.repartition(self.buckets, "digest")
        rows.write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def of_stored(self, digests: DataFrame, how: str) -> DataFrame:
        """``digests`` joined to the index by its buckets, which are read where they lie."""
        columns = ["digest"] if how == "left_anti" else self.stored().columns
        return digests.join(self.stored().select(*columns).hint("merge"), "digest", how)

    def append(self, digests: DataFrame, batch: str) -> DataFrame:
        """``digests``: digest, id. Stores those not seen before, with the largest id of each, and returns
        the batch's distinct digests."""
        new = digests.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
        # Written first: the optimizer would move the anti-join below the aggregate, and rows of a
        # frequent digest would then all be shuffled to one task.
        new = pin(new)
        self._insert(self.of_stored(new, "left_anti").withColumn("batch", F.lit(batch)))
        return new.select("digest")

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
        """Adds a batch and reports each of its rows: id, digest, keep_id, copies, kept.

        A row is kept if the batch brought its digest and its id is the one that stays. Adding a batch
        again under its name, after a crash at any point, adds nothing twice and gives the same report;
        a batch without a name is a new one each time.
        """
        batch = batch or uuid.uuid4().hex
        rows = pin(docs.select(F.col(doc_id).cast("long").alias("id"), F.unhex(F.sha2(normalised(text), 256)).alias("digest")))
        # Only the batch's distinct digests meet the index. What is found is as small as the batch, and
        # is dealt out anew with its rows, so that a digest with many rows is split among tasks.
        found = pin(self.of_stored(self.append(rows, batch), "inner"))
        kept = (F.col("batch") == batch) & F.col("id").eqNullSafe(F.col("keep_id"))
        return rows.join(found, "digest").select("id", "digest", "keep_id", "copies", kept.alias("kept"))

    def rewritten(self, path: str) -> DigestIndex:
        """A copy of the index with one sorted file a bucket, in place of one for each batch. Buckets
        are copied as they lie, without a shuffle."""
        other = DigestIndex(self.spark, path, self.buckets)
        # Spark would read files instead of buckets where no join or aggregate asks for them.
        setting = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, "false")
        try:
            self.stored().write.insertInto(other.table)
        finally:
            self.spark.conf.set(setting, before)
        self.spark.catalog.refreshTable(other.table)
        return other


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns."""
    with DigestIndex(docs.sparkSession, f"{run_dir(docs.sparkSession)}/digests") as index:
        rows = index.add(docs, doc_id, text)
    none = F.lit(-(2**63)).cast("long")
    keep = rows.filter("kept").select(F.coalesce("id", none).alias("__id"), F.col("digest").alias("__key"))
    own = docs.select(
        F.struct("*").alias("__row"),
        F.coalesce(F.col(doc_id).cast("long"), none).alias("__id"),
        F.unhex(F.sha2(normalised(text), 256)).alias("__key"),
    )
    # The join's partitioning serves for taking one of repeated rows too.
    stay = own.join(keep.distinct(), ["__id", "__key"], "left_semi")
    return stay.dropDuplicates(["__id", "__key"]).select("__row.*")
