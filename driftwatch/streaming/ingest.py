"""Continuous ingest and streaming rollups."""

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftwatch.operators.dedupe import complete, key_digest, new_rows
from driftwatch.schemas import DRIFT_KEY, ORIGIN, SERIES
from driftwatch.session import owned_folders, pin
from driftwatch.sources.messages import (
    observability_records,
    parse_records,
    rejected_records,
    spc_records,
)
from driftwatch.sources.tables import Tables

# Late values are accepted as long as drift rows are kept.
WATERMARK = "7 days"


def store_batch(tables: Tables, messages: DataFrame, batch: str) -> None:
    """Decode one batch of messages and store values, route metrics and rejects.

    Every part is written under the name of the batch, replacing what an earlier attempt left.
    Values already stored by other batches are ignored, and so is any other record that came from the
    same place (topic, partition and offset, or file and line) before; the search for them reads
    only the days that the batch touches.
    """
    records = parse_records(messages).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for name, rows, key, origin in (
            ("drift", spc_records(records), DRIFT_KEY, ORIGIN),
            ("observability", observability_records(records), ORIGIN, None),
            ("rejects", rejected_records(records), ORIGIN, None),
        ):
            stored = tables.read(name).where(F.col("ingest_batch") != batch)
            if name == "drift" and tables.keys is not None:
                _store_by_index(tables, stored, rows, batch)
            else:
                tables.write_batch(name, new_rows(on_days_of(stored, rows), rows, key, origin), batch)
    finally:
        records.unpersist()


def _store_by_index(tables: Tables, stored: DataFrame, values: DataFrame, batch: str) -> None:
    """Stores the values whose key the index lacks, and those without a whole key as ever.

    Keys are entered before the values are stored, and count once their batch is done: a batch that
    breaks off and comes again finds its own keys open.
    """
    if not tables.begin_batch("drift", batch):
        return
    with owned_folders(tables.spark):
        keyed = values.where(complete(DRIFT_KEY)).dropDuplicates(DRIFT_KEY).withColumn("digest", key_digest())
        fresh = pin(tables.keys.missing(keyed, tables.open_batches("drift")))
        tables.keys.add(fresh, batch)
        keyless = values.where(~complete(DRIFT_KEY))
        others = new_rows(on_days_of(stored, keyless).where(~complete(DRIFT_KEY)), keyless, ORIGIN)
        tables.write_batch("drift", fresh.drop("digest").unionByName(others), batch)


def on_days_of(stored: DataFrame, values: DataFrame) -> DataFrame:
    """The stored rows of the days that ``values`` touch, whose folders alone are read.

    The days are broadcast: there are no more of them than the calendar has, however many rows
    there are. Dynamic pruning wants a condition on them that looks selective, which the bound is for.
    """
    days = values.select(F.to_date("created_at").alias("event_date")).distinct()
    days = days.where(F.col("event_date") > F.lit("0001-01-01").cast("date"))
    return stored.join(F.broadcast(days), "event_date", "left_semi")


def ingest(tables: Tables, messages: DataFrame, batch: str) -> None:
    """Batch ingest of JSON messages (column ``value``). ``batch`` identifies it: repeat it after a
    failure and nothing is stored twice."""
    store_batch(tables, messages, batch)


def start_ingest(
    messages: DataFrame,
    tables: Tables,
    checkpoint: str,
    source: str = "stream",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Run the ingest on a stream, by default over what is available now.

    Batches are stored as ``<source>-<number>``. A query that starts over with a fresh checkpoint
    counts from zero again, so give it another ``source``.
    """
    return (
        messages.writeStream.foreachBatch(
            lambda df, batch: store_batch(tables, df, f"{source}-{batch}")
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def dedupe_stream(values: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Drop repeated values inside the watermark. Rows with a NULL key part all pass, as on insert.

    The state holds a digest of sixteen bytes and an expiry time for each key, on disk where
    ``use_disk_state`` has been set. Rows later than the watermark are not passed on; where none may be
    lost, use the ingest, whose search for stored rows has no horizon.
    """
    complete = F.lit(True)
    for column in DRIFT_KEY:
        complete = complete & F.col(column).isNotNull()
    marked = values.withWatermark("created_at", watermark)
    keyed = marked.where(complete).withColumn("_digest", key_digest())
    return keyed.dropDuplicatesWithinWatermark(["_digest"]).drop("_digest").unionByName(marked.where(~complete))


def binned_stream(values: DataFrame, width_us: int, watermark: str = WATERMARK) -> DataFrame:
    """Binned means on a stream, kept as sums and counts so that updates can be merged."""
    return (
        values.withWatermark("created_at", watermark)
        .groupBy(*SERIES, F.window("created_at", f"{width_us} microseconds").alias("w"))
        .agg(F.sum("value").alias("total"), F.count("value").alias("n"))
        .select(*SERIES, F.col("w.start").alias("created_at"), "total", "n")
    )


def write_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store each batch of updated bins under its number; ``latest_updates`` reads them back."""

    def store(df: DataFrame, batch: int) -> None:
        (
            df.withColumn("ingest_batch", F.lit(batch).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("ingest_batch")
            .parquet(path)
        )

    return (
        stream.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_updates(updates: DataFrame) -> DataFrame:
    """The last state of every bin as its mean."""
    last = updates.groupBy(*SERIES, "created_at").agg(
        F.max_by(F.struct("total", "n"), "ingest_batch").alias("s")
    )
    return last.select(
        *SERIES, "created_at", F.when(F.col("s.n") > 0, F.col("s.total") / F.col("s.n")).alias("value")
    )
