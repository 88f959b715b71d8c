"""Order inside a series without sorting the whole series in one task.

A series is cut into time slots. Counts per slot are small, so offsets between slots come from a
window over counts, and only the rows of one slot are ever sorted together. Slots, of which a long
series has many, are themselves summed up by spans of a fixed number of slots.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.operators.joins import same_keys_join

SLOT_SECONDS = 10
#: Slots of a span: a day of slots of ten seconds.
SPAN_SLOTS = 8640


def slot_of(created_at, slot_seconds: int = SLOT_SECONDS) -> Column:
    return F.floor(F.unix_micros(created_at) / F.lit(slot_seconds * 1_000_000)).cast("bigint")


def with_slot(rows: DataFrame, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    return rows.withColumn("slot", slot_of("created_at", slot_seconds))


def span_of(slot: Column) -> Column:
    return F.floor(slot / F.lit(SPAN_SLOTS)).cast("bigint")


def slot_offsets(slotted: DataFrame, group: list[str], size=None) -> DataFrame:
    """Per slot of each group: ``newer`` rows in later slots and the group's ``total``.

    Offsets are made in two steps: of slots within a span of ``SPAN_SLOTS``, and of spans. So a window
    holds the slots of one span, or the spans of one group, and never all slots of a group.
    """
    counts = (
        slotted.groupBy(*group, "slot")
        .agg((F.count(F.lit(1)) if size is None else F.sum(size)).alias("rows"))
        .withColumn("_span", span_of(F.col("slot")))
    )
    newer = lambda rows, over: F.coalesce(F.sum(rows).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.groupBy(*group, "_span").agg(F.sum("rows").alias("_rows"))
    spans = spans.select(
        *group,
        "_span",
        newer("_rows", Window.partitionBy(*group).orderBy(F.desc("_span"))).alias("_newer"),
        F.sum("_rows").over(Window.partitionBy(*group)).alias("total"),
    )
    inside = newer("rows", Window.partitionBy(*group, "_span").orderBy(F.desc("slot")))
    joined = same_keys_join(counts.withColumn("_inside", inside), spans, group + ["_span"])
    return joined.select(*group, "slot", "rows", (F.col("_newer") + F.col("_inside")).alias("newer"), "total")


def shortest_series(offsets: DataFrame, service: list[str]) -> DataFrame:
    """Length of the shortest non-empty series of each service. Empty series have no slots."""
    return offsets.groupBy(*service).agg(F.min("total").alias("keep"))


def repeat_rows(df: DataFrame, times: str, number: str | None = None, chunk: int = 100_000) -> DataFrame:
    """Each row as often as ``times`` says, in two steps so that no huge array is built.

    Column ``number``, if named, counts the copies of a row from 1.
    """
    chunks = F.sequence(F.lit(0).cast("bigint"), (F.col(times) - 1).cast("bigint"), F.lit(chunk).cast("bigint"))
    in_chunk = F.least(F.col(times) - F.col("_from"), F.lit(chunk).cast("bigint"))
    copies = (
        df.where(F.col(times) > 0)
        .withColumn("_from", F.explode(chunks))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), in_chunk.cast("bigint"))))
    )
    if number is not None:
        copies = copies.withColumn(number, F.col("_from") + F.col("_copy"))
    return copies.drop("_from", "_copy")
