"""Appends that ignore rows already present."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.schemas import DRIFT_KEY


def complete(key: list[str]) -> Column:
    """Whether no part of the key is NULL."""
    return reduce(and_, [F.col(c).isNotNull() for c in key])


def key_digest(key: list[str] = DRIFT_KEY) -> Column:
    """Sixteen bytes that tell keys without a NULL part apart, whatever the length of their texts."""
    parts = {"created_at": F.unix_micros("created_at"), "value": F.col("value") + F.lit(0.0)}  # -0.0 equals 0.0
    return F.unhex(F.md5(F.to_json(F.struct(*[parts.get(c, F.col(c)).alias(c) for c in key]))))


def new_rows(
    target: DataFrame, incoming: DataFrame, key: list[str] = DRIFT_KEY, origin: list[str] | None = None
) -> DataFrame:
    """Rows of ``incoming`` that an insert with "do nothing on conflict" would add to ``target``.

    A unique key never matches on NULL, so rows with a NULL key part are all kept, also when they
    repeat; but where ``origin`` tells where they came from, not when they come from there again. For
    the others copies collapse on the map side before anything is shuffled, and the anti-join
    reuses the partitioning of that aggregation.
    """
    whole = complete(key)
    keyed = incoming.where(whole).dropDuplicates(key)
    present = target.where(whole).select(*key)
    fresh = keyed.join(present, key, "left_anti").select(*incoming.columns)
    keyless = incoming.where(~whole)
    return fresh.unionByName(new_rows(target.where(~whole), keyless, origin) if origin else keyless)


def insert_ignore(target: DataFrame, incoming: DataFrame, key: list[str] = DRIFT_KEY) -> DataFrame:
    """The whole table after the insert."""
    return target.unionByName(new_rows(target, incoming, key))
