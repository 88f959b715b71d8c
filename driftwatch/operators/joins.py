"""Joining facts to dimensions without trusting the dimension to stay small."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024


def measured_bytes(df: DataFrame) -> int:
    """Size of a dimension: eight bytes per field plus the text it holds. One distributed pass."""
    width = 8 * len(df.columns)
    size = F.lit(width)
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
    return df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"]


def same_keys_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL key parts are equal, as in grouping.

    Both sides are joined on one struct of the keys: a struct is never NULL itself and compares NULL
    members as equal. Column ``_key`` holds it, so what follows can group on it without a shuffle.
    """
    joined = left.withColumn("_key", F.struct(*on)).join(
        right.withColumn("_key", F.struct(*on)).drop(*on), "_key", how
    )
    return joined.select(*left.columns, *[c for c in right.columns if c not in on], "_key")


def dimension_join(
    facts: DataFrame,
    dimension: DataFrame,
    on: list[str],
    spread_by: list[str],
    extra: Column | None = None,
    how: str = "inner",
    limit_bytes: int = BROADCAST_BYTES,
    salts: int = 32,
) -> DataFrame:
    """Equi-join that broadcasts the dimension only when its measured size allows.

    Otherwise both sides are shuffled on the key plus a salt taken from ``spread_by``, so that one
    key holding a large share of the facts is spread over ``salts`` tasks. The salt is a function of
    the row, hence the same when a lost task is run again. NULL key parts are equal. The measured
    size is that of the values; a hash relation takes a few times as much, which the limit leaves
    room for.
    """
    if measured_bytes(dimension) <= limit_bytes:
        joined = same_keys_join(facts, F.broadcast(dimension), on, how).drop("_key")
    else:
        salted_facts = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
        salted_dimension = dimension.withColumn(
            "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
        )
        joined = same_keys_join(salted_facts, salted_dimension, on + ["_salt"], how).drop("_salt", "_key")
    return joined if extra is None else joined.where(extra)
