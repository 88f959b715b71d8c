"""Monitoring messages: the Kafka and file sources, and the decoder they share."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwatch.schemas import MAX_TEXT, MESSAGE, ORIGIN

SPC = "SPC"
OBSERVABILITY = "OBSERVABILITY"

# Reasons a message or record is put aside.
MALFORMED = "malformed"
UNSUPPORTED = "unsupported_type"
WRONG_VARIANT = "wrong_variant"
BAD_TIMESTAMP = "bad_timestamp"
TOO_LONG = "too_long"
MISSING_FIELD = "missing_field"

# Takes the text of a message in which a field has another type than declared.
UNREADABLE = "_unreadable"


def kafka_options(
    brokers: str,
    topics: list[str],
    group_id: str | None = None,
    username: str | None = None,
    password: str | None = None,
    security_protocol: str | None = None,
    sasl_mechanism: str | None = None,
    overrides: dict[str, str] | None = None,
) -> dict[str, str]:
    """Options of Spark's Kafka source. Offsets live in the query's checkpoint, not in the broker."""
    options = {
        "kafka.bootstrap.servers": brokers,
        "subscribe": ",".join(topics),
        "startingOffsets": "earliest",
        "failOnDataLoss": "true",
    }
    if group_id:
        options["kafka.group.id"] = group_id
    if username and password:
        mechanism = sasl_mechanism or "PLAIN"
        module = "scram.ScramLoginModule" if mechanism.startswith("SCRAM") else "plain.PlainLoginModule"
        quoted = {k: v.replace("\\", "\\\\").replace('"', '\\"') for k, v in (("u", username), ("p", password))}
        options["kafka.security.protocol"] = security_protocol or "SASL_SSL"
        options["kafka.sasl.mechanism"] = mechanism
        options["kafka.sasl.jaas.config"] = (
            f"org.apache.kafka.common.security.{module} required "
            f'username="{quoted["u"]}" password="{quoted["p"]}";'
        )
    elif security_protocol:
        options["kafka.security.protocol"] = security_protocol
    options.update(overrides or {})
    return options


def kafka_stream(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """``value`` text, the broker's ``timestamp``, and the message's topic, partition and offset. Needs
    the Kafka package on the class path."""
    raw = spark.readStream.format("kafka").options(**options).load()
    return raw.select(F.col("value").cast("string").alias("value"), "timestamp", "topic", "partition", "offset")


def _lines(reader_output: DataFrame) -> DataFrame:
    return reader_output.select(
        "value",
        F.col("_metadata.file_modification_time").alias("timestamp"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """JSON messages, one per line, from files that appear in a folder.

    The file's modification time stands in for the broker's timestamp, so a repeated batch sees the
    same times. ``file`` and ``block``, where in the file its split begins, are what ``number_lines`` needs.
    """
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _lines(reader.load(path))


def file_batch(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark.read.text(path))


def number_lines(messages: DataFrame) -> DataFrame:
    """Messages from files with ``line``, their place in the file, in place of ``block``.

    Files stay split among tasks: only the number of rows of each block is summed up per file. The
    number is that of the line however the file was split. For batches, and for the micro-batches of a
    stream, whose rows the two branches read in the same order. The sums, one row for each block, that
    is for each task's part of a file, are broadcast, so messages stay where they are read.
    """
    if "block" not in messages.columns:
        return messages
    messages = messages.withColumn("row", F.monotonically_increasing_id())
    blocks = messages.groupBy("file", "block").agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(
        "file", "block", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    numbered = messages.join(F.broadcast(before), ["file", "block"])
    return numbered.withColumn("line", F.col("row") + F.col("_shift")).drop("block", "row", "_shift")


def _origin(messages: DataFrame) -> list[Column]:
    """Source, part and position of each message."""
    if "offset" in messages.columns:
        found = [F.col("topic"), F.col("partition"), F.col("offset")]
    elif "line" in messages.columns:
        found = [F.col("file"), F.lit(0), F.col("line")]
    else:
        found = [F.lit(None)] * 3
    kinds = ("string", "int", "bigint")
    return [c.cast(kind).alias(name) for c, kind, name in zip(found, kinds, ORIGIN)]


class Decoded(NamedTuple):
    spc: DataFrame
    observability: DataFrame
    rejects: DataFrame


def _any_null(record: str, fields: list[str]) -> Column:
    return F.greatest(*[F.col(f"{record}.{c}").isNull() for c in fields])


def parse_records(messages: DataFrame) -> DataFrame:
    """One row per record of every message, with ``reason`` where it cannot be stored.

    A message that cannot be read, or has a field of another type than declared, gives a single row.
    Every field of a record must be there, but for ``value``: a value that is absent or null is stored as
    NULL, as one that was not measured. Where a text is declared, other JSON is read as its text. Input:
    ``value`` text and, optionally, ``timestamp`` and the columns that the sources give, which
    tell where a record came from.
    """
    messages = number_lines(messages)
    stamp = F.col("timestamp") if "timestamp" in messages.columns else F.current_timestamp()
    parsed = messages.select(
        "value",
        stamp.alias("timestamp"),
        *_origin(messages),
        F.from_json(
            "value", f"{MESSAGE}, {UNREADABLE} string", {"columnNameOfCorruptRecord": UNREADABLE}
        ).alias("m"),
    )
    known = F.col("m.record_type").isin(SPC, OBSERVABILITY)
    unreadable = F.col("m.records").isNull() | F.col(f"m.{UNREADABLE}").isNotNull()
    fault = F.when(F.col("m.record_type").isNull() | (unreadable & known), MALFORMED).when(
        ~known, UNSUPPORTED
    )
    # An empty list of records is valid and stores nothing, hence no outer explode for it.
    placeholder = F.when(fault.isNotNull(), F.array(F.lit(None))).otherwise(F.col("m.records"))
    rows = parsed.select(
        "timestamp",
        *ORIGIN[:3],
        F.col("m.record_type").alias("record_type"),
        fault.alias("fault"),
        F.when(fault.isNotNull(), F.col("value")).alias("value"),
        F.posexplode(placeholder).alias("record", "r"),
    ).select(
        "timestamp",
        *ORIGIN,
        "record_type",
        "fault",
        "value",
        "r",
        F.col("r.SPC.record").alias("spc"),
        F.col("r.OBSERVABILITY.record").alias("obs"),
    )
    is_spc = F.col("record_type") == SPC
    record_missing = F.when(is_spc, F.col("spc").isNull()).otherwise(F.col("obs").isNull())
    created_at = F.try_to_timestamp(F.col("spc.created_at"))
    missing = F.when(is_spc, _any_null("spc", ["name", "repository", "version", "feature"])).otherwise(
        _any_null(
            "obs", ["name", "repository", "version", "request_count", "error_count", "route_metrics"]
        )
    )
    texts = [
        F.coalesce(F.length(F.when(is_spc, F.col(f"spc.{c}")).otherwise(F.col(f"obs.{c}"))), F.lit(0))
        for c in ("name", "repository", "version")
    ] + [F.coalesce(F.length("spc.feature"), F.lit(0))]
    reason = (
        F.when(F.col("fault").isNotNull(), F.col("fault"))
        .when(record_missing, WRONG_VARIANT)
        .when(missing, MISSING_FIELD)
        .when(is_spc & created_at.isNull(), BAD_TIMESTAMP)
        .when(F.greatest(*texts) > MAX_TEXT, TOO_LONG)
    )
    return rows.select(
        "record_type",
        reason.alias("reason"),
        # Only records that are put aside are written out as JSON again.
        F.when(reason.isNotNull(), F.coalesce("value", F.to_json("r"))).alias("raw"),
        F.when(is_spc, created_at).otherwise(F.col("timestamp")).alias("created_at"),
        F.col("timestamp").alias("arrived_at"),
        *ORIGIN,
        F.when(is_spc, F.col("spc")).alias("spc"),
        F.when(~is_spc, F.col("obs")).alias("obs"),
    )


def spc_records(records: DataFrame) -> DataFrame:
    """Kinds are told apart by the record that is present. A filter on the record type would be
    pushed below the decoder and parse every message a second time."""
    return records.where(F.col("reason").isNull() & F.col("spc").isNotNull()).select(
        "created_at",
        *[F.col(f"spc.{c}").alias(c) for c in ("name", "repository", "version", "feature", "value")],
        *ORIGIN,
    )


def observability_records(records: DataFrame) -> DataFrame:
    """The server's clock is not consulted: records get the time their message arrived."""
    return records.where(F.col("reason").isNull() & F.col("obs").isNotNull()).select(
        "created_at",
        *[
            F.col(f"obs.{c}").alias(c)
            for c in ("repository", "name", "version", "request_count", "error_count", "route_metrics")
        ],
        *ORIGIN,
    )


def rejected_records(records: DataFrame) -> DataFrame:
    """What cannot be stored, under the time it arrived."""
    return records.where(F.col("reason").isNotNull()).select(
        "reason", "raw", F.col("arrived_at").alias("created_at"), *ORIGIN
    )


def decode(messages: DataFrame) -> Decoded:
    records = parse_records(messages)
    kinds = (spc_records(records), observability_records(records), rejected_records(records))
    return Decoded(*(k.drop(*ORIGIN) for k in kinds))
