"""Session settings the library relies on."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def use_utc(spark: SparkSession) -> SparkSession:
    """All stored timestamps are UTC; bins and date partitions must not depend on the host zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def use_disk_state(spark: SparkSession) -> SparkSession:
    """Streams keep their state on disk, with its changes in the checkpoint, instead of in memory."""
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Where that is unset, a folder of the warehouse, which executors share as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return named.rstrip("/")


_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def run_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder. Inside ``owned_folders`` it belongs to that run."""
    folder = f"{shared_dir(spark)}/driftwatch-{uuid.uuid4().hex}"
    if _owned.get() is not None:
        _owned.get().append(folder)
    return folder


@contextmanager
def owned_folders(spark: SparkSession) -> Iterator[None]:
    """Folders made inside are removed at the end, also of a run that fails. What outlives the run must
    have been written elsewhere by then."""
    from driftwatch.sources import storage

    folders: list[str] = []
    before = _owned.set(folders)
    try:
        yield
    finally:
        _owned.reset(before)
        for folder in folders:
            storage.delete(spark, folder)


def pin(df: DataFrame, path: str | None = None, rows_per_file: int = 0, compression: str | None = None) -> DataFrame:
    """Compute a small frame once and keep it as a table in the shared folder, where it outlives
    executors. Branches of one job that start from a pinned frame have equal plans, so they share
    shuffles; numbers given out while it is computed stay the same.

    ``path``: a folder made before, where it is to outlive the ``owned_folders`` around. ``rows_per_file``
    bounds the rows of a file, and so of a task that reads it (files count as 4 MB at least), where rows
    are far wider in memory than as Parquet. ``compression``: a codec other than the session's.

    What the write has shuffled is removed with its end, since only the table is read later."""
    spark = df.sparkSession
    path = path or run_dir(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("maxRecordsPerFile", rows_per_file).parquet(path, compression=compression)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
