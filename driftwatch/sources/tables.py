"""Date-partitioned Parquet tables under one root folder."""

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftwatch import schemas
from driftwatch.functions.timewin import as_timestamp, day_of, look_back, since
from driftwatch.operators.series import of_service
from driftwatch.sources import storage
from driftwatch.sources.keys import KeyIndex

# Days each table is kept.
RETENTION_DAYS = {"drift": 7, "observability": 14, "alerts": 21}
# Rejects are kept as long as the metrics they may belong to, errors of checks as long as alerts.
RETENTION_DAYS |= {"rejects": 14, "errors": 21}

_STORED = f"{schemas.ORIGIN_TYPES}, event_date date, ingest_batch string"
SCHEMAS = {
    "drift": f"{schemas.DRIFT}, {_STORED}",
    "observability": f"{schemas.OBSERVABILITY}, {_STORED}",
    "rejects": f"reason string, raw string, created_at timestamp, {_STORED}",
    "alerts": schemas.ALERT + ", event_date date",
    "errors": "repository string, name string, version string, reason string, created_at timestamp, event_date date, run string",
    "profiles": schemas.PROFILE + ", snapshot bigint",
    "bins": f"{schemas.BINS}, event_date date, ingest_batch string",
    "requests": f"{schemas.REQUESTS}, event_date date, ingest_batch string",
}
BATCHED = ("drift", "observability", "rejects", "bins", "requests")
SORTED_BY = ["name", "repository", "version", "created_at"]
MERGED = "ingest_batch=merged-"
#: Files a log keeps.
KEPT_NUMBERS = 10


def added_up(name: str, parts: DataFrame) -> DataFrame:
    """Rows of a rollup with equal keys as one, with the sums of what they add."""
    keys, sums = schemas.ADDITIVE[name]
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def with_event_date(df: DataFrame) -> DataFrame:
    return df.withColumn("event_date", F.to_date("created_at"))


def scan_since(table: DataFrame, moment, service: dict | None = None, inclusive=False) -> DataFrame:
    """Rows of a service after a moment. The date bound prunes folders, the rest reaches Parquet."""
    rows = table
    if "event_date" in table.columns:
        rows = rows.where(F.col("event_date") >= day_of(moment))
    return of_service(rows, service).where(since("created_at", moment, inclusive))


def scan_window(table: DataFrame, minutes: int, now, service: dict | None = None) -> DataFrame:
    rows = table
    if "event_date" in table.columns:
        start = as_timestamp(now) - F.make_dt_interval(mins=F.lit(minutes))
        rows = rows.where(F.col("event_date") >= F.to_date(start))
    return of_service(rows, service).where(look_back("created_at", minutes, now))


def apply_retention(table: DataFrame, days: int, now) -> DataFrame:
    """Whole days still kept. On a stored table this reads no file of a dropped day."""
    dated = table if "event_date" in table.columns else with_event_date(table)
    return dated.where(F.col("event_date") >= F.date_sub(day_of(now), days))


def expired_days(table: DataFrame, days: int, now) -> DataFrame:
    """The partitions a clean-up job may drop."""
    return (
        table.select("event_date").distinct().where(F.col("event_date") < F.date_sub(day_of(now), days))
    )


def _filters(columns: list[str]) -> dict[str, str]:
    """Bloom filters on the service key: a lookup of one service skips row groups without it, also where
    the key lies between the least and the largest in them."""
    return {f"parquet.bloom.filter.enabled#{c}": "true" for c in schemas.SERVICE if c in columns}


class Tables:
    """The stored tables.

    Values, metrics and rejects are stored batch by batch in folders of their day. What happened to a
    batch is kept in a small file, ``_batches/<name>``: it was begun, is done, or is merged with others.
    Profiles are kept as whole snapshots, and a log of numbered files names the folder of each. A
    number is taken in one step by one writer, so nothing has to be locked, waited for or cleaned up
    after a writer that died: a folder that no log file names is not part of a table.
    """

    def __init__(self, spark: SparkSession, root: str, key_buckets: int | None = None):
        """``key_buckets``: keep an index of the keys of stored values in so many buckets a day, which an
        ingest meets in place of the values. Give the same number each time."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.keys = KeyIndex(spark, self.path("drift_keys"), key_buckets) if key_buckets else None

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        """The table, empty when nothing has been stored yet; of profiles the newest snapshot."""
        if name == "profiles":
            return self._snapshot(self._newest("profiles"))
        while True:
            self.finish_merges(name)
            try:
                table = self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
                return self.spark.createDataFrame([], SCHEMAS[name])
            # Folders were listed just now; where a merge was decided meanwhile, list them again.
            if not storage.files(self.spark, f"{self.path(name)}/_merges"):
                return table

    # Batches

    def _escaped(self, batch: str) -> str:
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(batch)

    def _mark(self, name: str, batch: str) -> str:
        return f"{self.path(name)}/_batches/b-{self._escaped(batch)}"

    def batch_state(self, name: str, batch: str) -> str | None:
        """``begun``, ``done``, ``merged``, or None for a batch that has not been stored."""
        mark = self._mark(name, batch)
        return storage.read_text(self.spark, mark) if storage.exists(self.spark, mark) else None

    def write_batch(self, name: str, rows: DataFrame, batch: str) -> None:
        """Stores one ingest batch; storing it again replaces it, also after a crash half way. A batch
        that has been merged with others was complete, and is left as it is.

        The rebalance brings the rows of a day together and lets adaptive execution merge small
        parts and split large ones, so files come out evenly sized even where one day holds most
        rows. Sorting by service keeps row-group statistics selective.
        """
        if not self.begin_batch(name, batch):
            return
        dated = with_event_date(rows).withColumn("ingest_batch", F.lit(batch))
        (
            dated.hint("rebalance", F.col("event_date"))
            .sortWithinPartitions("event_date", *[c for c in SORTED_BY if c in rows.columns])
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .options(**_filters(rows.columns))
            .partitionBy("event_date", "ingest_batch")
            .parquet(self.path(name))
        )
        storage.write_text(self.spark, self._mark(name, batch), "done")
        storage.delete(self.spark, self._open(name, batch))

    def _open(self, name: str, batch: str) -> str:
        return f"{self.path(name)}/_open/b-{self._escaped(batch)}"

    def open_batches(self, name: str) -> list[str]:
        """Batches that have been begun and are not done."""
        folder = f"{self.path(name)}/_open"
        return [storage.read_text(self.spark, f"{folder}/{f}") for f in storage.files(self.spark, folder)]

    def begin_batch(self, name: str, batch: str) -> bool:
        """Marks a batch as begun and removes what an earlier attempt has stored of it; False if it has
        been merged with others, and so was complete."""
        self.finish_merges(name)
        state = self.batch_state(name, batch)
        if state == "merged":
            return False
        storage.write_text(self.spark, self._open(name, batch), batch)
        storage.write_text(self.spark, self._mark(name, batch), "begun")
        if state:  # also on days that the rows no longer touch
            for folder in storage.matching(self.spark, f"{self.path(name)}/event_date=*/ingest_batch={self._escaped(batch)}"):
                storage.delete(self.spark, folder)
        return True

    # Merging the batches of a day

    def merge_day(self, name: str, day, least: int = 2) -> bool:
        """Rewrites the complete batches of a day into one; whether there were ``least`` of them. Of
        rollups, rows with equal keys become one.

        The rows are written to a hidden folder. A file in ``_merges`` with its name and the names of
        the batches it replaces then decides the merge at one stroke, and ``finish_merges``, which every
        read and write runs first, makes the folders look so. A crash before the file leaves the
        batches, one after it the merged rows. Batches of which a writer may still be at work are left
        alone; merge days that have passed.
        """
        self.finish_merges(name)
        folder = f"{self.path(name)}/event_date={day}"
        names = [n for n in storage.folders(self.spark, folder) if n.startswith("ingest_batch=") and self._complete(name, n)]
        if len(names) < least:
            return False
        hidden = f"_merge-{uuid.uuid4().hex}"
        stored = StructType.fromDDL(SCHEMAS[name])
        plain = StructType([f for f in stored if f.name not in ("event_date", "ingest_batch")])
        rows = self.spark.read.schema(plain).parquet(*[f"{folder}/{n}" for n in names])
        if name in schemas.ADDITIVE:
            rows = added_up(name, rows).select(*plain.names)
        rows = rows.hint("rebalance").sortWithinPartitions(*[c for c in SORTED_BY if c in plain.names])
        rows.write.options(**_filters(plain.names)).parquet(f"{folder}/{hidden}")
        plan = json.dumps({"day": str(day), "hidden": hidden, "names": names})
        decided = storage.commit(self.spark, f"{self.path(name)}/_merges/{day}", plan)
        if not decided:  # another one merges the day
            storage.delete(self.spark, f"{folder}/{hidden}")
        self.finish_merges(name)
        return decided

    def merge_days(self, name: str, before, least: int = 2) -> list[str]:
        """Merges the batches of every day before ``before``, and names the days."""
        days = [d[11:] for d in storage.folders(self.spark, self.path(name)) if d.startswith("event_date=2")]
        return [d for d in days if d < str(before) and self.merge_day(name, d, least)]

    def _complete(self, name: str, folder: str) -> bool:
        if folder.startswith(MERGED):
            return True
        mark = f"{self.path(name)}/_batches/b-{folder.removeprefix('ingest_batch=')}"
        return storage.exists(self.spark, mark) and storage.read_text(self.spark, mark) != "begun"

    def finish_merges(self, name: str) -> None:
        """Carries out the merges that were decided. Any number of callers may do so at once.

        Replaced batches are removed only after the merged one has its place. So where one of them is
        gone and the merged one still hidden, an earlier merge took it, and this one is void.
        """
        merges = f"{self.path(name)}/_merges"
        for file in storage.files(self.spark, merges):
            plan = json.loads(storage.read_text(self.spark, f"{merges}/{file}"))
            folder = f"{self.path(name)}/event_date={plan['day']}"
            hidden = f"{folder}/{plan['hidden']}"
            if storage.exists(self.spark, hidden):
                if not all(storage.exists(self.spark, f"{folder}/{n}") for n in plan["names"]):
                    storage.delete(self.spark, hidden)
                    storage.delete(self.spark, f"{merges}/{file}")
                    continue
                storage.move(self.spark, hidden, f"{folder}/{MERGED}{plan['hidden'].removeprefix('_merge-')}")
            for n in plan["names"]:
                if not n.startswith(MERGED):
                    storage.write_text(self.spark, f"{self.path(name)}/_batches/b-{n.removeprefix('ingest_batch=')}", "merged")
                storage.delete(self.spark, f"{folder}/{n}")
            storage.delete(self.spark, f"{merges}/{file}")

    # Alerts and errors of checks

    def append_alerts(self, alerts: DataFrame) -> None:
        with_event_date(alerts).write.mode("append").partitionBy("event_date").parquet(self.path("alerts"))

    def reserve_alert_ids(self, n: int, attempts: int = 20) -> int:
        """Takes the next ``n`` alert ids and returns the id before them.

        The last id given out is kept in a log of its own, whose next file one writer takes at one
        stroke, before any alert is stored. Ids are therefore given once, in whatever order alerts
        are raised and whatever is removed; a writer that dies leaves a gap. A log stored without such
        files is read once, whole, for its largest id.
        """
        log = f"{self.path('alerts')}/_log"
        for _ in range(attempts):
            number, text = self._newest("alerts")
            last = int(text) if text else self.read("alerts").agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
            if n == 0:
                return last
            if self._take(log, number + 1, str(last + n)):
                for old in storage.files(self.spark, log)[:-KEPT_NUMBERS]:
                    storage.delete(self.spark, f"{log}/{old}")
                return last
        raise RuntimeError("other writers took every number that was tried")

    def append_errors(self, errors: DataFrame, at) -> DataFrame:
        """Stores the errors of a run and returns them as stored."""
        run = uuid.uuid4().hex
        rows = errors.withColumn("created_at", as_timestamp(at)).withColumn("run", F.lit(run))
        with_event_date(rows).write.mode("append").partitionBy("event_date", "run").parquet(self.path("errors"))
        return self.read("errors").where(F.col("run") == run).select(*errors.columns)

    # Numbers that one writer takes

    def _newest(self, name: str) -> tuple[int, str | None]:
        """The newest number of a table's log and what its file says."""
        names = storage.files(self.spark, f"{self.path(name)}/_log")
        return (int(names[-1]), storage.read_text(self.spark, f"{self.path(name)}/_log/{names[-1]}")) if names else (0, None)

    def _take(self, log: str, number: int, text: str) -> bool:
        """Takes a number, unless another writer has it. A number whose file was cleaned up is free
        again, but then at least ``KEPT_NUMBERS`` later ones are taken, and it counts as taken too."""
        file = f"{log}/{number:020d}"
        if not storage.commit(self.spark, file, text):
            return False
        if int(storage.files(self.spark, log)[-1]) < number + KEPT_NUMBERS:
            return True
        storage.delete(self.spark, file)
        return False

    # Profiles

    def _snapshot(self, newest: tuple[int, str | None]) -> DataFrame:
        number, folder = newest
        if folder is None:
            return self.spark.createDataFrame([], SCHEMAS["profiles"])
        rows = self.spark.read.schema(schemas.PROFILE).parquet(f"{self.path('profiles')}/{folder}")
        return rows.withColumn("snapshot", F.lit(number).cast("bigint"))

    def write_profiles(self, profiles: DataFrame) -> None:
        """Stores a new snapshot whatever the newest one holds."""
        self.change_profiles(lambda _: profiles.drop("snapshot"))

    def change_profiles(self, change: Callable[[DataFrame], DataFrame], attempts: int = 20) -> None:
        """Applies ``change`` to the newest snapshot and stores the result as the next one.

        The rows are written to a folder of their own, and the log then names it under the next number.
        Readers never see a half-written table. Where another writer has taken the number in the
        meantime, the change is made again on what that one stored.
        """
        log = f"{self.path('profiles')}/_log"
        for _ in range(attempts):
            newest = self._newest("profiles")
            rows = change(self._snapshot(newest).drop("snapshot"))
            folder = f"data-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path('profiles')}/{folder}")
            if self._take(log, newest[0] + 1, folder):
                return
            storage.delete(self.spark, f"{self.path('profiles')}/{folder}")
        raise RuntimeError("other writers took every number that was tried")

    # Clean-up

    def drop_expired(self, name: str, now) -> list[str]:
        """Removes the folders of days that have outlived their retention, and names them. What is known
        of batches goes too, a day after them."""
        last = self.spark.range(1).select(F.date_sub(day_of(now), RETENTION_DAYS[name]).cast("string")).first()[0]
        days = [d for d in storage.folders(self.spark, self.path(name)) if d.startswith("event_date=")]
        old = [d for d in days if d[11:] < last]
        for day in old:
            storage.delete(self.spark, f"{self.path(name)}/{day}")
            if name == "drift" and self.keys is not None:
                storage.delete(self.spark, f"{self.keys.path}/{day}")
        marks = f"{self.path(name)}/_batches"
        for file in storage.files(self.spark, marks):
            if storage.unchanged_for(self.spark, f"{marks}/{file}", (RETENTION_DAYS[name] + 1) * 86_400):
                storage.delete(self.spark, f"{marks}/{file}")
        return [d[11:] for d in old]

    def drop_snapshots(self, keep: int = KEPT_NUMBERS) -> None:
        """Removes all but the newest snapshots of the profiles, and what writers that died have left."""
        path = self.path("profiles")
        names = storage.files(self.spark, f"{path}/_log")
        for number in names[:-keep]:
            storage.delete(self.spark, f"{path}/{storage.read_text(self.spark, f'{path}/_log/{number}')}")
            storage.delete(self.spark, f"{path}/_log/{number}")
        named = {storage.read_text(self.spark, f"{path}/_log/{n}") for n in names[-keep:]}
        for folder in storage.folders(self.spark, path):
            if folder.startswith("data-") and folder not in named and storage.unchanged_for(self.spark, f"{path}/{folder}", 86_400):
                storage.delete(self.spark, f"{path}/{folder}")
