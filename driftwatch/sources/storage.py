"""Folders of the store a path names, through the file systems Spark itself uses."""

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _at(spark, path)
    return store.exists(place)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it does not exist."""
    store, place = _at(spark, path)
    if not store.exists(place):
        return []
    return sorted(s.getPath().getName() for s in store.listStatus(place) if s.isDirectory())


def delete(spark: SparkSession, path: str) -> None:
    store, place = _at(spark, path)
    store.delete(place, True)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a pattern, in one call."""
    store, place = _at(spark, pattern)
    return sorted(s.getPath().toString() for s in store.globStatus(place) or [])


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder; none if it does not exist. Names that begin with a mark are left out."""
    store, place = _at(spark, path)
    if not store.exists(place):
        return []
    names = [s.getPath().getName() for s in store.listStatus(place) if s.isFile()]
    return sorted(n for n in names if n[0] not in "_.")


def move(spark: SparkSession, path: str, to: str) -> bool:
    store, place = _at(spark, path)
    return store.rename(place, spark._jvm.org.apache.hadoop.fs.Path(to))


def read_text(spark: SparkSession, path: str) -> str:
    store, place = _at(spark, path)
    stream = store.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write(store, place, text: str) -> None:
    out = store.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str = "") -> None:
    """A small file, replacing one of this name."""
    _write(*_at(spark, path), text)


def commit(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file with this text unless one of its name exists; of several writers one succeeds.

    The text is written aside and takes its name in one step, so nobody reads half of it. A store's
    rename of a file must fail where the name is taken, as that of HDFS does; local files, whose
    rename replaces, are linked instead.
    """
    store, place = _at(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_{uuid.uuid4().hex}")
    _write(store, aside, text)
    try:
        if store.getScheme() != "file":
            return not store.exists(place) and store.rename(aside, place)
        files_ = spark._jvm.java.nio.file.Files
        local = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
        files_.createLink(local(place), local(store.makeQualified(aside)))
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        return False
    finally:
        store.delete(aside, False)


def unchanged_for(spark: SparkSession, path: str, seconds: float) -> bool:
    """Whether a file or folder was last changed at least so long ago."""
    store, place = _at(spark, path)
    return store.getFileStatus(place).getModificationTime() < (time.time() - seconds) * 1000
