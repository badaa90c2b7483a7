"""Tables that plans are cut at: written to the folder that driver and executors share, read
back, and deleted when they are done with or the driver ends."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="docloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set.

    Unset, a temporary folder serves a local master, whose executor is the driver; any other
    master gets a folder below the warehouse.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return _local_dir()
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_docloom"


#: Tables of the scopes that are open, the innermost last.
_SCOPES: list[list[Stored]] = []


class Stored:
    """A DataFrame written once to the shared folder and read back: lineage is cut and a lost
    executor costs nothing but the reading. The table goes when it is dropped, when the scope
    it was made in ends, or else with the driver's JVM."""

    def __init__(self, df: DataFrame):
        self._spark = df.sparkSession
        self.path = f"{shared_dir(self._spark)}/docloom/{uuid.uuid4().hex}"
        at, store = self._place()
        store.deleteOnExit(at)
        if _SCOPES:
            _SCOPES[-1].append(self)
        df.write.parquet(self.path)
        self.df = self._spark.read.schema(df.schema).parquet(self.path)

    def _place(self):
        at = self._spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at, at.getFileSystem(self._spark._jsc.hadoopConfiguration())

    def drop(self) -> None:
        at, store = self._place()
        store.delete(at, True)
        store.cancelDeleteOnExit(at)


def stored(df: DataFrame) -> DataFrame:
    return Stored(df).df


@contextmanager
def scope() -> Iterator[None]:
    """What is stored within is dropped at the end; so nothing that reads it may outlive it."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for own in _SCOPES.pop():
            own.drop()


def result(make, *args) -> Stored:
    """The DataFrame that `make` returns, stored; what it stored on the way is dropped."""
    held: list[Stored] = []
    with scope():
        held.append(Stored(make(*args)))
        _SCOPES[-1].remove(held[0])
    if _SCOPES:
        _SCOPES[-1].append(held[0])
    return held[0]
