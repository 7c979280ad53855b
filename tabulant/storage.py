"""Where intermediate tables go, the shared folder the cluster names for checkpoints, and how long they stay."""

from __future__ import annotations

import contextlib
import re
import time
import uuid
import warnings
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folder of all intermediate tables, and what a table's folder name ends in, a file beside it included.
TABLES = "tabulant-tables"
_OWN = re.compile(r"-[0-9a-f]{32}(_[A-Za-z]+)?$")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, else one in its warehouse, with a warning where executors are on other machines."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        warnings.warn("spark.checkpoint.dir is not set; tables go to the warehouse, which all executors must share", stacklevel=2)
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tabulant-intermediate"


class Owned:
    """Paths that are removed when their owner closes."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, path: str) -> None:
        """Leave a path where it is, so that it outlives its owner."""
        self.paths.remove(path)

    def close(self) -> None:
        """Remove what is owned, the latest first. What could not be removed stays owned, and the first error is raised."""
        failed, first = [], None
        while self.paths:
            path = self.paths.pop()
            try:
                _remove(self.spark, path)
            except Exception as error:
                failed, first = [path, *failed], first or error
        self.paths = failed
        if first:
            raise first


_OWNERS: ContextVar[tuple[Owned, ...]] = ContextVar("owners", default=())


@contextlib.contextmanager
def lifetime(spark: SparkSession) -> Iterator[Owned]:
    """Own the tables that are made inside the block, and remove them at its end, also after a failure.

    Results that read them must be used or written inside. The innermost block owns a table; a table made in another
    thread belongs to none, unless that thread runs in a copy of this context.
    """
    owned = Owned(spark)
    token = _OWNERS.set((*_OWNERS.get(), owned))
    try:
        yield owned
    finally:
        _OWNERS.reset(token)
        owned.close()


def sweep(spark: SparkSession, lease_seconds: float) -> list[str]:
    """Remove the tables that were last written longer ago than a lease, such as those of sessions that were lost.

    The lease must be longer than any job that uses the folder. Only folders that this library made are looked at.
    """
    root = f"{shared_folder(spark)}/{TABLES}"
    if not exists(spark, root):
        return []
    system, place = _located(spark, root)
    oldest = (time.time() - lease_seconds) * 1000
    # A name each is listed; what is in the tables isn't.
    stale = [s.getPath().toString() for s in system.listStatus(place) if s.getModificationTime() < oldest and _OWN.search(s.getPath().getName())]
    for path in stale:
        _remove(spark, path)
    return stale


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used yet, owned by the innermost lifetime."""
    return beside(f"{shared_folder(spark)}/{TABLES}/{label}-{uuid.uuid4().hex}", "")


def beside(path: str, suffix: str) -> str:
    """A path named like a new one, for what goes with it; owned by the innermost lifetime as well."""
    if _OWNERS.get():
        _OWNERS.get()[-1].paths.append(path + suffix)
    return path + suffix


def _located(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something lies at a path of any file system Spark can reach."""
    system, place = _located(spark, path)
    return system.exists(place)


def _remove(spark: SparkSession, path: str) -> None:
    system, place = _located(spark, path)
    system.delete(place, True)


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """Write a result once and read it back, so that using it several times computes it once."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
