"""Sorted parquet snapshots whose rows have a global position.

The global position of a row is the number of rows in the files before its own plus its
index inside the file. A small table written next to the rows says how many come before each
file, so numbering a snapshot of any size needs no sort, no shuffle and no single-task window over rows,
and no list of files passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from tabulant.columns import HELPER_PREFIX, ORDINAL, Order, named, order_rows
from tabulant.storage import exists, new_path, stored

#: Name of the table of positions in a snapshot's folder; readers of the folder pass over names that begin like this.
POSITIONS = "_positions"
#: More files than this, times a task's number, no task writes.
_FILES_A_TASK = 1_000_000

_FILE, _INDEX, _START = (HELPER_PREFIX + name for name in ("file__", "index__", "start__"))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Read parquet, keeping only the listed columns; no list means all of them."""
    frame = spark.read.parquet(path)
    return frame.select(*(named(c) for c in columns)) if columns else frame


def _file_number(name: Column) -> Column:
    """The place of a written file among all of its folder, from its task and its number in the task; null for other names."""
    task = F.substring_index(F.substring_index(name, "-", 2), "-", -1).try_cast("bigint")
    own = F.substring_index(F.substring_index(name, ".", 1), "-c", -1).try_cast("bigint")
    return F.when(name.startswith("part-"), task * _FILES_A_TASK + own)


@dataclass(frozen=True)
class Snapshot:
    """A parquet folder, how many rows come before each of its files, and the number of all rows.

    ``starts`` holds ``file, path, start, rows`` for each file with rows: by number, or by path if ``numbered`` is not set.
    """

    spark: SparkSession
    path: str
    starts: DataFrame
    row_count: int
    numbered: bool = True

    def _positions(self, frame: DataFrame) -> DataFrame:
        file = _file_number(F.col("_metadata.file_name")) if self.numbered else F.col("_metadata.file_path")
        located = frame.select("*", file.alias(_FILE), F.col("_metadata.row_index").alias(_INDEX))
        starts = self.starts.select(F.col("file").alias(_FILE), F.col("start").alias(_START))
        position = (F.col(_START) + F.col(_INDEX) + 1).alias(ORDINAL)
        return located.join(starts, _FILE).select(*(named(c) for c in frame.columns if c != ORDINAL), position)

    def table(self, columns: Sequence[str] | None = None) -> DataFrame:
        """All rows without positions, for work that does not depend on row order."""
        return read_parquet(self.spark, self.path, columns)

    def frame(self, columns: Sequence[str] | None = None) -> DataFrame:
        """All rows with their 1-based position in the ordinal column."""
        return self._positions(read_parquet(self.spark, self.path, columns))

    def slice(self, start: int, end: int, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows at positions ``start`` (0-based) up to ``end``, reading only the files that hold them."""
        inside = (F.col("start") < end) & (F.col("start") + F.col("rows") > start)
        touched = [r["path"] for r in self.starts.where(inside).orderBy("start").select("path").collect()]
        if not touched:
            return self.frame(columns).where(F.lit(False))
        touched = [f"{self.path}/{name}" for name in touched] if self.numbered else [unquote(name) for name in touched]
        part = self.spark.read.parquet(*touched)
        frame = self._positions(part.select(*(named(c) for c in columns)) if columns else part)
        return frame.where((F.col(ORDINAL) > start) & (F.col(ORDINAL) <= end))


def _running(counts: DataFrame) -> DataFrame:
    """How many rows come before each file; one row a file passes through the window's task."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file", "path", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"), "rows")


def _written_starts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file bigint, path string, start bigint, rows bigint").parquet(f"{path}/{POSITIONS}")


def open_snapshot(spark: SparkSession, path: str) -> Snapshot:
    """Open a stored snapshot by its table of positions.

    A folder without one, written by others, gets its positions from one row count per file, in the order of the
    files' numbers, or of their paths where names hold no numbers or repeat them.
    """
    numbered = True
    if exists(spark, f"{path}/{POSITIONS}"):
        starts = _written_starts(spark, path)
    else:
        counts = stored(_file_rows(spark, path), "files")
        numbered = counts.where("file is null").isEmpty() and counts.groupBy("file").count().where("count > 1").isEmpty()
        if not numbered:
            counts = counts.withColumn("file", F.col("whole_path")).withColumn("path", F.col("whole_path"))
        starts = stored(_running(counts), "positions")
    total = starts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return Snapshot(spark, path, starts, total, numbered)


def _file_rows(spark: SparkSession, path: str) -> DataFrame:
    names = [F.col(f"_metadata.{c}").alias(a) for c, a in (("file_name", "path"), ("file_path", "whole_path"))]
    counts = spark.read.parquet(path).groupBy(*names).agg(F.count(F.lit(1)).alias("rows"))
    return counts.select(_file_number(F.col("path")).alias("file"), "path", "whole_path", "rows")


def _lookup_options(columns: Sequence[str]) -> dict[str, str]:
    """Have parquet keep a Bloom filter of each column's values in every row group, as large as their number asks for."""
    options = {f"parquet.bloom.filter.enabled#{name}": "true" for name in columns}
    return {**options, "parquet.bloom.filter.adaptive.enabled": "true"} if options else {}


def write_snapshot(
    df: DataFrame, order: Order | None = None, path: str | None = None, lookups: Sequence[str] = ()
) -> Snapshot:
    """Write rows in the given order as parquet and open the result.

    The order columns stay out of the stored table unless they are data. Without a path the
    table goes below the session's shared folder. The table of positions is written last, so a folder
    without one is unfinished or not of this library. Filters for single values of the ``lookups`` columns pass over
    row groups without them, however the rows are sorted; a column whose name holds a dot is written without that help.
    """
    target = path or new_path(df.sparkSession, "snapshot")
    rows = order_rows(df, order) if order else df
    rows.drop(ORDINAL).write.mode("errorifexists").options(**_lookup_options(lookups)).parquet(target)
    seen = Observation()
    starts = _running(_file_rows(df.sparkSession, target)).observe(seen, F.sum("rows").alias("rows"))
    starts.write.parquet(f"{target}/{POSITIONS}")
    return Snapshot(df.sparkSession, target, _written_starts(df.sparkSession, target), seen.get["rows"] or 0)
