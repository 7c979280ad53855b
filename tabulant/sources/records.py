"""Records of delimited files whose quoted cells may hold line ends.

Such a file cannot be cut at any line end, since that may lie inside a cell. Whether a line ends
inside one depends on where it starts: a quote opens a cell only at a cell's border, and inside
one it closes it unless doubled. So each line is a function on two states, outside and inside,
and so is each run of lines. A first pass gives the function of every split, one row each; composed in
file order, they tell how each split starts. A second pass reads the splits again and finds their
records in a stream, whatever stray quotes they hold, so that text moves nowhere. Only the lines of
records that cross a split border are read once more, moved and put together.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabulant.functions.text import strip
from tabulant.sources.record_stream import IN, KEEPS, OUT, RECORDS_DDL, SPLITS_DDL, TURNS, split_states, whole_records
from tabulant.storage import stored

#: Up to so many splits, of some 200 bytes each, are sent to every task; more are joined by shuffle.
SENT_SPLITS = 200_000


def _ends_inside(value: Column, delimiter: str) -> tuple[Column, Column]:
    """Whether a line ends inside a quoted cell if it starts outside one, and if it starts inside."""
    edge = re.escape(delimiter)
    text = '(?:[^"]|"")*+'
    # Cells up to an open one: quoted with whatever follows the closing quote, plain, or empty.
    cells = rf'(?:(?:"{text}"[^{edge}]*+|[^{edge}"][^{edge}]*+)?+{edge})*+'
    opened = rf'{cells}"{text}\z'
    outside = value.rlike(rf"(?s)\A{opened}")
    inside = value.rlike(rf'(?s)\A{text}(?:\z|"[^{edge}]*+{edge}{opened})')
    return outside, inside


def _lines(spark: SparkSession, files: list[str], delimiter: str) -> DataFrame:
    """Lines with their split, their place in it and what they do to the state; carriage returns stay part of the line."""
    lines = spark.read.option("lineSep", "\n").text(files)
    outside, inside = _ends_inside(F.col("value"), delimiter)
    kind = F.when(outside & inside, IN).when(outside, TURNS).when(inside, KEEPS).otherwise(OUT)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
        "value",
        F.when(F.col("value").contains('"'), kind).otherwise(KEEPS).cast("byte").alias("kind"),
    )


def _joined(parts: str, *order: str):
    """Texts of a group put together again in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, parts))), lambda p: p[parts]), "\n")


def _splits(lines: DataFrame) -> DataFrame:
    """``file, start, before, open, first, last, header`` of every split that holds lines.

    ``before`` is its state at the start, ``open`` whether its last record goes on; ``first`` and ``last`` are the ids of
    the lines at which its records begin.
    """
    flags = lines.select("file", "start", "id", "kind", (strip(F.col("value")) == "").alias("blank"))
    found = stored(flags.mapInArrow(split_states, SPLITS_DDL), "splits")
    # One row a split, so composing a file's splits in one task is bounded by their number.
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    turns = ((F.col("after0") == 1) & (F.col("after1") == 0)).cast("int")
    counted = found.withColumn("turned", F.coalesce(F.sum(turns).over(earlier), F.lit(0)))
    sets = F.when(F.col("after0") == F.col("after1"), F.struct("start", F.col("after0").alias("state"), "turned"))
    placed = counted.withColumn("set", F.max(sets).over(earlier))
    before = (F.coalesce("set.state", F.lit(0)) + F.col("turned") - F.coalesce("set.turned", F.lit(0))) % 2

    def given(name: str) -> Column:
        return F.when(F.col("before") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    return placed.withColumn("before", before).select(
        "file", "start", "before", (given("after") == 1).alias("open"), given("first").alias("first"), given("last").alias("last"), "header"
    )


def split_records(spark: SparkSession, files: list[str], delimiter: str = ",", sent_splits: int = SENT_SPLITS) -> DataFrame:
    """``(file, start, id, text)`` of every record but the headers.

    The splits' rows are sent to all tasks up to ``sent_splits`` of them, some 200 bytes each; beyond that lines meet them by shuffle.
    """
    lines = _lines(spark, files, delimiter)
    splits = stored(_splits(lines), "splits")
    few = splits.count() <= sent_splits
    known = lines.join(F.broadcast(splits) if few else splits, ["file", "start"])
    if not few:
        known = known.sortWithinPartitions("file", "start", "id")
    whole = known.select("file", "start", "id", "value", "kind", "before", "header").mapInArrow(whole_records, RECORDS_DDL)

    # At most two parts a split cross its borders; one that begins a record opens the next group.
    crossing = splits.where((F.col("before") == 1) | F.col("open")).select("file", "start", "open", "first", "last", "header")
    plain = lines.select("file", "start", "id", "value").join(F.broadcast(crossing) if few else crossing, ["file", "start"])
    opens = F.col("open") & F.coalesce(F.col("id") >= F.col("last"), F.lit(False))
    goes_on = F.coalesce(F.col("id") < F.col("first"), F.lit(True))
    parts = plain.where(opens | goes_on).groupBy("file", "start", (~goes_on).cast("int").alias("begins")).agg(
        _joined("value", "id").alias("text"), F.min("id").alias("id"), F.first("header").alias("header")
    )
    in_file = Window.partitionBy("file").orderBy("start", "begins")
    grouped = parts.withColumn("group", F.sum("begins").over(in_file))
    first = F.min(F.struct("start", "id", "header", "begins"))
    stitched = grouped.groupBy("file", "group").agg(first.alias("first"), _joined("text", "start", "begins").alias("text"))
    stitched = stitched.where(~F.coalesce(F.col("first.id") == F.col("first.header"), F.lit(False)))
    return whole.unionByName(stitched.select("file", "first.start", "first.id", "text"))
