"""Helpers of the training-data operators: distributed prefix sums, components, word counts, worker set-up."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabulant.storage import stored

#: The characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"

#: Rows an Arrow batch may hold when whole texts go to Python, so that a batch stays small with long texts.
TEXT_ROWS = 256


#: Characters of text that Python code spreads out into arrays at a time.
PART = 1 << 18


def parts_of(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in order, in lists of about ``PART`` characters; a longer text stands alone."""
    part, held = [], 0
    for text in texts:
        if part and held + len(text or "") > PART:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text or "")
    if part:
        yield part


def released() -> None:
    """Give back to the system what a finished task held, so that workers that wait for the next one stay small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def shipped(spark: SparkSession) -> None:
    """Let Python workers import this library: Spark sends them its modules, once a session, whatever they can read."""
    context = spark.sparkContext
    if getattr(context, "_tabulant_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tabulant-")) / "tabulant.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))  # the driver serves it; executors need not reach the folder
    context._tabulant_shipped = True


def python_ready(spark: SparkSession) -> None:
    """Let Python workers import this library and keep their batches of texts small."""
    shipped(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def word_count(text: Column) -> Column:
    """How many words a text has, a word being a run of anything but ``BLANKS``; 0 for null."""
    plain = F.translate(text, BLANKS, " " * len(BLANKS))
    # A word starts where a blank, or the start, is followed by something else.
    words = F.size(F.filter(F.split(plain, " "), lambda w: w != ""))
    return F.when(text.isNull(), F.lit(0)).otherwise(words).cast("long")


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], label: str = "sorted") -> DataFrame:
    """Add, for each name, the sum of its column over all rows that sort before this one.

    The rows are range-sorted and stored with the place they got; each part's sums then give the
    parts' offsets, one row a part, and a window inside each part gives the rest. Rows that tie in
    ``order`` may change places between runs, so callers order by something that decides.
    """
    values = {f"{name}_value": column for name, column in sums.items()}
    placed = stored(df.withColumns(values).orderBy(*order).withColumn("row_place", F.monotonically_increasing_id()), label)
    placed = placed.withColumn("row_part", F.shiftright("row_place", 33))
    before = Window.orderBy("row_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("row_part").orderBy("row_place").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("row_part").agg(*[F.sum(v).alias(v) for v in values])
    offsets = parts.select("row_part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_offset") for v in values])
    rows = placed.withColumns({f"{v}_within": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    return rows.join(offsets, "row_part").select(
        *df.columns, *[(F.col(f"{n}_value_within") + F.col(f"{n}_value_offset")).alias(n) for n in sums]
    )


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b); the root is the smallest node it can reach.

    Union-find by stars: every node hooks its larger neighbours to its smallest one, then its smaller
    ones, until nothing moves. Each round is two aggregations and two joins on nodes, so a hub's
    neighbours are never gathered in one place; rounds grow with the logarithm of the node count.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        wide = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = wide.groupBy("a").agg(F.min("b").alias("low"))
        near = wide.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = stored(near.union(low.select("a", F.col("low").alias("b"))).distinct(), label)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
