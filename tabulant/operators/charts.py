"""The data behind each chart."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabulant.columns import Order, named, order_rows, own_order
from tabulant.functions.casts import number

BINS = 10
CHARTS = ("line", "pie", "bar", "stacked bar", "histogram", "scatter")

# Why a chart cannot be built.
NOTHING_CHOSEN = "Select both dimension and measure."
NOT_AVAILABLE = "Selected fields are not available in the dataset."
STACKED_NEEDS_COLOR = "Stacked Bar requires a second dimension."
SCATTER_NEEDS_COLOR = "Scatter uses second dimension for color grouping."
UNSUPPORTED = "Unsupported chart type: "


def _check(df: DataFrame, kind: str, dimension: str | None, measure: str | None, color: str | None) -> str:
    if not dimension or not measure:
        raise ValueError(NOTHING_CHOSEN)
    if any(c not in df.columns for c in (dimension, measure, *([color] if color else []))):
        raise ValueError(NOT_AVAILABLE)
    key = kind.strip().lower()
    if key not in CHARTS:
        raise ValueError(UNSUPPORTED + kind)
    if key == "stacked bar" and not color:
        raise ValueError(STACKED_NEEDS_COLOR)
    if key == "scatter" and not color:
        raise ValueError(SCATTER_NEEDS_COLOR)
    return key


def _points(df: DataFrame, dimension: str, measure: str, color: str | None) -> DataFrame:
    """Only the used columns, under fixed names, where the measure is readable."""
    parts = [named(dimension).alias("dimension"), number(df, measure).alias("measure")]
    if color:
        parts.append(named(color).alias("color"))
    return df.select(*parts).where(F.col("measure").isNotNull())


def _sums(points: DataFrame, *by: str) -> DataFrame:
    return points.groupBy(*by).agg(F.sum("measure").alias("measure"))


def bar(df: DataFrame, dimension: str, measure: str, color: str | None = None) -> DataFrame:
    """Sum per dimension value, null as a value of its own; per pair where a color is given."""
    by = ["dimension", "color"] if color else ["dimension"]
    return _sums(_points(df, dimension, measure, color), *by).orderBy(*(F.asc_nulls_last(c) for c in by))


def pie(df: DataFrame, dimension: str, measure: str, color: str | None = None) -> DataFrame:
    """Sum per dimension value and its share of the total."""
    sums = _sums(_points(df, dimension, measure, None), "dimension")
    total = sums.agg(F.sum("measure")).scalar()
    return sums.withColumn("share", F.try_divide(F.col("measure"), total)).orderBy(F.asc_nulls_last("dimension"))


def line(
    df: DataFrame, dimension: str, measure: str, color: str | None = None, order: Order | None = None
) -> DataFrame:
    """Every point in row order."""
    value = number(df, measure)
    parts = [named(dimension).alias("dimension"), value.alias("measure")]
    if color:
        parts.append(named(color).alias("color"))
    kept = df.where(value.isNotNull())
    return order_rows(kept, order or own_order(kept)).select(*parts)


def scatter(df: DataFrame, dimension: str, measure: str, color: str) -> DataFrame:
    """Every point with its color group."""
    return _points(df, dimension, measure, color)


def histogram(df: DataFrame, dimension: str, measure: str, bins: int = BINS) -> DataFrame:
    """Counts per dimension value and equal-width bin; bins are half-open but for the last.

    Bounds are those of the finite values. Infinite ones have bins of their own, -1 below the others
    and ``bins`` above, whose two ends are infinite.
    """
    points = _points(df, dimension, measure, None)
    infinite = F.lit(float("inf"))
    finite = F.when(F.abs(number(df, measure)) < infinite, number(df, measure))
    bounds = df.agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    width = (hi - lo) / float(bins)
    at = F.coalesce(F.floor((F.col("measure") - lo) / F.when(width > 0, width)), F.lit(0))
    beyond = F.when(F.col("measure") == infinite, F.lit(bins)).when(F.col("measure") == -infinite, F.lit(-1))
    place = beyond.otherwise(F.least(at, F.lit(bins - 1)).cast("int"))
    counted = points.groupBy("dimension", place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    outer = F.when(F.col("bin") == bins, infinite).when(F.col("bin") == -1, -infinite)
    low = outer.otherwise(lo + F.col("bin") * width)
    high = outer.when(F.col("bin") == bins - 1, hi).otherwise(lo + (F.col("bin") + 1) * width)
    return counted.select("dimension", "bin", low.alias("bin_low"), high.alias("bin_high"), "count")


def chart_data(
    df: DataFrame,
    kind: str,
    dimension: str | None,
    measure: str | None,
    color: str | None = None,
    order: Order | None = None,
    bins: int = BINS,
) -> DataFrame:
    """The data of the named chart; a ``ValueError`` says what is missing."""
    key = _check(df, kind, dimension, measure, color)
    if key == "line":
        return line(df, dimension, measure, color, order)
    if key == "histogram":
        return histogram(df, dimension, measure, bins)
    build = {"pie": pie, "bar": bar, "stacked bar": bar, "scatter": scatter}[key]
    return build(df, dimension, measure, color)
