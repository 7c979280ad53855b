"""Values and ranges offered for filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tabulant.columns import text
from tabulant.functions.casts import number
from tabulant.functions.display import display_number, float_text
from tabulant.functions.text import strip

RANGES = 10


def dimension_values(df: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """Distinct trimmed values in order, blanks left out: all, or the first ``limit`` of them."""
    if name not in df.columns:
        return df.sparkSession.createDataFrame([], "value string")
    values = df.select(strip(text(df, name)).alias("value")).where(F.col("value") != "")
    listed = values.distinct().orderBy("value")
    return listed if limit is None else listed.limit(limit)


def measure_ranges(df: DataFrame, name: str, ranges: int = RANGES) -> DataFrame:
    """Equal-width ranges from minimum to maximum, with typed bounds, expression and label.

    One range where all values are equal, none where no value is readable. Infinite values are in no range.
    """
    if name not in df.columns:
        return df.sparkSession.createDataFrame(
            [], "position int, low double, high double, expression string, label string"
        )
    values = df.select(number(df, name).alias("x")).where(F.abs("x") < float("inf"))
    bounds = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where(F.col("lo").isNotNull())
    last = F.when(F.col("lo") == F.col("hi"), 0).otherwise(ranges - 1)
    step = (F.col("hi") - F.col("lo")) / float(ranges)
    placed = bounds.select("lo", "hi", step.alias("step"), F.explode(F.sequence(F.lit(0), last)).alias("position"))
    low = F.col("lo") + F.col("position") * F.col("step")
    high = F.when(F.col("lo") == F.col("hi"), F.col("hi")).when(F.col("position") == ranges - 1, F.col("hi"))
    high = high.otherwise(F.col("lo") + (F.col("position") + 1) * F.col("step"))
    sized = placed.select("position", low.alias("low"), high.alias("high"))
    expression = F.concat(F.lit("between "), float_text(F.col("low")), F.lit(" and "), float_text(F.col("high")))
    ends = [display_number(F.col(c), T.DoubleType()) for c in ("low", "high")]
    return sized.select("position", "low", "high", expression.alias("expression"), F.concat_ws(" to ", *ends).alias("label"))
