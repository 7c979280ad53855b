"""Exact medians of many columns without sorting any of them whole.

Each round counts values in a fixed number of buckets between the known bounds of every
column and keeps, per column, only the bucket that holds its middle rank. Bucketing is
monotone, so the kept bucket is exact, not a guess. Rounds take turns between even and
logarithmic buckets, so wide and narrow spreads both close in fast. A round shuffles bucket counts only.
Once few enough values are left between the bounds, the middle ones are picked by rank.

Callers that aggregate anyway can add a quantile sketch, which gives each column a narrow bracket around
its median. One pass then counts what lies below it and the values in it, and the ranks say whether
the sketch was right: the median is exact, or the column goes through the rounds. Two passes in all.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = 2048
# The sketch's ranks are off by at most one in so many values.
SKETCH = 10_000
# At most this many values of one column are ranked in one task.
RANKED_VALUES = 100_000

_INFINITY = float("inf")
_LARGEST = 1.7976931348623157e308


@dataclass(frozen=True)
class _Search:
    """The values of one column between ``low`` and ``high``, where its middle ranks lie."""

    low: float
    high: float
    below: int
    inside: int
    first: int
    second: int

    @property
    def ranks(self) -> tuple[int, int]:
        """Its middle ranks among the values inside."""
        return self.first - self.below, self.second - self.below


def _long(df: DataFrame, columns: Mapping[int, Column], searches: Mapping[int, _Search]) -> DataFrame:
    """The values still in question as ``(at, x)`` rows, ``at`` counting the searches."""
    cells: list[Column] = []
    for at, (key, search) in enumerate(searches.items()):
        value = F.col(f"v{key}")
        cells += [F.lit(at), F.when(value.between(F.lit(search.low), F.lit(search.high)), value)]
    values = df.select(*(columns[key].alias(f"v{key}") for key in searches))
    return values.select(F.stack(F.lit(len(searches)), *cells).alias("at", "x")).where(F.col("x").isNotNull())


def _constants(values: list) -> Column:
    """One constant per search, looked up by position."""
    return F.get(F.array(*(F.lit(v) for v in values)), F.col("at"))


def _logarithm(x: float) -> float:
    return 0.0 if x == 0 else math.copysign(math.log(abs(x)) + 745, x)


def _bucket(searches: list[_Search], spread: bool) -> Column:
    """Bucket number, growing with the value; infinities sit in buckets of their own.

    With even buckets the two ends always part, so at least every second round makes progress.
    """
    x = F.col("x")
    bounds = [(max(s.low, -_LARGEST), min(s.high, _LARGEST)) for s in searches]
    if spread:
        # Logarithms of doubles stay above -745, so this scale grows with x through zero.
        scaled = F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.ln(F.abs(x)) + 745))
        bounds = [(_logarithm(low), _logarithm(high)) for low, high in bounds]
    else:
        shrink = [0.5 if high - low == _INFINITY else 1.0 for low, high in bounds]
        scaled = x * _constants(shrink)
        bounds = [(low * c, high * c) for (low, high), c in zip(bounds, shrink)]
    width = _constants([high - low if high > low else 1.0 for low, high in bounds])
    place = (scaled - _constants([low for low, _ in bounds])) / width * BUCKETS
    # Clamped, because logarithms may differ in their last digit from the ones above.
    inner = F.greatest(F.lit(0.0), F.least(place, F.lit(BUCKETS - 1.0))).cast("int")
    return F.when(x == _INFINITY, F.lit(BUCKETS)).when(x == -_INFINITY, F.lit(-1)).otherwise(inner)


def _narrow(
    df: DataFrame, columns: Mapping[int, Column], searches: dict[int, _Search], spread: bool
) -> dict[int, object]:
    """One round: per column either its median or a tighter search."""
    order = list(searches.values())
    counts = (
        _long(df, columns, searches)
        .groupBy("at", _bucket(order, spread).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    )
    placed = counts.withColumn("after", F.sum("n").over(Window.partitionBy("at").orderBy("bucket")))
    before = F.col("after") - F.col("n")
    first, second = (_constants([s.ranks[i] for s in order]) for i in (0, 1))
    holds = ((first < F.col("after")) & (first >= before)) | ((second < F.col("after")) & (second >= before))
    kept: dict[int, list] = {}
    for row in placed.where(holds).orderBy("at", "bucket").collect():
        kept.setdefault(row["at"], []).append(row)
    result: dict[int, object] = {}
    for at, (key, search) in enumerate(searches.items()):
        rows = kept[at]
        if len(rows) == 2:
            result[key] = (rows[0]["high"] + rows[1]["low"]) / 2
        elif rows[0]["low"] == rows[0]["high"]:
            result[key] = rows[0]["low"]
        else:
            (row,) = rows
            below = search.below + row["after"] - row["n"]
            result[key] = replace(search, low=row["low"], high=row["high"], below=below, inside=row["n"])
    return result


def _pick(df: DataFrame, columns: Mapping[int, Column], searches: dict[int, _Search]) -> dict[int, float]:
    """Rank the few values left of each column and average the middle ones."""
    order = list(searches.values())
    rank = F.row_number().over(Window.partitionBy("at").orderBy("x")) - 1
    ranked = _long(df, columns, searches).withColumn("rank", rank)
    first, second = (_constants([s.ranks[i] for s in order]) for i in (0, 1))
    found: dict[int, list[float]] = {}
    for row in ranked.where((F.col("rank") == first) | (F.col("rank") == second)).collect():
        found.setdefault(row["at"], []).append(row["x"])
    keys = list(searches)
    return {keys[at]: x[0] if min(x) == max(x) else (min(x) + max(x)) / 2 for at, x in found.items()}


def bracket(value: Column) -> Column:
    """An aggregate: two values that enclose the median, with few others between them."""
    return F.percentile_approx(value, [0.5 - 2 / SKETCH, 0.5 + 2 / SKETCH], SKETCH)


def _in_brackets(
    df: DataFrame, columns: Mapping[int, Column], searches: dict[int, _Search], brackets: Mapping[int, tuple[float, float]]
) -> dict[int, float]:
    """Medians that their brackets enclose, from one pass; a column whose bracket misses is left out.

    Each task sends one count for all values below a bracket and one for each value in it, so equal values are one row.
    """
    order = list(searches.values())
    cells: list[Column] = []
    for at, key in enumerate(searches):
        value, (low, high) = F.col(f"v{key}"), brackets[key]
        # Null stands for all below: they sort first and count alike.
        cells += [F.when(value <= F.lit(high), F.lit(at)), F.when(value >= F.lit(low), value)]
    values = df.select(*(columns[key].alias(f"v{key}") for key in searches))
    long = values.select(F.stack(F.lit(len(searches)), *cells).alias("at", "x")).where(F.col("at").isNotNull())
    counts = long.groupBy("at", "x").agg(F.count(F.lit(1)).alias("n"))
    after = F.sum("n").over(Window.partitionBy("at").orderBy(F.col("x").asc_nulls_first()))
    placed = counts.withColumn("after", after)
    held = [
        (_constants([ranks(s) for s in order]) < F.col("after")) & (_constants([ranks(s) for s in order]) >= F.col("after") - F.col("n"))
        for ranks in (lambda s: s.first, lambda s: s.second)
    ]
    found: dict[int, dict[int, float]] = {}
    for row in placed.where((held[0] | held[1]) & F.col("x").isNotNull()).select("at", "x", *(h.alias(f"h{k}") for k, h in enumerate(held))).collect():
        for k in (0, 1):
            if row[f"h{k}"]:
                found.setdefault(row["at"], {})[k] = row["x"]
    keys = list(searches)
    return {keys[at]: x[0] if x[0] == x[1] else (x[0] + x[1]) / 2 for at, x in found.items() if len(x) == 2}


def exact_medians(
    df: DataFrame,
    columns: Mapping[int, Column],
    known: Mapping[int, tuple[int, float, float]],
    ranked_values: int = RANKED_VALUES,
    brackets: Mapping[int, tuple[float, float]] | None = None,
) -> dict[int, float]:
    """Medians by key; ``known`` gives each column's value count, minimum and maximum, ``brackets`` what ``bracket`` gave."""
    medians: dict[int, float] = {}
    searches: dict[int, _Search] = {}
    for key, (count, low, high) in known.items():
        if low == high:
            medians[key] = low
        else:
            searches[key] = _Search(low, high, 0, count, (count - 1) // 2, count // 2)
    # What a right bracket holds, but for equal values, which count as one.
    close = {k: s for k, s in searches.items() if brackets and s.inside * 6 / SKETCH <= ranked_values}
    if close:
        medians.update(_in_brackets(df, columns, close, brackets))
        searches = {k: s for k, s in searches.items() if k not in medians}
    small: dict[int, _Search] = {}
    spread = False
    while searches:
        small.update({k: s for k, s in searches.items() if s.inside <= ranked_values})
        large = {k: s for k, s in searches.items() if s.inside > ranked_values}
        searches = {}
        for key, outcome in (_narrow(df, columns, large, spread) if large else {}).items():
            if isinstance(outcome, _Search):
                searches[key] = outcome
            else:
                medians[key] = outcome
        spread = not spread
    if small:
        medians.update(_pick(df, columns, small))
    return medians
