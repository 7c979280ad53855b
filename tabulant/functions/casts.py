"""Text to number and text to instant, with anything unreadable becoming null."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulant.catalog import Catalog
from tabulant.columns import HELPER_PREFIX, named

# The number forms that count as readable.
NUMBER_PATTERN = r"^(\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*|[+-]?(?i:inf(inity)?))$"

# Date layouts tried in this order against a column's first value.
DATETIME_LAYOUTS = (
    "yyyy-M-d",
    "yyyy-M-d HH:mm",
    "yyyy-M-d HH:mm:ss",
    "yyyy-M-d HH:mm:ss.SSSSSSSSS",
    "yyyy-M-d HH:mm:ssXXX",
    "yyyy-M-d HH:mm:ss.SSSSSSSSSXXX",
    "yyyy-M-d'T'HH:mm",
    "yyyy-M-d'T'HH:mm:ss",
    "yyyy-M-d'T'HH:mm:ss.SSSSSSSSS",
    "yyyy-M-d'T'HH:mm:ssXXX",
    "yyyy-M-d'T'HH:mm:ss.SSSSSSSSSXXX",
    "M/d/yyyy",
    "M/d/yyyy HH:mm",
    "M/d/yyyy HH:mm:ss",
    "d/M/yyyy",
    "d/M/yyyy HH:mm",
    "d/M/yyyy HH:mm:ss",
    "yyyyMMdd",
    "MMM d yyyy",
    "yyyy-M",
    "yyyy",
)

# The range of instants a 64-bit nanosecond clock can hold.
NANOSECOND_CLOCK = ("1677-09-21 00:12:43.145225", "2262-04-11 23:47:16.854775")

# The first and last instant that count as readable; None for all.
Bounds = tuple[str, str] | None

NUMBER_COMPANION = HELPER_PREFIX + "num__"
INSTANT_COMPANION = HELPER_PREFIX + "ts__"


def try_number(value: Column) -> Column:
    """Read text as a double; units, digit separators, hex, NaN and overflow give null."""
    parsed = F.when(value.rlike(NUMBER_PATTERN), value.try_cast("double"))
    finite = F.abs(parsed) < F.lit(float("inf"))
    return F.when(finite | F.lower(value).contains("inf"), parsed)


def number(df: DataFrame, name: str) -> Column:
    """A column's numeric reading: its typed companion, its own type, or its text parsed."""
    if NUMBER_COMPANION + name in df.columns:
        return named(NUMBER_COMPANION + name)
    own = df.schema[name].dataType
    if isinstance(own, (T.DoubleType, T.FloatType)):
        value = named(name).cast("double")
        return F.when(~F.isnan(value), value)
    if isinstance(own, T.NumericType):
        return named(name).cast("double")
    return try_number(named(name).cast("string"))


def _utc(instant: Column) -> Column:
    """An instant as a zone-less UTC wall clock, whatever the session time zone is."""
    seconds = (F.unix_micros(instant) / F.lit(1000000).cast("decimal(20,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


# What each letter group of a layout looks like in text.
_GROUPS = {
    "yyyyMMdd": r"\d{8}",
    "yyyy": r"\d{4}",
    "MMM": r"[A-Za-z]{3}",
    "M": r"\d{1,2}",
    "d": r"\d{1,2}",
    "HH": r"\d{2}",
    "mm": r"\d{2}",
    "ss": r"\d{2}",
    "SSSSSSSSS": r"\d{1,9}",
    "XXX": r"(?:Z|[+-]\d{2}:\d{2})",
    "'T'": "T",
}


def _shape(layout: str) -> str:
    """A pattern that text in the layout matches; cheaper to try than the layout itself."""
    parts = re.findall("|".join(_GROUPS) + "|.", layout)
    return "^" + "".join(_GROUPS.get(p) or re.escape(p) for p in parts) + "$"


def _read_layout(value: Column, layout: str) -> Column:
    """Read text in one layout; where it carries no offset the text is taken as UTC."""
    if "X" in layout:
        instant = F.try_to_timestamp(value, F.lit(layout))
    else:
        instant = F.try_to_timestamp(F.concat(value, F.lit("Z")), F.lit(layout + "X"))
    if layout in DATETIME_LAYOUTS:
        return F.when(value.rlike(_shape(layout)), instant)
    return instant


def _within(value: Column, bounds: Bounds) -> Column:
    return F.when(value.between(*(F.lit(b).cast("timestamp_ntz") for b in bounds)), value) if bounds else value


def try_instant(value: Column, layout: str | None = None, bounds: Bounds = None) -> Column:
    """Read text as a UTC wall clock in the given layout, or in the first layout that fits each value."""
    layouts = DATETIME_LAYOUTS if layout is None else (layout,)
    return _within(_utc(F.coalesce(*(_read_layout(value, one) for one in layouts))), bounds)


def instant(df: DataFrame, name: str, layout: str | None = None, bounds: Bounds = None) -> Column:
    """A column's instant: its typed companion, its own type, or its text parsed.

    Text and typed columns keep every date, or those within ``bounds``.
    """
    if INSTANT_COMPANION + name in df.columns:
        return _within(named(INSTANT_COMPANION + name), bounds)
    own = df.schema[name].dataType
    if isinstance(own, (T.TimestampNTZType, T.DateType)):
        return _within(named(name).cast("timestamp_ntz"), bounds)
    if isinstance(own, T.TimestampType):
        return _within(_utc(named(name)), bounds)
    return try_instant(named(name).cast("string"), layout, bounds)


def needs_layout(df: DataFrame, name: str) -> bool:
    return INSTANT_COMPANION + name not in df.columns and isinstance(df.schema[name].dataType, T.StringType)


def infer_layouts(
    df: DataFrame, names: Sequence[str], order: Sequence[Column], known: Mapping[str, str] | None = None
) -> dict[str, str | None]:
    """Pick each text column's layout from its first non-null value in the given row order.

    One small aggregate for all columns: a single value per column reaches the driver.
    A column whose first value fits no layout maps to None, and is then read value by value.
    """
    layouts: dict[str, str | None] = dict(known or {})
    open_names = [n for n in names if n not in layouts and needs_layout(df, n)]
    if not open_names:
        return layouts
    position = F.struct(*(part for key in order for part in (key.isNull(), key)))
    firsts = df.agg(
        *(F.min_by(named(n), F.when(named(n).isNotNull(), position)).alias(f"f{i}") for i, n in enumerate(open_names))
    )
    # One row per column, so that the layouts are spelled out once and not once per column.
    cells = [F.struct(F.lit(i).alias("at"), F.col(f"f{i}").alias("first")) for i in range(len(open_names))]
    first = F.col("first")
    pick = F.coalesce(*(F.when(try_instant(first, one).isNotNull(), F.lit(one)) for one in DATETIME_LAYOUTS))
    for row in firsts.select(F.inline(F.array(*cells))).select("at", pick.alias("layout")).collect():
        layouts[open_names[row["at"]]] = row["layout"]
    return layouts


def iso_text(value: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss+00:00``, with six fraction digits only where the fraction is not zero."""
    plain = F.replace(value.cast("string"), F.lit(" "), F.lit("T"))
    padded = F.when(plain.contains("."), F.rpad(plain, 26, "0")).otherwise(plain)
    return F.concat(padded, F.lit("+00:00"))


def with_companions(df: DataFrame, catalog: Catalog, layouts: Mapping[str, str | None] | None = None) -> DataFrame:
    """Add typed companions next to text columns, so that stored data can be pruned by value."""
    extra = []
    for field in catalog.fields:
        if field.name not in df.columns or not isinstance(df.schema[field.name].dataType, T.StringType):
            continue
        if field.kind == "Num" or field.role == "M":
            extra.append(number(df, field.name).alias(NUMBER_COMPANION + field.name))
        if field.kind in ("Date", "Datetime"):
            extra.append(instant(df, field.name, (layouts or {}).get(field.name)).alias(INSTANT_COMPANION + field.name))
    return df.select("*", *extra)
