"""Text shown to readers: grouped digits, labels and headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulant.catalog import Catalog
from tabulant.columns import named
from tabulant.functions.casts import try_number
from tabulant.functions.text import BLANKS, title_case


def _grouped(value: Column) -> Column:
    """Thousands separators; no decimals for whole numbers, else exactly four."""
    whole = F.format_number(value + F.lit(0.0), 0)
    digits = F.when(value == F.floor(value), whole).otherwise(F.format_number(value, 4))
    words = F.when(F.isnan(value), "nan").when(value > 0, "inf").otherwise("-inf")
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), words).otherwise(digits)


def _readable(value: Column) -> Column:
    """Text as a number, single underscores between digits allowed."""
    return try_number(F.regexp_replace(value, r"(?<=\d)_(?=\d)", ""))


def display_number(value: Column, kind: T.DataType | None = None) -> Column:
    """Format a number, or text that reads as one; anything else stays as it is."""
    if isinstance(kind, T.IntegralType):
        return F.format_number(value, 0)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _grouped(value.cast("double"))
    shown = value.cast("string")
    if isinstance(kind, T.BooleanType):
        return F.initcap(shown)
    return F.coalesce(_grouped(_readable(shown)), shown)


def display_measures(df: DataFrame, catalog: Catalog) -> DataFrame:
    """Format the cells of numeric fields; blank and unreadable cells stay as they are."""
    shown = []
    for name in df.columns:
        field = catalog.field(name)
        if field is None or not field.shown_as_number:
            shown.append(named(name))
            continue
        cell = named(name).cast("string")
        shown.append(F.coalesce(_grouped(_readable(F.replace(cell, F.lit(","), F.lit("")))), cell).alias(name))
    return df.select(*shown)


def display_nested(value: Column, kind: T.DataType) -> Column:
    """Format every scalar inside structs, arrays and maps, keeping the shape."""
    if isinstance(kind, T.StructType):
        parts = [display_nested(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: display_nested(item, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, item: display_nested(item, kind.valueType))
    return display_number(value, kind)


def metric_label(key: Column) -> Column:
    """``null_count`` becomes ``Null Count``."""
    spaced = F.btrim(F.regexp_replace(key, r"[_\s]+", " "))
    return F.when(spaced == "", key).otherwise(title_case(spaced))


def metric_value(key: Column, value: Column, kind: T.DataType | None = None) -> Column:
    """Format a scorecard value, with a percent sign for keys ending in ``_pct``."""
    shown = display_number(value, kind)
    percent = F.lower(F.btrim(key)).endswith("_pct")
    return F.when(percent & value.isNotNull(), F.concat(shown, F.lit("%"))).otherwise(shown)


def display_scorecard(scorecard: DataFrame) -> DataFrame:
    """The scorecard as ``metric``, ``value`` rows ready to show."""
    rows = [
        F.struct(
            metric_label(F.lit(f.name)).alias("metric"),
            metric_value(F.lit(f.name), named(f.name), f.dataType).alias("value"),
        )
        for f in scorecard.schema.fields
    ]
    return scorecard.select(F.inline(F.array(*rows)))


def header(name: Column) -> Column:
    return F.upper(F.btrim(name, F.lit(BLANKS)))


def field_label(name: Column, desc: Column) -> Column:
    """``NAME [description]``, or only the name where there is no description."""
    trimmed = F.btrim(desc, F.lit(BLANKS))
    return F.when(trimmed != "", F.concat(header(name), F.lit(" ["), trimmed, F.lit("]"))).otherwise(header(name))


def with_display_headers(df: DataFrame) -> DataFrame:
    """Rename columns to their upper-case headers."""
    return df.toDF(*(c.strip().upper() for c in df.columns))


def float_text(value: Column) -> Column:
    """A double in shortest form: plain digits from 1e-4 up to 1e16, else exponent notation."""
    size = F.abs(value)
    raw = value.cast("string")
    plain = F.rtrim(raw.try_cast("decimal(38,21)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0$", "")
    power = F.substring_index(raw, "E", -1).try_cast("int")
    sign = F.when(power < 0, "-").otherwise("+")
    digits = F.abs(power).cast("string")
    digits = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    exponent = F.concat(mantissa, F.lit("e"), sign, digits)
    usual = (size >= 1e-3) & (size < 1e7) | (size == 0)
    endless = F.when(value > 0, "inf").otherwise("-inf")
    texts = F.when(usual, raw).when(size == F.lit(float("inf")), endless)
    return texts.when((size >= 1e-4) & (size < 1e16), plain).otherwise(exponent)
