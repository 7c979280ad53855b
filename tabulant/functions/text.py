"""Small text helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters trimmed around names and tokens.
BLANKS = " \t\n\r\x0b\x0c"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def title_case(value: Column) -> Column:
    """Upper-case the first letter of every run of letters and lower-case the rest."""
    runs = F.regexp_extract_all(value, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def or_default(value: Column, default: str) -> Column:
    """The value, or the default where it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))
