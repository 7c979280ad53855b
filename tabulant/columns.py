"""Column naming rules shared by every operator.

Names are matched exactly and case-sensitively. Columns whose name starts with the helper
prefix (row order, typed companions) never reach an export; data columns may have any other name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

HELPER_PREFIX = "__tabulant_"
ORDINAL = HELPER_PREFIX + "ordinal__"


def named(name: str) -> Column:
    """Reference a column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith(HELPER_PREFIX)]


def free_name(name: str, taken: Sequence[str]) -> str:
    """The name, numbered if the given columns have it already, upper and lower case alike."""
    lowered, free, number = {t.lower() for t in taken}, name, 0
    while free.lower() in lowered:
        number += 1
        free = f"{name}.{number}"
    return free


def text(df: DataFrame, name: str) -> Column:
    """The column as text, which is how values are matched, grouped and sorted."""
    return named(name).cast("string")


@dataclass(frozen=True)
class SortKey:
    """A sort key, nulls last; sorts store a computed one, since comparing rows would recompute it."""

    value: Column
    ascending: bool = True
    computed: bool = True

    @property
    def way(self) -> Column:
        return self.value.asc_nulls_last() if self.ascending else self.value.desc_nulls_last()


Order = Sequence[Column | SortKey]


def text_key(df: DataFrame, name: str, ascending: bool = True) -> SortKey:
    """Sort a column as text, nulls last."""
    return SortKey(text(df, name), ascending, computed=not isinstance(df.schema[name].dataType, T.StringType))


def with_sort_keys(df: DataFrame, order: Order) -> tuple[DataFrame, list[Column]]:
    """Store computed keys in helper columns; returns the frame and the columns to sort by."""
    keyed, stored = keys_stored(df, order)
    return keyed, [key.way if isinstance(key, SortKey) else key for key in stored]


def keys_stored(df: DataFrame, order: Order) -> tuple[DataFrame, Order]:
    """The frame with its computed keys in helper columns, and the order by these."""
    stored, keys = {}, []
    for i, key in enumerate(order):
        if isinstance(key, SortKey) and key.computed:
            name = f"{HELPER_PREFIX}sort{i}__"
            stored[name] = key.value
            key = SortKey(F.col(name), key.ascending, computed=False)
        keys.append(key)
    return (df.withColumns(stored) if stored else df), keys


def own_order(df: DataFrame) -> Order:
    """The row order the data carry; none for tables without one, which then need no sort."""
    return [named(ORDINAL).asc_nulls_last()] if ORDINAL in df.columns else []


def order_rows(df: DataFrame, order: Order) -> DataFrame:
    if not order:
        return df
    keyed, keys = with_sort_keys(df, order)
    return keyed.orderBy(*keys).select(*map(named, df.columns))


def row_order(df: DataFrame, tiebreak: Sequence[str] | None = None) -> list[SortKey]:
    """Columns fixing the row order: the given ones, else the ordinal, else every data column."""
    if tiebreak is None:
        tiebreak = [ORDINAL] if ORDINAL in df.columns else data_columns(df)
    return [SortKey(named(c), computed=False) for c in tiebreak]


def first_row_keys(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Plain columns whose smallest combination marks the first row after a sort by key."""
    own = [ORDINAL] if ORDINAL in df.columns else data_columns(df)
    return [*(text(df, k) for k in keys if k in df.columns), *map(named, own)]
