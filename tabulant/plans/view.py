"""A filtered view: what it shows, how large it is, and what it exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tabulant.catalog import Catalog
from tabulant.columns import data_columns, named
from tabulant.functions.display import display_measures
from tabulant.operators.filters import Range, apply_value_and_range_filters, drill_through
from tabulant.operators.ordering import (
    GUARD_CELLS,
    GUARD_ROWS,
    key_order,
    large_result_guard,
    number_records,
    page,
    page_of_snapshot,
    preview,
)
from tabulant.sinks.exports import sorted_columns, write_csv
from tabulant.sources.snapshot import Snapshot, write_snapshot


@dataclass(frozen=True)
class ViewSpec:
    """What a view keeps and how it is laid out."""

    preview_rows: int
    dimension_rows: Sequence[tuple[str | None, Sequence[str | None] | None]] = ()
    measure_rows: Sequence[tuple[str | None, Sequence[Range | None] | None]] = ()
    drill_dimension: str | None = None
    drill_point: Mapping[str, object] | None = None
    alphabetical: bool = False
    visible: Sequence[str] = ()
    tiebreak: Sequence[str] | None = None


@dataclass(frozen=True)
class View:
    """A filtered table. Building it runs nothing; numbering and storing its rows do, when asked for."""

    source: DataFrame
    catalog: Catalog
    spec: ViewSpec
    status: str = field(default="", init=False)
    filtered: DataFrame = field(default=None, init=False)

    def __post_init__(self) -> None:
        kept = apply_value_and_range_filters(
            self.source, self.catalog, self.spec.dimension_rows, self.spec.measure_rows
        )
        kept, status = drill_through(kept, self.spec.drill_dimension, self.spec.drill_point)
        object.__setattr__(self, "filtered", kept)
        object.__setattr__(self, "status", status)

    def _order(self):
        return key_order(self.filtered, self.catalog, self.spec.tiebreak)

    @property
    def rows(self) -> DataFrame:
        """All kept rows, data columns only, in the chosen column order."""
        return sorted_columns(self.filtered.select(*map(named, data_columns(self.filtered))), self.spec.alphabetical)

    def preview(self) -> DataFrame:
        """The first rows, visible columns only, numbers formatted for reading."""
        first = preview(self.filtered, self.spec.preview_rows, self._order())
        shown = [c for c in self.rows.columns if not self.spec.visible or c in self.spec.visible]
        return display_measures(first.select(*map(named, shown)), self.catalog)

    def counts(self, most_rows: int = GUARD_ROWS, most_cells: int = GUARD_CELLS) -> DataFrame:
        """Size of the view, and whether it is too large to show whole."""
        return large_result_guard(self.filtered, self.spec.preview_rows, most_rows, most_cells)

    def snapshot(self, path: str | None = None) -> Snapshot:
        """Store the kept rows in order once; pages of any depth then read only the files that hold them."""
        known = [f.name for f in self.catalog.fields if f.name in self.filtered.columns]
        looked_up = [n for n in known if self.catalog.has_role(n, "D") or n in self.catalog.keys]
        return write_snapshot(self.filtered, self._order(), path, looked_up)

    def numbered(self) -> DataFrame:
        return number_records(self.filtered, self._order())

    def export_csv(self, path: str, single_file: bool = False) -> None:
        write_csv(self.filtered, path, self.spec.alphabetical, self._order(), single_file)


def fetch_page(
    snapshot: Snapshot,
    filter_model: Mapping[str, object] | None = None,
    sort_model: Sequence[Mapping[str, object]] | None = None,
    start: int = 0,
    end: int | None = None,
) -> tuple[DataFrame, int | DataFrame]:
    """Serve one page of a stored view.

    Without filter and sort the page is cut straight out of the stored order.
    """
    if not filter_model and not sort_model:
        return page_of_snapshot(snapshot, start, end), snapshot.row_count
    return page(snapshot.frame(), filter_model, sort_model, start, end)
