"""Sorting, numbering and paging.

Values sort as text, nulls last in both directions, and ties keep the row order of the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from tabulant.catalog import Catalog
from tabulant.columns import (
    ORDINAL,
    Order,
    HELPER_PREFIX,
    SortKey,
    data_columns,
    free_name,
    keys_stored,
    named,
    order_rows,
    row_order,
    text,
    text_key,
)
from tabulant.operators.filters import apply_grid_filters
from tabulant.sources.snapshot import Snapshot, write_snapshot
from tabulant.storage import stored

RECORD = "record_number"


def record_name(columns: Sequence[str]) -> str:
    """What the numbering is called next to these columns: ``record_number`` unless one has that name."""
    return free_name(RECORD, columns)


PAGE_ROWS = 500
# Rows up to this position are taken by a bounded top-k, which one task merges from the first
# rows of all others; for later ones the range of sort keys that holds them is found first.
TOP_ROWS = 10_000
# Ranges of sort keys that are counted for a late page, at least.
RANGES = 256

GUARD_ROWS = 200_000
GUARD_CELLS = 12_000_000


def available_keys(df: DataFrame, catalog: Catalog) -> list[str]:
    return [k for k in catalog.keys if k in df.columns]


def key_order(df: DataFrame, catalog: Catalog, tiebreak: Sequence[str] | None = None) -> Order:
    return [*(text_key(df, k) for k in available_keys(df, catalog)), *row_order(df, tiebreak)]


def sort_by_keys(df: DataFrame, catalog: Catalog, tiebreak: Sequence[str] | None = None) -> DataFrame:
    """Sort by the key columns that exist; without any the data stay as they are."""
    return order_rows(df, key_order(df, catalog, tiebreak)) if available_keys(df, catalog) else df


def key_sort_status(df: DataFrame, catalog: Catalog) -> str:
    used = available_keys(df, catalog)
    if not used:
        return "Primary key sort skipped: no FileKey columns found in source data."
    return f"Sorted by primary key: {', '.join(used)}"


SortModel = Sequence[Mapping[str, object]]


@dataclass(frozen=True)
class SortBy:
    """One column to sort by."""

    column: str
    ascending: bool = True

    @staticmethod
    def parse(item: object) -> SortBy | None:
        """Read an item of a grid sort model; only the word ``desc`` turns the order."""
        asked = item if isinstance(item, Mapping) else {}
        column, way = (str(asked.get(part, "")).strip() for part in ("colId", "sort"))
        return SortBy(column, way.lower() != "desc") if column else None


def sort_request(df: DataFrame, model: SortModel | None) -> list[SortBy]:
    """The sorts a grid model asks for on columns the data have."""
    return [by for by in map(SortBy.parse, model or ()) if by and by.column in df.columns]


def sort_order(df: DataFrame, model: SortModel | None, tiebreak: Sequence[str] | None = None) -> Order:
    return [*(text_key(df, by.column, by.ascending) for by in sort_request(df, model)), *row_order(df, tiebreak)]


def sort_rows(df: DataFrame, model: SortModel | None, tiebreak: Sequence[str] | None = None) -> DataFrame:
    return order_rows(df, sort_order(df, model, tiebreak))


def _leading(df: DataFrame, keys: Sequence[Column], rows: int) -> DataFrame:
    """At least the first ``rows`` rows: those of every partition, found without a shuffle."""
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = df.sortWithinPartitions(*keys).withColumn(HELPER_PREFIX + "within__", within)
    return placed.where(F.col(HELPER_PREFIX + "within__") < rows).drop(HELPER_PREFIX + "within__")


def _from(keys: Sequence[SortKey], bound: Column) -> Column:
    """Whether a row stands at a bound or after it; the bound's fields are ``k0``, ``k1`` and so on."""
    after = F.lit(True)
    for i, key in reversed(list(enumerate(keys))):
        value, least = key.value, bound.getField(f"k{i}")
        beyond = (value.isNull() & least.isNotNull()) | ((value > least) if key.ascending else (value < least))
        after = beyond | (value.eqNullSafe(least) & after)
    return F.coalesce(after, F.lit(False))


def _key_ranges(keyed: DataFrame, keys: Sequence[SortKey]) -> DataFrame:
    """The rows' sort keys in ranges: ``part, rows, first``, one row a range. Nothing but keys is moved."""
    names = [f"k{i}" for i in range(len(keys))]
    only = keyed.select(*(key.value.alias(name) for key, name in zip(keys, names)))
    order = [SortKey(F.col(name), key.ascending).way for key, name in zip(keys, names)]
    parts = max(RANGES, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = only.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = ranged.select(F.spark_partition_id().alias("part"), F.when(within == 0, F.struct(*names)).alias("first"))
    found = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.get(F.collect_list("first"), F.lit(0)).alias("first"))
    return stored(found, "ranges")


def _narrowed(
    keyed: DataFrame, keys: Sequence[SortKey], start: int, stop: int, top_rows: int, total: int | None = None
) -> tuple[DataFrame, int, int]:
    """The rows of the key ranges that hold ``start`` up to ``stop``, how many rows come before these, and how many there are.

    The counts of ranges say which hold them; a range still too large is cut into ranges again, as long as that helps.
    """
    ranges = _key_ranges(keyed, keys)
    counts = [(r["part"], r["rows"]) for r in ranges.select("part", "rows").orderBy("part").collect()]
    whole = sum(rows for _, rows in counts)
    if whole == total or start >= whole:
        return (keyed if whole == total else keyed.limit(0)), 0, whole
    before, first, skipped, last = 0, None, 0, None
    for at, (part, rows) in enumerate(counts):
        if first is None and before + rows > start:
            first, skipped = part, before
        if last is None and before + rows >= stop:
            last = at
        before += rows

    def bound(part: int) -> Column:
        return ranges.where(F.col("part") == part).select("first").scalar()

    kept = keyed.where(_from(keys, bound(first)))
    if last is not None and last + 1 < len(counts):
        kept = kept.where(~_from(keys, bound(counts[last + 1][0])))
    inside = sum(rows for part, rows in counts if part >= first) if last is None else sum(
        rows for part, rows in counts[: last + 1] if part >= first
    )
    if inside > 2 * top_rows + stop - start and inside < whole:
        inner, more, _ = _narrowed(kept, keys, start - skipped, stop - skipped, top_rows, inside)
        return inner, skipped + more, whole
    return kept, skipped, whole


def rows_between(df: DataFrame, order: Order, start: int, stop: int, top_rows: int = TOP_ROWS) -> DataFrame:
    """Rows at positions ``start`` (0-based) up to ``stop`` in the given order, numbered from 1.

    Late ones lie in ranges of sort keys that counts point out, so only these ranges are read on and sorted. An order
    by expressions that aren't sort keys can't be compared with a bound; then the leading rows of every partition are.
    """
    return _rows_and_total(df, order, start, stop, top_rows)[0]


def _rows_and_total(df: DataFrame, order: Order, start: int, stop: int, top_rows: int) -> tuple[DataFrame, int | None]:
    """As ``rows_between``, and how many rows there are where finding a late page has counted them."""
    columns = data_columns(df)
    record = record_name(columns)
    keyed, ordered = keys_stored(df, order)
    keys = [key.way if isinstance(key, SortKey) else key for key in ordered]
    skipped, total = 0, None
    if stop > top_rows and stop > start:
        if all(isinstance(key, SortKey) for key in ordered):
            keyed, skipped, total = _narrowed(keyed, ordered, start, stop, top_rows)
        else:
            keyed = _leading(keyed, keys, stop)
        if stop - skipped > 2 * top_rows:
            rows = write_snapshot(keyed, keys).slice(start - skipped, stop - skipped, columns)
            numbered = rows.withColumn(ORDINAL, F.col(ORDINAL) + skipped)
            return numbered.withColumnRenamed(ORDINAL, record), total
    # At most twice ``top_rows`` rows are left here, so numbering them in one task is bounded.
    rows = keyed.orderBy(*keys).offset(start - skipped).limit(max(stop - start, 0))
    position = (F.row_number().over(Window.orderBy(*keys)) + start).cast("bigint")
    return rows.withColumn(record, position).select(*map(named, columns), named(record)), total


def preview(df: DataFrame, rows: int, order: Order | None = None) -> DataFrame:
    """The first rows in the given order, by default the row order of the data."""
    record = record_name(data_columns(df))
    return rows_between(df, order or row_order(df), 0, rows).orderBy(named(record)).drop(record)


def number_records(df: DataFrame, order: Order) -> DataFrame:
    """Add each row's 1-based position in the given order.

    The rows are range-sorted into a stored snapshot and numbered from its row counts, so no
    task ever sees more than its own part.
    """
    snapshot = write_snapshot(df, order)
    return snapshot.frame().withColumnRenamed(ORDINAL, record_name(data_columns(df)))


def page(
    df: DataFrame,
    filter_model: Mapping[str, object] | None = None,
    sort_model: SortModel | None = None,
    start: int = 0,
    end: int | None = None,
    tiebreak: Sequence[str] | None = None,
    top_rows: int = TOP_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Rows from ``start`` (0-based) up to ``end``, numbered, and the row count after filtering.

    The count comes with the page: a late page's ranges are counted anyhow, and an early page's rows are counted while
    the first of them are found, for which the page is stored.
    """
    stop = end or start + PAGE_ROWS
    kept = apply_grid_filters(df, filter_model)
    order = sort_order(kept, sort_model, tiebreak)
    if start < stop <= top_rows:
        rows, total = _counted_page(kept, order, start, stop, top_rows)
    else:
        rows, total = _rows_and_total(kept, order, start, stop, top_rows)
    if total is None:
        return rows, kept.agg(F.count(F.lit(1)).alias("row_count"))
    return rows, df.sparkSession.createDataFrame([(total,)], "row_count bigint")


def _counted_page(kept: DataFrame, order: Order, start: int, stop: int, top_rows: int) -> tuple[DataFrame, int | None]:
    """A stored early page, and the number of all rows, observed while they pass; None if that isn't proven.

    Tasks that run again, after an executor was lost, are observed again. So the partitions' first rows are counted too:
    more of these than partitions show that the count is too high. An empty page proves nothing.
    """
    place, within = HELPER_PREFIX + "place__", F.lit((1 << 33) - 1)
    seen = Observation()
    first = F.col(place).bitwiseAND(within) == 0
    parts = F.collect_set(F.when(first, F.shiftright(F.col(place), 33)))
    passing = kept.withColumn(place, F.monotonically_increasing_id()).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(first).alias("firsts"), F.size(parts).alias("parts")
    )
    rows = stored(rows_between(passing, order, start, stop, top_rows), "page")
    if rows.isEmpty():
        return rows, None
    found = seen.get
    return rows, found["rows"] if found["firsts"] == found["parts"] else None


def page_of_snapshot(snapshot: Snapshot, start: int = 0, end: int | None = None) -> DataFrame:
    """A page in stored order: only the files holding it are read, however deep it lies."""
    rows = snapshot.slice(start, end or start + PAGE_ROWS)
    return rows.withColumnRenamed(ORDINAL, record_name(data_columns(rows)))


def page_after(
    df: DataFrame,
    sort_model: SortModel | None,
    last: Mapping[str, object],
    rows: int = PAGE_ROWS,
    tiebreak: Sequence[str] | None = None,
) -> DataFrame:
    """The next page after a known last row, at the same cost at any depth.

    ``last`` maps every sort and tie-break column to that row's value.
    """
    if tiebreak is None:
        tiebreak = [ORDINAL] if ORDINAL in df.columns else data_columns(df)
    keys = [(text(df, by.column), by.column, by.ascending, True) for by in sort_request(df, sort_model)]
    keys += [(named(n), n, True, False) for n in tiebreak]
    later, equal = [], F.lit(True)
    for column, name, up, as_text in keys:
        value = last[name]
        if value is None:
            equal = equal & column.isNull()
            continue
        bound = F.lit(str(value)) if as_text and not isinstance(value, str) else F.lit(value)
        beyond = (column > bound) if up else (column < bound)
        later.append(equal & (beyond | column.isNull()))
        equal = equal & (column == bound)
    ahead = reduce(or_, later) if later else F.lit(False)
    return order_rows(df.where(ahead), sort_order(df, sort_model, tiebreak)).limit(rows)


def large_result_guard(
    df: DataFrame, preview_rows: int, most_rows: int = GUARD_ROWS, most_cells: int = GUARD_CELLS
) -> DataFrame:
    """Whether a result is too large to show whole, with its size and the warning."""
    width = len(data_columns(df))
    sized = df.agg(F.count(F.lit(1)).alias("total_rows")).withColumn("total_columns", F.lit(width).cast("bigint"))
    cells = F.col("total_rows") * F.col("total_columns")
    blocked = (F.col("total_rows") > most_rows) | (cells > most_cells)
    counts = [F.format_number(c, 0) for c in (F.col("total_rows"), F.col("total_columns"), F.lit(preview_rows))]
    message = F.concat(
        F.lit("Large result guard active: "),
        counts[0],
        F.lit(" rows x "),
        counts[1],
        F.lit(" columns. Grid rendering is limited to first "),
        counts[2],
        F.lit(" rows. Use Export Filtered CSV to download the full filtered dataset."),
    )
    return sized.select(
        "total_rows", "total_columns", blocked.alias("blocked"), F.when(blocked, message).alias("message")
    )
