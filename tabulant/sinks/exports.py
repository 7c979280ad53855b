"""Text outputs of frames, views and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabulant.columns import Order, data_columns, named, order_rows, own_order, row_order
from tabulant.functions.display import header, with_display_headers
from tabulant.operators.ordering import number_records, record_name, rows_between
from tabulant.operators.profile import KEY_ROW


def _writer(df: DataFrame, delimiter: str):
    return (
        df.write.option("header", True)
        .option("sep", delimiter)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("encoding", "UTF-8")
    )


def sorted_columns(df: DataFrame, alphabetical: bool = True) -> DataFrame:
    """Columns in code-point order of their names."""
    return df.select(*map(named, sorted(df.columns))) if alphabetical else df


def write_csv(
    df: DataFrame,
    path: str,
    alphabetical: bool = False,
    order: Order | None = None,
    single_file: bool = False,
) -> None:
    """Write every row and data column as CSV with a header.

    Part files follow the row order. ``single_file`` brings all rows to one task and is only
    for results known to be small.
    """
    rows = order_rows(df, order or own_order(df)).select(*map(named, data_columns(df)))
    rows = sorted_columns(rows, alphabetical)
    _writer(rows.coalesce(1) if single_file else rows, ",").csv(path)


def tsv_of_view(
    df: DataFrame, columns: Sequence[str] | None, order: Order | None = None, limit: int | None = None
) -> DataFrame:
    """The shown columns of all rows, or of the first ``limit``, as ``(position, line)`` cleaned for pasting.

    The header is at position 0. No columns give no lines at all.
    """
    shown = data_columns(df) if columns is None else [c for c in columns if c in data_columns(df)]
    if not shown:
        return df.sparkSession.createDataFrame([], "position bigint, line string")
    chosen = list(order or row_order(df))
    first = number_records(df, chosen) if limit is None else rows_between(df, chosen, 0, limit)
    record = named(record_name(data_columns(df)))
    cells = [F.translate(F.coalesce(named(c).cast("string"), F.lit("")), "\t\r\n", "   ") for c in shown]
    lines = first.select(record.alias("position"), F.concat_ws("\t", *cells).alias("line"))
    titles = df.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("position"), F.concat_ws("\t", *(header(F.lit(c)) for c in shown)).alias("line")
    )
    return titles.unionByName(lines)


def write_tsv_of_view(
    df: DataFrame,
    path: str,
    columns: Sequence[str] | None,
    order: Order | None = None,
    limit: int | None = None,
) -> None:
    """Write the TSV of a view as text; part files follow the row order, the header first."""
    tsv_of_view(df, columns, order, limit).orderBy("position").select("line").write.text(path)


def write_tsv_of_frame(
    df: DataFrame, path: str, columns: Sequence[str] | None = None, order: Order | None = None
) -> None:
    """Write the shown columns, all if none is known, with upper-case headers and normal quoting."""
    shown = [c for c in columns or () if c in data_columns(df)] or data_columns(df)
    rows = order_rows(df, order or own_order(df)).select(*map(named, shown))
    _writer(with_display_headers(rows), "\t").csv(path)


def profile_payload(profiled: DataFrame) -> DataFrame:
    """Each profile row as ``(field_name, payload)`` JSON, with only the metrics its type has."""
    shared = ["row_count", "null_count"]
    parsed = [*shared, "valid_count", "parse_success_rate"]
    metrics = {
        "Char": [F.col(c) for c in (*shared, "distinct_count")],
        "Num": [F.col(c) for c in (*parsed, "min", "max", "sum", "mean", "median")],
        "Date": [*(F.col(c) for c in parsed), F.col("min_ts").alias("min"), F.col("max_ts").alias("max")],
        "Key": [F.col(c) for c in ("row_count", "unique_key_count", "duplicate_key_count", "uniqueness_ratio")],
    }

    def payload(kind: str) -> Column:
        return F.to_json(
            F.struct("field_name", "stat_type", F.struct(*metrics[kind]).alias("metrics"), "top_values")
        )

    is_key = F.col("field_name") == KEY_ROW
    chosen = F.when(is_key, payload("Key")).when(F.col("stat_type") == "Num", payload("Num"))
    chosen = chosen.when(F.col("stat_type").isin("Date", "Datetime"), payload("Date")).otherwise(payload("Char"))
    return profiled.select("field_name", chosen.alias("payload"))
