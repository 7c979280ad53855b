"""Delimited text as an all-text DataFrame that keeps file order."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabulant.columns import HELPER_PREFIX, ORDINAL, free_name, named
from tabulant.functions.text import strip
from tabulant.sources.records import split_records

# Cell texts that mean "no value", whether quoted or not.
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

RAW = HELPER_PREFIX + "raw__"
QUARANTINED = HELPER_PREFIX + "quarantined__"

def null_tokens_to_null(value: Column) -> Column:
    return F.when(~value.isin(*NULL_TOKENS), value)


def unique_headers(cells: list[str | None]) -> list[str]:
    """Name blank headers by position and number repeats: ``b``, ``b.1``, ``b.2``.

    Names that differ in case alone count as repeats, since Spark takes them for one. A numbered
    name never takes one that the header line itself uses.
    """
    names = [cell if cell else f"Unnamed: {i}" for i, cell in enumerate(cells)]
    if reserved := [n for n in names if n.lower().startswith(HELPER_PREFIX)]:
        raise ValueError(f"Reserved column names: {reserved}")
    result: list[str | None] = [None] * len(names)
    # The first cell of each name keeps it; names that were given come before generated ones.
    used: set[str] = set()
    order = sorted(range(len(names)), key=lambda i: not cells[i])
    for i in order:
        if names[i].lower() not in used:
            used.add(names[i].lower())
            result[i] = names[i]
    for i in order:
        if result[i] is None:
            result[i] = free_name(names[i], [*used])
            used.add(result[i].lower())
    return result


def _reader(spark: SparkSession, delimiter: str, multiline: bool):
    return (
        spark.read.option("sep", delimiter)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("encoding", "UTF-8")
    )


def read_header(spark: SparkSession, path: str | list[str], delimiter: str = ",") -> list[str]:
    """The column names of the first file."""
    try:
        first = _reader(spark, delimiter, True).option("header", False).csv(path).head(1)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"Data file not found: {path}") from error
    if not first:
        raise ValueError(f"No columns to read in {path}")
    cells = list(first[0])
    if cells[0]:
        cells[0] = cells[0].lstrip("\ufeff")
    return unique_headers(cells)


def _quoted_cell(delimiter: str) -> str:
    """A pattern for one well-formed quoted cell, from border to border."""
    edge = re.escape(delimiter)
    return rf'(?<=\A|{edge})"(?:[^"]++|"")*+"(?={edge}|\r?\z)'


def survey_files(
    spark: SparkSession, path: str | list[str], delimiter: str = ","
) -> list[tuple[str, bool, str | None]]:
    """``(file, open, first line)`` of every file, from one pass that ends in one row a file.

    A line is closed if dropping its well-formed quoted cells leaves no quote. Where every line
    of a file is closed, each line is one record. Others may hold cells that run over a line end.
    """
    quote = F.col("value").contains('"')
    # A lone carriage return may be a line end to a reader of lines, so with a quote it counts as open.
    value = F.when(F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    left = F.regexp_replace(value, _quoted_cell(delimiter), "")
    is_open = F.when(quote, left.contains('"') | value.contains("\r"))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"),
        value.alias("value"),
        is_open.alias("open"),
    )
    first = F.min_by("value", F.when(strip(F.col("value")) != "", F.col("place")))
    found = lines.groupBy("file").agg(F.coalesce(F.bool_or("open"), F.lit(False)).alias("open"), first.alias("first"))
    return [(unquote(r["file"]), r["open"], r["first"]) for r in sorted(found.collect())]


def _scan(spark: SparkSession, path, names: list[str], delimiter: str, multiline: bool) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, RAW]])
    # Pruning columns inside the parser would hide rows with too many or too few cells.
    reader = _reader(spark, delimiter, multiline).schema(schema).option("header", True)
    reader = reader.option("columnNameOfCorruptRecord", RAW).option("columnPruning", False)
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
    )
    return reader.csv(path).select("*", position.alias(ORDINAL))


def _scan_records(spark: SparkSession, files: list[str], names: list[str], delimiter: str) -> DataFrame:
    """Read files with open quotes in splits, record by record."""
    record = F.regexp_replace("text", r"\r\z", "")
    ddl = ",".join("`" + n.replace("`", "``") + "` string" for n in [*names, RAW])
    options = {"sep": delimiter, "quote": '"', "escape": '"', "columnNameOfCorruptRecord": RAW, "multiLine": "true"}
    records = split_records(spark, files, delimiter).where(strip(F.col("text")) != "")
    cells = records.select("file", "start", "id", F.from_csv(record, ddl, options).alias("c"))
    return cells.select("c.*", F.struct("file", "start", "id").alias(ORDINAL))


def _is_long(raw: Column, width: int, delimiter: str) -> Column:
    """Whether a record the parser flagged has more cells than the header."""
    bare = F.regexp_replace(raw, r'"(?:[^"]++|"")*+"', "")
    cells = F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1
    return F.coalesce(cells > width, F.lit(False))


def _scan_all(spark: SparkSession, path, delimiter: str, multiline: bool | str) -> tuple[list[str], DataFrame]:
    """Column names and raw rows. Files must have the same columns, in any order."""
    names = read_header(spark, path, delimiter)
    if multiline != "auto":
        scans = [_scan(spark, path, names, delimiter, bool(multiline))]
    else:
        ways: dict[tuple[bool, tuple[str, ...]], list[str]] = {}
        surveyed = [one for one in survey_files(spark, path, delimiter) if one[2] is not None]
        if len({first for _, _, first in surveyed}) > 1:
            names = read_header(spark, surveyed[0][0], delimiter)
        for line in dict.fromkeys(first for _, _, first in surveyed):
            # Equal first lines are equal headers; one with an open quote is read from its file.
            own = [(file, open_) for file, open_, first in surveyed if first == line]
            header = names if len(surveyed) == len(own) else read_header(spark, own[0][0], delimiter)
            if sorted(header) != sorted(names):
                raise ValueError(f"Other columns than {names}: {header} in {own[0][0]}")
            for file, open_ in own:
                ways.setdefault((open_, tuple(header)), []).append(file)
        scans = [
            (_scan_records if open_ else _scan)(spark, sorted(files), list(header), delimiter, *([] if open_ else [False]))
            for (open_, header), files in sorted(ways.items())
        ]
    rows = reduce(DataFrame.unionByName, scans or [_scan(spark, path, names, delimiter, False)])
    # A blank line has no first cell either. Naming that cell keeps one real column in every
    # scan, without which Spark refuses to return the raw text.
    blank = (strip(F.col(RAW)) == "") & (strip(F.coalesce(named(names[0]), F.lit(""))) == "")
    return names, rows.where(F.col(RAW).isNull() | ~blank)


def read_delimited(
    spark: SparkSession, path: str | list[str], delimiter: str | None = ",", multiline: bool | str = "auto"
) -> DataFrame:
    """Read files with a header line; every column is text and null tokens are null.

    Short rows are padded with null and blank lines skipped. A row with more cells than the
    header fails the job that meets it. Files may hold the same columns in different order.
    ``multiline="auto"`` looks for open quotes first: files without any are split at lines, those
    with some at records. ``True`` reads every file in one task, ``False`` takes every line as a
    record. The result carries the file order as an ordinal column.
    """
    delimiter = delimiter or ","
    names, rows = _scan_all(spark, path, delimiter, multiline)
    message = F.concat(F.lit(f"Expected {len(names)} cells, found more: "), F.col(RAW))
    checked = F.when(_is_long(F.col(RAW), len(names), delimiter), F.raise_error(message).cast("boolean"))
    kept = rows.where(F.coalesce(checked, F.lit(True)))
    return kept.select(*(null_tokens_to_null(named(n)).alias(n) for n in names), ORDINAL)


def quarantine_long_rows(
    spark: SparkSession, path: str | list[str], delimiter: str | None = ",", multiline: bool | str = "auto"
) -> DataFrame:
    """As ``read_delimited``, but rows too long stay, flagged in ``QUARANTINED``, with their raw text in ``RAW``."""
    delimiter = delimiter or ","
    names, rows = _scan_all(spark, path, delimiter, multiline)
    long = _is_long(F.col(RAW), len(names), delimiter)
    cells = [F.when(~long, null_tokens_to_null(named(n))).alias(n) for n in names]
    return rows.select(*cells, ORDINAL, F.when(long, F.col(RAW)).alias(RAW), long.alias(QUARANTINED))
