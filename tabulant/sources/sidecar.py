"""Sidecar texts to catalogs.

Parsing is one projection over a DataFrame of ``(path, text)``: any number of sidecars,
no shuffle, and one result row per sidecar with its error, if any, in ``status``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabulant.catalog import FIELD_ATTRIBUTES, FIELD_DDL, Catalog
from tabulant.functions.text import or_default, strip, title_case

# The keys of a sidecar, and the attribute each one fills.
META_KEYS = {
    "FieldName": "field_name",
    "FieldType": "field_type",
    "FieldLength": "field_length",
    "FieldDesc": "field_desc",
    "FieldDType": "field_dtype",
}
FILE_KEY = "FileKey"
SIDECAR_SUFFIX = "_Meta"

# Marks that rule out the compact form.
LONG_FORM_MARKS = ("FieldName|", "FieldType|", "FileKey|")

_NO_FIELDS = f"array<{FIELD_DDL}>"

# Why a sidecar cannot be used, and what to look at in one that can.
_EMPTY = "Metadata file is empty."
_NO_DEFINITIONS = "Metadata does not contain any field definitions."
_EMPTY_NAME = "Metadata contains an empty FieldName."
_COMPACT_TOO_SHORT = "Compact metadata requires file keys and at least one field descriptor."
_COMPACT_NO_KEYS = "Compact metadata requires explicit file keys and field descriptors."
_NOTE_GAPS = "A descriptor has empty tokens; the tokens after them move up."
_NOTE_KEY = "The first token of the first descriptor counts as a key."


def _not_blank(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, strip), lambda t: t != "")


def _cells(line: Column) -> Column:
    return F.transform(F.split(line, r"\|"), strip)


def _field(name: Column, kind: Column, length: Column, desc: Column, role: Column) -> Column:
    """A field with its defaults filled in."""
    parts = [name, title_case(or_default(kind, "Char")), length, desc, F.upper(or_default(role, "D"))]
    filled = [F.coalesce(p, F.lit("")).alias(a) for p, a in zip(parts, FIELD_ATTRIBUTES)]
    return F.struct(*filled).cast(FIELD_DDL)


def sidecar_lines(text: Column) -> Column:
    """Stripped lines that are not blank, without a byte-order mark."""
    return _not_blank(F.split(F.regexp_replace(text, "^﻿", ""), r"\r\n|\r|\n"))


def sidecar_format(lines: Column) -> Column:
    """``empty``, ``compact``, ``tabular`` or ``keyvalue``."""
    first = F.get(lines, 0)
    marked = F.lit(False)
    for mark in LONG_FORM_MARKS:
        marked = marked | first.contains(mark)
    compact = (F.size(lines) == 1) & first.contains("|") & first.contains(",") & ~marked
    wanted = F.array(*(F.lit(k) for k in (*META_KEYS, FILE_KEY)))
    tabular = F.size(F.array_except(wanted, _cells(first))) == 0
    return (
        F.when(F.size(lines) == 0, "empty").when(compact, "compact").when(tabular, "tabular").otherwise("keyvalue")
    )


def compact_type(token: Column) -> tuple[Column, Column]:
    """The declared type and length inside a compact type token such as ``Char50``."""
    lowered = F.lower(token)
    char = lowered.startswith("char")
    kind = (
        F.when(char, "Char")
        .when(lowered.isin("num", "number", "numeric"), "Num")
        .when(lowered.isin("date", "datetime"), F.initcap(lowered))
        .otherwise(title_case(token))
    )
    return kind, F.when(char, strip(F.substr(token, F.lit(5)))).otherwise("")


def _compact_field(tokens: Column) -> Column:
    has_length = F.size(tokens) >= 5
    kind, inner_length = compact_type(F.get(tokens, 1))
    return _field(
        F.get(tokens, 0),
        kind,
        F.when(has_length, F.get(tokens, 2)).otherwise(inner_length),
        F.when(has_length, F.get(tokens, 3)).otherwise(F.get(tokens, 2)),
        F.when(has_length, F.get(tokens, 4)).otherwise(F.get(tokens, 3)),
    )


def _let(value: Column, body) -> Column:
    """Evaluate a value once and use it several times."""
    return F.get(F.transform(F.array(value), body), 0)


def _parsed(keys: Column, fields: Column, error: Column | None = None, note: Column | None = None) -> Column:
    nothing = F.lit(None)
    return F.struct(
        F.coalesce(keys, F.array()).cast("array<string>").alias("file_keys"),
        F.coalesce(fields, F.array().cast(_NO_FIELDS)).cast(_NO_FIELDS).alias("fields"),
        (nothing if error is None else error).cast("string").alias("error"),
        (nothing if note is None else note).cast("string").alias("note"),
    )


def _parse_compact(lines: Column) -> Column:
    """Keys, then one pipe-separated descriptor per field, on a single comma-separated line."""

    def with_segments(segments: Column) -> Column:
        first = F.array_position(F.transform(segments, lambda s: s.contains("|")), True).cast("int")
        return _let(F.struct(segments.alias("segments"), F.greatest(first, F.lit(1)).alias("first")), with_first)

    def with_first(located: Column) -> Column:
        segments, first = located.segments, located.first
        leading = F.slice(segments, F.lit(1), first - 1)
        described = F.slice(segments, first, F.size(segments))
        tokens = F.transform(described, lambda s: _not_blank(F.split(s, r"\|")))
        gaps = F.exists(described, lambda s: F.exists(_cells(s), lambda t: t == ""))
        parts = F.struct(
            F.size(segments).alias("count"), leading.alias("leading"), tokens.alias("descriptors"), gaps.alias("gaps")
        )
        return _let(parts, with_descriptors)

    def with_descriptors(parts: Column) -> Column:
        leading, head = parts.leading, F.get(parts.descriptors, 0)
        extra_key = (F.size(head) >= 6) | ((F.size(head) >= 5) & (F.size(leading) <= 1))
        new_key = extra_key & ~F.array_contains(leading, F.get(head, 0))
        own = F.transform(
            parts.descriptors,
            lambda t, i: F.when(F.size(t) < 4, F.array().cast("array<string>"))
            .when((i == 0) & extra_key, F.slice(t, 2, F.size(t)))
            .otherwise(t),
        )
        fields = F.transform(F.filter(own, lambda t: F.size(t) > 0), _compact_field)
        error = F.when(parts["count"] < 2, F.lit(_COMPACT_TOO_SHORT)).when(F.size(leading) == 0, F.lit(_COMPACT_NO_KEYS))
        note = F.when(parts.gaps, F.lit(_NOTE_GAPS)).when(extra_key & (F.size(head) == 5), F.lit(_NOTE_KEY))
        keys = F.when(new_key, F.concat(leading, F.array(F.get(head, 0)))).otherwise(leading)
        return _parsed(keys, fields, error, note)

    return _let(_not_blank(F.split(F.get(lines, 0), ",")), with_segments)


def _split_keys(value: Column) -> Column:
    return _not_blank(F.split(value, ","))


def _parse_tabular(lines: Column) -> Column:
    """A header line of keys in any order, then one line per field."""

    def with_cells(table: Column) -> Column:
        backwards, rows = F.reverse(F.get(table, 0)), F.slice(table, 2, F.size(table))

        def cell(row: Column, key: str) -> Column:
            # Counted from the end, so that the last of repeated headers wins.
            at = F.size(backwards) - F.array_position(backwards, key).cast("int")
            return F.coalesce(F.get(row, at), F.lit(""))

        key_lists = F.filter(F.transform(rows, lambda r: _split_keys(cell(r, FILE_KEY))), lambda k: F.size(k) > 0)
        fields = F.transform(rows, lambda r: _field(*(cell(r, key) for key in META_KEYS)))
        return _parsed(F.get(key_lists, 0), fields)

    return _let(F.transform(lines, _cells), with_cells)


def _parse_key_value(lines: Column) -> Column:
    """``Key|Value`` lines; a field name closes the record before it if that one is named."""
    attributes = list(META_KEYS)
    record_ddl = "struct<" + ",".join(f"{a}:string" for a in attributes) + ">"
    state_ddl = f"struct<done:array<{record_ddl}>,open:{record_ddl}>"
    blank = F.struct(*(F.lit(None).cast("string").alias(a) for a in attributes))
    start = F.struct(F.array().cast(f"array<{record_ddl}>").alias("done"), blank.alias("open")).cast(state_ddl)

    def is_named(state: Column) -> Column:
        return F.coalesce(state.open.FieldName, F.lit("")) != ""

    def step(state: Column, pair: Column) -> Column:
        closes = (pair.key == "FieldName") & is_named(state)
        done = F.when(closes, F.concat(state.done, F.array(state.open))).otherwise(state.done)
        parts = [
            F.when(pair.key == a, pair.value).when(~closes, state.open.getField(a)).alias(a) for a in attributes
        ]
        return F.struct(done.alias("done"), F.struct(*parts).alias("open")).cast(state_ddl)

    def finish(state: Column) -> Column:
        return F.when(is_named(state), F.concat(state.done, F.array(state.open))).otherwise(state.done)

    def with_pairs(pairs: Column) -> Column:
        records = F.aggregate(F.filter(pairs, lambda p: p.key.isin(*attributes)), start, step, finish)
        fields = F.transform(records, lambda r: _field(*(r.getField(a) for a in attributes)))
        last_keys = F.get(F.reverse(F.filter(pairs, lambda p: p.key == FILE_KEY)), 0)
        return _parsed(_split_keys(last_keys.value), fields)

    pairs = F.transform(
        F.filter(lines, lambda line: line.contains("|")),
        lambda line: F.struct(
            strip(F.substring_index(line, "|", 1)).alias("key"),
            strip(F.substr(line, F.instr(line, "|") + 1)).alias("value"),
        ),
    )
    return _let(pairs, with_pairs)


def parse_sidecars(texts: DataFrame) -> DataFrame:
    """Parse ``(path, text)`` rows into ``path, format, status, note, file_keys, fields``.

    ``status`` is ``ok`` or the reason the sidecar cannot be used; ``note`` warns of
    descriptors that were read in a way their author may not have meant.
    """
    lines = texts.select("path", sidecar_lines(F.col("text")).alias("lines"))
    known = lines.select("path", "lines", sidecar_format(F.col("lines")).alias("format"))
    of_lines = F.col("lines")
    parsed = (
        F.when(F.col("format") == "compact", _parse_compact(of_lines))
        .when(F.col("format") == "tabular", _parse_tabular(of_lines))
        .when(F.col("format") == "keyvalue", _parse_key_value(of_lines))
    )
    # A generator is evaluated once per row; a plain column would be copied into later filters.
    result = known.select("path", "format", F.inline_outer(F.array(parsed)))
    status = (
        F.when(F.col("format") == "empty", F.lit(_EMPTY))
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.size("fields") == 0, F.lit(_NO_DEFINITIONS))
        .when(F.exists("fields", lambda f: f.field_name == ""), F.lit(_EMPTY_NAME))
        .otherwise("ok")
    )
    return result.select("path", "format", status.alias("status"), "note", "file_keys", "fields")


def explode_catalogs(parsed: DataFrame) -> DataFrame:
    """One row per declared field of every usable sidecar, numbered in sidecar order."""
    usable = parsed.where(F.col("status") == "ok")
    rows = usable.select("path", F.posexplode("fields").alias("ordinal", "field"))
    return rows.select("path", "ordinal", "field.*")


def read_sidecars(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Sidecar files as ``(path, text)`` rows; takes folders, globs and single files."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def sidecar_path(data_path: str) -> str:
    return data_path + SIDECAR_SUFFIX


def pair_with_sidecars(files: DataFrame) -> DataFrame:
    """Match each data path with the sidecar of its name; ``found`` says whether it exists.

    ``files`` has one ``path`` per row, data files and sidecars together.
    """
    is_sidecar = F.col("path").endswith(SIDECAR_SUFFIX)
    data = files.where(~is_sidecar).select("path", F.concat("path", F.lit(SIDECAR_SUFFIX)).alias("sidecar_path"))
    sidecars = files.where(is_sidecar).select(F.col("path").alias("sidecar_path"), F.lit(True).alias("present"))
    matched = data.join(sidecars, "sidecar_path", "left")
    return matched.select("path", "sidecar_path", F.coalesce("present", F.lit(False)).alias("found"))


def missing_sidecars(files: DataFrame) -> DataFrame:
    """Data files without a sidecar, each with the error that loading it would give."""
    lost = pair_with_sidecars(files).where(~F.col("found"))
    message = F.concat(F.lit("Metadata file not found: "), F.col("sidecar_path"))
    return lost.select("path", "sidecar_path", message.alias("error"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below a folder as a ``path`` row, without reading contents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select("path")


def load_catalog(spark: SparkSession, path: str) -> Catalog:
    """Read one sidecar; raises with the reason where it cannot be used."""
    try:
        row = parse_sidecars(read_sidecars(spark, path)).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"Metadata file not found: {path}") from error
    if row is None:
        raise ValueError(f"Metadata file is empty: {path}")
    if row["status"] != "ok":
        raise ValueError(f"{row['status']} ({path})")
    return Catalog.from_row(row)
