"""One profile row per declared field, and one for the key."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F, types as T

from tabulant.catalog import Catalog, Field
from tabulant.columns import HELPER_PREFIX, first_row_keys, text
from tabulant.functions.casts import infer_layouts, instant, iso_text, number
from tabulant.operators.median import RANKED_VALUES, bracket, exact_medians
from tabulant.storage import stored

KEY_ROW = "__FILEKEY__"
DUPLICATE_KEYS_SHOWN = 10
# Parts in which a field's values are ranked before the leading ones of all parts are.
RANK_BUCKETS = 64
# Up to this many leading values a field's tasks each send their first ones; more are ranked in parts before.
TASK_RANKS = 1000
# Characters of a text that travel in a count; a longer one travels as these and a digest.
HEAD_CHARS = 32
# Digests sent to all tasks to find their texts (32 bytes each and a field number) or their keys (8 bytes each).
SENT_DIGESTS = 100_000
_DIGEST = HELPER_PREFIX + "digest__"

PROFILE_DDL = (
    "field_name string, ordinal int, stat_type string,"
    "row_count bigint, null_count bigint, distinct_count bigint,"
    "valid_count bigint, parse_success_rate double,"
    "min double, max double, sum double, mean double, median double,"
    "min_ts string, max_ts string,"
    "unique_key_count bigint, duplicate_key_count bigint, uniqueness_ratio double,"
    "top_values array<struct<value:string,freq:bigint>>"
)
_TOP_TYPE = "array<struct<value:string,freq:bigint>>"


def shaped(partial: DataFrame) -> DataFrame:
    """A partial profile with every column of the full one."""
    schema = T.StructType.fromDDL(PROFILE_DDL)
    cells = [
        (F.col(f.name) if f.name in partial.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ]
    filled = partial.select(*cells)
    return filled.withColumn("top_values", F.coalesce("top_values", F.array().cast(_TOP_TYPE)))


def _indexed_fields(df: DataFrame, catalog: Catalog) -> list[tuple[int, Field]]:
    return [(i, f) for i, f in enumerate(catalog.fields) if f.name in df.columns]


def _cells(value: Column) -> list[Column]:
    """A text's first ``HEAD_CHARS`` characters, and a digest of the whole where that is longer."""
    cut = F.length(value) > HEAD_CHARS
    return [F.substring(value, 1, HEAD_CHARS), F.when(cut, F.unhex(F.sha2(value, 256)))]


def value_frequencies(df: DataFrame, columns: Mapping[int, Column]) -> DataFrame:
    """How often each value of each column occurs, null included: ``(field, head, digest, freq)``.

    A value is its first ``HEAD_CHARS`` characters and, if longer, a digest of the whole, so that long texts are never
    moved. All columns share one shuffle. Counts are combined before it, so a value holding a large
    part of all rows sends one row per task.
    """
    cells = [c for key, value in columns.items() for c in (F.lit(key), value)]
    long = df.select(F.stack(F.lit(len(columns)), *cells).alias("field", "value"))
    keyed = long.select("field", *(c.alias(n) for c, n in zip(_cells(F.col("value")), ("head", "digest"))))
    return keyed.groupBy("field", "head", "digest").agg(F.count(F.lit(1)).alias("freq"))


def _texts(df: DataFrame, columns: Mapping[int, Column], wanted: DataFrame) -> DataFrame:
    """The whole texts of the wanted digests: ``(field, digest, whole)``.

    Up to ``SENT_DIGESTS`` of them are sent to the texts, of which only the wanted then move. More, which takes as many
    long texts of one frequency that start alike, are joined by a shuffle.
    """
    cells = [c for key, value in columns.items() for c in (F.lit(key), value)]
    long = df.select(F.stack(F.lit(len(columns)), *cells).alias("field", "whole"))
    long = long.where(F.length("whole") > HEAD_CHARS).withColumn("digest", _cells(F.col("whole"))[1])
    few = wanted.limit(SENT_DIGESTS + 1).count() <= SENT_DIGESTS
    kept = long.join(F.broadcast(wanted) if few else wanted, ["field", "digest"], "left_semi")
    return kept.groupBy("field", "digest").agg(F.first("whole").alias("whole"))


def top_values(
    frequencies: DataFrame, top_n: int, texts: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """The most frequent values per field as one array, ties in value order, null last.

    ``texts`` finds the whole texts of digests, for those among the first and those tied with the last; without it no
    value may be longer than ``HEAD_CHARS``.
    """
    # A short text sorts before the longer ones it begins; long ones that start alike share a rank.
    order = [F.desc("freq"), F.asc_nulls_last("head"), F.col("digest").isNotNull()]
    leading = frequencies
    if top_n > TASK_RANKS:
        # A value among a field's first is among the first of its own bucket, so no task ranks a whole field.
        bucket = F.pmod(F.xxhash64("head", "digest"), F.lit(RANK_BUCKETS))
        by_bucket = Window.partitionBy("field", "bucket").orderBy(*order)
        leading = leading.withColumn("bucket", bucket).withColumn("place", F.rank().over(by_bucket))
        leading = leading.where(F.col("place") <= top_n).drop("bucket", "place")
    by_field = Window.partitionBy("field").orderBy(*order)
    leading = leading.withColumn("rank", F.rank().over(by_field)).where(F.col("rank") <= top_n)
    value, last = F.col("head"), ["rank"]
    if texts is not None:
        leading = stored(leading, "leading")
        found = texts(leading.where(F.col("digest").isNotNull()).select("field", "digest"))
        leading = leading.join(found, ["field", "digest"], "left")
        value, last = F.coalesce("whole", "head"), ["rank", "whole"]
    ranked = leading.withColumn("place", F.row_number().over(Window.partitionBy("field").orderBy(*last)))
    first = ranked.where(F.col("place") <= top_n).groupBy("field").agg(
        F.array_sort(F.collect_list(F.struct("place", value.alias("value"), "freq"))).alias("ranked")
    )
    shown = F.transform("ranked", lambda r: F.struct(r.value.alias("value"), r.freq.alias("freq")))
    return first.select("field", shown.cast(_TOP_TYPE).alias("top_values"))


def character_profile(df: DataFrame, fields: Sequence[tuple[int, Field]], top_n: int) -> DataFrame:
    """Counts, exact distinct count and most frequent values of text fields.

    The counts of values are stored; whole texts are fetched for the leading values alone, in a second read.
    """
    columns = {i: text(df, f.name) for i, f in fields}
    frequencies = stored(value_frequencies(df, columns), "values")
    counts = frequencies.groupBy("field").agg(
        F.sum("freq").alias("row_count"),
        F.sum(F.when(F.col("head").isNull(), F.col("freq")).otherwise(0)).alias("null_count"),
        F.count("head").alias("distinct_count"),
        F.count("digest").alias("long_count"),
    )
    known = {r.field: r for r in counts.collect()}
    rows = [(f.name, i, "Char", *(known[i][1:4] if i in known else (0, 0, 0))) for i, f in fields]
    ddl = "field_name string, ordinal int, stat_type string, row_count bigint, null_count bigint, distinct_count bigint"
    long = any(r.long_count for r in known.values())
    leading = top_values(frequencies, top_n, (lambda wanted: _texts(df, columns, wanted)) if long else None)
    counted = df.sparkSession.createDataFrame(rows, ddl)
    joined = counted.join(leading.withColumnRenamed("field", "ordinal"), "ordinal", "left")
    return joined.withColumn("top_values", F.coalesce("top_values", F.array().cast(_TOP_TYPE)))


def typed_profile(
    df: DataFrame,
    fields: Sequence[tuple[int, Field]],
    order: Sequence[Column],
    layouts: Mapping[str, str] | None = None,
    ranked_values: int = RANKED_VALUES,
) -> DataFrame:
    """Counts, ranges, sums, means and exact medians of numeric and date fields.

    One aggregate over the data gives everything but the medians, and a bracket for each; one row reaches the driver.
    """
    dated = [(i, f) for i, f in fields if f.kind != "Num"]
    chosen = infer_layouts(df, [f.name for _, f in dated], order, layouts) if dated else {}
    values = {i: number(df, f.name) if f.kind == "Num" else instant(df, f.name, chosen.get(f.name)) for i, f in fields}
    parsed = df.select(*(v.alias(f"v{i}") for i, v in values.items()))
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, field in fields:
        value = F.col(f"v{i}")
        aggregates += [F.count(value).alias(f"n{i}"), F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}")]
        if field.kind == "Num":
            aggregates += [F.sum(value).alias(f"sum{i}"), bracket(value).alias(f"mid{i}")]
    totals = parsed.agg(*aggregates)
    for i, _ in dated:
        totals = totals.withColumns({f"lo{i}": iso_text(F.col(f"lo{i}")), f"hi{i}": iso_text(F.col(f"hi{i}"))})
    row = totals.first()
    known = {i: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, f in fields if f.kind == "Num" and row[f"n{i}"]}
    medians = exact_medians(df, values, known, ranked_values, {i: row[f"mid{i}"] for i in known}) if known else {}
    result = []
    for i, field in fields:
        total, valid = row["rows"], row[f"n{i}"]
        base = (field.name, i, field.kind, total, total - valid, valid, valid / total if total else 0.0)
        if field.kind == "Num":
            mean = row[f"sum{i}"] / valid if valid else None
            found = (row[f"lo{i}"], row[f"hi{i}"], row[f"sum{i}"], mean, medians.get(i), None, None)
        else:
            found = (None,) * 5 + (row[f"lo{i}"], row[f"hi{i}"])
        result.append(base + found)
    ddl = (
        "field_name string, ordinal int, stat_type string, row_count bigint, null_count bigint, valid_count bigint,"
        "parse_success_rate double, min double, max double, sum double, mean double, median double,"
        "min_ts string, max_ts string"
    )
    return df.sparkSession.createDataFrame(result, ddl)


def key_frequencies(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How often each key combination occurs; nulls count as equal."""
    return df.select(*(text(df, k).alias(f"k{i}") for i, k in enumerate(keys))).groupBy(
        *(f"k{i}" for i in range(len(keys)))
    ).agg(F.count(F.lit(1)).alias("freq"))


def _key_digest(df: DataFrame, keys: Sequence[str]) -> Column:
    """64 bits that are equal for equal keys, and seldom for others."""
    cells = [text(df, k) for k in keys]
    return F.xxhash64(*cells, *(c.isNull() for c in cells))


def _of_digests(df: DataFrame, digest: Column, wanted: DataFrame, found: int, rows: int) -> DataFrame:
    """The rows whose digest is among the wanted ``(digest, freq)``.

    Up to ``SENT_DIGESTS`` are sent to the rows. Beyond that only the most frequent are, each of which holds more than
    one in ``SENT_DIGESTS`` of all rows; rows of the others are joined by a shuffle, in which no digest is then large.
    """
    marked = df.withColumn(_DIGEST, digest)

    def kept(some: DataFrame, sent: bool) -> DataFrame:
        named_so = some.select(F.col("digest").alias(_DIGEST))
        return marked.join(F.broadcast(named_so) if sent else named_so, _DIGEST, "left_semi").drop(_DIGEST)

    if found <= SENT_DIGESTS:
        return kept(wanted, True)
    hot = F.col("freq") * SENT_DIGESTS > rows
    return kept(wanted.where(hot), True).unionAll(kept(wanted.where(~hot), False))


@dataclass(frozen=True)
class KeyCounts:
    """How many rows there are, how many have a key of their own, and the counts of the other keys.

    ``others`` holds every key that occurs twice or more. It may also hold keys that occur once, where their digests
    are equal to others'; it is None where each row has a key of its own.
    """

    rows: int
    single: int
    others: DataFrame | None


def key_counts(df: DataFrame, keys: Sequence[str], digest: Column | None = None) -> KeyCounts:
    """Count keys in two phases, so that a key that occurs once travels as a digest of eight bytes.

    Digests are counted first. Keys as such are counted only in rows whose digest occurs twice or more, which tells
    different keys of one digest apart, so the counts are exact whatever the digest is.
    """
    digest = _key_digest(df, keys) if digest is None else digest
    seen = Observation()
    counted = df.select(digest.alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("freq"))
    once = F.col("freq") == 1
    # The aggregate's own tasks write these rows, so a task that runs again is not observed twice.
    sums = [F.sum("freq").alias("rows"), F.count_if(once).alias("single"), F.count_if(~once).alias("found")]
    digests = stored(counted.observe(seen, *sums), "keys")
    rows, single, found = (seen.get[c] or 0 for c in ("rows", "single", "found"))
    if not found:
        return KeyCounts(rows, single, None)
    some = _of_digests(df, digest, digests.where(~once), found, rows)
    return KeyCounts(rows, single, stored(key_frequencies(some, keys), "repeated"))


def duplicate_keys(df: DataFrame, keys: Sequence[str], limit: int = DUPLICATE_KEYS_SHOWN) -> DataFrame:
    """Repeated key combinations as ``(rank, value, freq)``, most frequent first, ties in key order."""
    return _ranked_duplicates(df.sparkSession, key_counts(df, keys).others, len(keys), limit)


def _ranked_duplicates(spark: SparkSession, frequencies: DataFrame | None, width: int, limit: int) -> DataFrame:
    if frequencies is None:
        return spark.createDataFrame([], "rank int, value string, freq bigint")
    order = [F.desc("freq"), *(F.asc_nulls_last(f"k{i}") for i in range(width))]
    first = frequencies.where(F.col("freq") > 1).orderBy(*order).limit(limit)
    signature = F.concat_ws("|", *(F.coalesce(f"k{i}", F.lit("<NA>")) for i in range(width)))
    return first.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), signature.alias("value"), "freq")


def key_profile(df: DataFrame, catalog: Catalog, duplicates: int = DUPLICATE_KEYS_SHOWN) -> DataFrame | None:
    """The key's profile row, or None where a key column is absent or no key is declared."""
    keys = catalog.keys
    if not keys or not set(keys) <= set(df.columns):
        return None
    spark, counts = df.sparkSession, key_counts(df, keys)
    first = _ranked_duplicates(spark, counts.others, len(keys), duplicates).agg(
        F.array_sort(F.collect_list(F.struct("rank", "value", "freq"))).alias("ranked")
    )
    shown = F.transform("ranked", lambda r: F.struct(r.value.alias("value"), r.freq.alias("freq")))
    more = repeated = F.lit(0)
    if counts.others is not None:
        sizes = counts.others.agg(F.count(F.lit(1)).alias("more"), F.count_if(F.col("freq") > 1).alias("repeated"))
        more, repeated = sizes.select("more").scalar(), sizes.select("repeated").scalar()
    known = spark.range(1).select(
        F.lit(counts.rows).cast("bigint").alias("row_count"),
        (more + F.lit(counts.single)).cast("bigint").alias("unique_key_count"),
        repeated.cast("bigint").alias("duplicate_key_count"),
    )
    ratio = F.coalesce(F.try_divide("unique_key_count", "row_count"), F.lit(0.0))
    return known.select(
        F.lit(KEY_ROW).alias("field_name"),
        F.lit(len(catalog.fields)).alias("ordinal"),
        F.lit("Key").alias("stat_type"),
        "row_count",
        "unique_key_count",
        "duplicate_key_count",
        ratio.alias("uniqueness_ratio"),
        first.select(shown.cast(_TOP_TYPE)).scalar().alias("top_values"),
    )


def profile(
    df: DataFrame,
    catalog: Catalog,
    top_n: int,
    order: Sequence[Column] | None = None,
    layouts: Mapping[str, str] | None = None,
    ranked_values: int = RANKED_VALUES,
    duplicates: int = DUPLICATE_KEYS_SHOWN,
) -> DataFrame:
    """Profile every declared field present in the data, plus the key.

    The key's row lists its ``duplicates`` most frequent repeated values. ``order`` says which row comes first, which decides how date text is read; it defaults to
    the key columns as text, then the row order of the data.
    """
    fields = _indexed_fields(df, catalog)
    plain = [(i, f) for i, f in fields if f.kind == "Char"]
    typed = [(i, f) for i, f in fields if f.kind != "Char"]
    if order is None:
        order = first_row_keys(df, catalog.keys)
    parts = []
    if plain:
        parts.append(character_profile(df, plain, top_n))
    if typed:
        parts.append(typed_profile(df, typed, order, layouts, ranked_values))
    keyed = key_profile(df, catalog, duplicates)
    if keyed is not None:
        parts.append(keyed)
    if not parts:
        return df.sparkSession.createDataFrame([], PROFILE_DDL)
    return reduce(DataFrame.unionByName, map(shaped, parts))


def field_stats(profiled: DataFrame, names: Sequence[str | None], values: int | None = None) -> DataFrame:
    """Profile rows of the chosen fields, with all their top values or the first ones."""
    chosen = profiled.where(F.col("field_name").isin([n for n in names if n]))
    return chosen if values is None else chosen.withColumn("top_values", F.slice("top_values", 1, values))
