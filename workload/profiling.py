"""Profiles, keys and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabulant.catalog import Catalog, Field
from tabulant.operators.profile import duplicate_keys, field_stats as keep_stats, key_profile, profile, shaped
from tabulant.operators.quality import findings, scorecard
from tabulant.plans.load import load_and_profile
from tabulant.sinks.exports import write_csv
from tabulant.sources.alignment import schema_warnings
from tabulant.storage import beside, new_path, stored
from workload.registry import Registry
from workload.tables import (
    DOCUMENTS,
    LINEITEM,
    MESSY_EVENTS,
    MESSY_EVENTS_SQL,
    ORDERS,
    PART,
    READ_SQL,
    messy_events,
    table,
)

REGISTRY = Registry()
query = REGISTRY.query

TOP_N = 10

_SHAPE = {
    "field_name": "VARCHAR",
    "ordinal": "INTEGER",
    "stat_type": "VARCHAR",
    "row_count": "BIGINT",
    "null_count": "BIGINT",
    "distinct_count": "BIGINT",
    "valid_count": "BIGINT",
    "parse_success_rate": "DOUBLE",
    "min_value": "DOUBLE",
    "max_value": "DOUBLE",
    "sum_value": "DOUBLE",
    "mean_value": "DOUBLE",
    "median_value": "DOUBLE",
    "min_ts": "VARCHAR",
    "max_ts": "VARCHAR",
    "unique_key_count": "BIGINT",
    "duplicate_key_count": "BIGINT",
    "uniqueness_ratio": "DOUBLE",
    "top_values": "VARCHAR",
}


def flat(profiled: DataFrame) -> DataFrame:
    """Comparable profile rows: sums and means rounded, top values as one text."""
    top = F.transform("top_values", lambda v: F.concat_ws("=", F.coalesce(v.value, F.lit("null")), v.freq.cast("string")))
    return profiled.select(
        "field_name",
        "ordinal",
        "stat_type",
        "row_count",
        "null_count",
        "distinct_count",
        "valid_count",
        F.round("parse_success_rate", 9).alias("parse_success_rate"),
        F.col("min").alias("min_value"),
        F.col("max").alias("max_value"),
        F.round("sum", 1).alias("sum_value"),
        F.round("mean", 5).alias("mean_value"),
        F.round("median", 6).alias("median_value"),
        "min_ts",
        "max_ts",
        "unique_key_count",
        "duplicate_key_count",
        F.round("uniqueness_ratio", 9).alias("uniqueness_ratio"),
        F.array_join(top, ";").alias("top_values"),
    )


def _row_sql(values: dict[str, str], source: str) -> str:
    cells = [f"CAST({values.get(c, 'NULL')} AS {t}) AS {c}" for c, t in _SHAPE.items()]
    return f"SELECT {', '.join(cells)} FROM {source}"


def char_sql(source: str, column: str, ordinal: int, top_n: int = TOP_N) -> str:
    counts = f"(SELECT CAST({column} AS VARCHAR) AS v, count(*) AS n FROM {source} GROUP BY 1)"
    top = (
        f"(SELECT string_agg(coalesce(v, 'null') || '=' || n, ';' ORDER BY n DESC, v NULLS LAST) FROM "
        f"(SELECT * FROM {counts} ORDER BY n DESC, v NULLS LAST LIMIT {top_n}))"
    )
    return _row_sql(
        {
            "field_name": f"'{column}'",
            "ordinal": str(ordinal),
            "stat_type": "'Char'",
            "row_count": "sum(n)",
            "null_count": "coalesce(sum(n) FILTER (WHERE v IS NULL), 0)",
            "distinct_count": "count(v)",
            "top_values": top,
        },
        counts,
    )


def num_sql(source: str, column: str, ordinal: int, read: str | None = None) -> str:
    return _row_sql(
        {
            "field_name": f"'{column}'",
            "ordinal": str(ordinal),
            "stat_type": "'Num'",
            "row_count": "count(*)",
            "null_count": "count(*) - count(x)",
            "valid_count": "count(x)",
            "parse_success_rate": "round(count(x) / count(*), 9)",
            "min_value": "min(x)",
            "max_value": "max(x)",
            "sum_value": "round(sum(x), 1)",
            "mean_value": "round(avg(x), 5)",
            "median_value": "round(median(x), 6)",
            "top_values": "''",
        },
        f"(SELECT CAST({read or column} AS DOUBLE) AS x FROM {source})",
    )


def date_sql(source: str, column: str, ordinal: int, kind: str = "Date") -> str:
    def iso(value: str) -> str:
        part = f"CASE WHEN microsecond({value}) % 1000000 <> 0 THEN '.' || strftime({value}, '%f') ELSE '' END"
        return f"strftime({value}, '%Y-%m-%dT%H:%M:%S') || {part} || '+00:00'"

    return _row_sql(
        {
            "field_name": f"'{column}'",
            "ordinal": str(ordinal),
            "stat_type": f"'{kind}'",
            "row_count": "count(*)",
            "null_count": "count(*) - count(t)",
            "valid_count": "count(t)",
            "parse_success_rate": "round(count(t) / count(*), 9)",
            "min_ts": iso("min(t)"),
            "max_ts": iso("max(t)"),
            "top_values": "''",
        },
        f"(SELECT CAST({column} AS TIMESTAMP) AS t FROM {source})",
    )


def key_sql(source: str, keys: tuple[str, ...], ordinal: int) -> str:
    signature = " || '|' || ".join(f"coalesce(CAST({k} AS VARCHAR), '<NA>')" for k in keys)
    order = ", ".join(f"CAST({k} AS VARCHAR) NULLS LAST" for k in keys)
    counts = f"(SELECT {', '.join(keys)}, count(*) AS n FROM {source} GROUP BY ALL)"
    top = (
        f"(SELECT coalesce(string_agg({signature} || '=' || n, ';' ORDER BY n DESC, {order}), '') FROM "
        f"(SELECT * FROM {counts} WHERE n > 1 ORDER BY n DESC, {order} LIMIT 10))"
    )
    return _row_sql(
        {
            "field_name": "'__FILEKEY__'",
            "ordinal": str(ordinal),
            "stat_type": "'Key'",
            "row_count": "sum(n)",
            "unique_key_count": "count(*)",
            "duplicate_key_count": "count(*) FILTER (WHERE n > 1)",
            "uniqueness_ratio": "round(count(*) / sum(n), 9)",
            "top_values": top,
        },
        counts,
    )


def profile_sql(source: str, catalog: Catalog) -> str:
    build = {"Char": char_sql, "Num": num_sql, "Date": date_sql, "Datetime": date_sql}
    parts = [build[f.kind](source, f.name, i) for i, f in enumerate(catalog.fields)]
    return " UNION ALL ".join([*parts, key_sql(source, catalog.keys, len(catalog.fields))])


def _keyless(catalog: Catalog, *names: str) -> Catalog:
    return Catalog((), tuple(f for f in catalog.fields if not names or f.name in names))


# Profile -----------------------------------------------------------------------------------


@query(profile_sql("lineitem", LINEITEM))
def profile_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(profile(table(spark, sf_dir, "lineitem"), LINEITEM, TOP_N))


@query(" UNION ALL ".join(char_sql("part", c, i) for i, c in enumerate(("p_name", "p_brand", "p_type"))))
def profile_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(profile(table(spark, sf_dir, "part"), _keyless(PART, "p_name", "p_brand", "p_type"), TOP_N))


@query(" UNION ALL ".join(char_sql("documents", c, i) for i, c in enumerate(("text", "lang", "source"))))
def profile_char_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(profile(table(spark, sf_dir, "documents"), _keyless(DOCUMENTS, "text", "lang", "source"), TOP_N))


_GAPPED_PART = "(SELECT CASE WHEN p_type = 'ECONOMY' THEN NULL ELSE p_brand END AS brand FROM part)"


@query(char_sql(_GAPPED_PART, "brand", 0, 30))
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.expr("CASE WHEN p_type = 'ECONOMY' THEN NULL ELSE p_brand END").alias("brand")
    return flat(profile(table(spark, sf_dir, "part").select(brand), Catalog((), (Field("brand"),)), 30))


@query(char_sql("orders", "o_orderkey", 0, 5000))
def top_values_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(profile(table(spark, sf_dir, "orders"), _keyless(ORDERS, "o_orderkey"), 5000))


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(num_sql("lineitem", c, i) for i, c in enumerate(_NUMBERS)))
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(profile(table(spark, sf_dir, "lineitem"), _keyless(LINEITEM, *_NUMBERS), TOP_N))


@query(num_sql(f"({MESSY_EVENTS_SQL})", "reading", 0, READ_SQL))
def profile_numeric_messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(profile(messy_events(spark, sf_dir), _keyless(MESSY_EVENTS, "reading"), TOP_N))


@query(date_sql("events", "ts", 0, "Datetime"))
def profile_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(profile(table(spark, sf_dir, "events"), Catalog((), (Field("ts", "Datetime"),)), TOP_N))


_MESSY_DATE = (
    "CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'soon' "
    "WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN NULL "
    "WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN '2099-02-30 00:00:00' "
    "WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' THEN '2099-01-01' ELSE CAST(o_orderdate AS {text}) END"
)


@query(
    date_sql(
        f"(SELECT CASE WHEN regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9:]{{8}}') "
        f"THEN TRY_CAST(d AS TIMESTAMP) END AS ordered FROM (SELECT {_MESSY_DATE.format(text='VARCHAR')} AS d FROM orders))",
        "ordered",
        0,
    )
)
def profile_date_messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = table(spark, sf_dir, "orders").select(F.expr(_MESSY_DATE.format(text="STRING")).alias("ordered"))
    return flat(profile(dates, Catalog((), (Field("ordered", "Date"),)), TOP_N, order=[F.col("ordered")]))


@query(key_sql("lineitem", LINEITEM.keys, len(LINEITEM.fields)))
def key_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = key_profile(table(spark, sf_dir, "lineitem"), LINEITEM)
    return flat(shaped(keyed))


# Whole texts are part of this key.
_WIDE = Catalog(("source", "text"), (Field("lang", "Char"),))


@query(key_sql("documents", _WIDE.keys, len(_WIDE.fields)))
def key_profiles_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(shaped(key_profile(table(spark, sf_dir, "documents"), _WIDE)))


@query(
    """SELECT CAST(row_number() OVER (ORDER BY n DESC, CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS INTEGER)
    AS rank, l_orderkey || '|' || l_linenumber AS value, n AS freq FROM (SELECT l_orderkey, l_linenumber, count(*) AS n
    FROM lineitem GROUP BY ALL HAVING count(*) > 1) ORDER BY rank LIMIT 10"""
)
def duplicate_keys_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(table(spark, sf_dir, "lineitem"), LINEITEM.keys)


@query(
    char_sql("orders", "o_orderpriority", 5) + " UNION ALL " + num_sql("orders", "o_totalprice", 3)
)
def field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiled = profile(table(spark, sf_dir, "orders"), ORDERS, 25)
    return flat(keep_stats(profiled, ["o_orderpriority", "o_totalprice", None]))


# Quality -----------------------------------------------------------------------------------


def _quality(df: DataFrame, catalog: Catalog) -> tuple[DataFrame, DataFrame, DataFrame]:
    return stored(profile(df, catalog, TOP_N), "profile"), catalog.frame(df.sparkSession), schema_warnings(df, catalog)


# Lineitem has two columns its catalog does not declare.
_LINEITEM_RATES = (
    "WITH p AS (" + profile_sql("lineitem", LINEITEM) + "), k AS (SELECT * FROM p WHERE field_name = '__FILEKEY__'), "
    "f AS (SELECT * FROM p WHERE field_name <> '__FILEKEY__'), r AS (SELECT avg(coalesce(parse_success_rate, 1)) AS parse, "
    "avg(null_count / row_count) AS nulls FROM f) "
)


@query(
    _LINEITEM_RATES
    + """SELECT round(parse * 100, 2) AS avg_parse_success_pct, round((1 - parse) * 100, 2) AS invalid_parse_pct,
    round(nulls * 100, 2) AS avg_null_pct, round((SELECT duplicate_key_count / row_count FROM k) * 100, 2) AS duplicate_pk_pct,
    (SELECT duplicate_key_count FROM k) AS duplicate_key_count, CAST(2 AS BIGINT) AS schema_warning_count FROM r"""
)
def quality_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiled, _, warnings = _quality(table(spark, sf_dir, "lineitem"), LINEITEM)
    return scorecard(profiled, warnings)


@query(
    _LINEITEM_RATES
    + """, o AS (SELECT field_name, CASE WHEN min_value > 0 THEN max_value / min_value
    WHEN min_value < 0 AND max_value > 0 THEN max_value - min_value END AS score FROM f
    WHERE stat_type = 'Num' ORDER BY score DESC NULLS LAST, ordinal LIMIT 1)
    SELECT CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS rank, rule, finding FROM (
    SELECT 1 AS place, 'duplicate_keys' AS rule,
    'Detected ' || duplicate_key_count || ' duplicate key combinations in FileKey columns.' AS finding FROM k
    WHERE duplicate_key_count > 0 UNION ALL
    SELECT 5, 'outlier', 'Outlier hint: ' || field_name || ' shows wide spread (max/min-style ratio indicator '
    || format('{:,.2f}', score) || ').' FROM o WHERE score >= 20 UNION ALL
    SELECT 6, 'missing_descriptions', '2 fields are missing FieldDesc metadata.' UNION ALL
    SELECT 7, 'schema_warning', 'Data column missing in metadata: l_partkey' UNION ALL
    SELECT 8, 'schema_warning', 'Data column missing in metadata: l_suppkey')"""
)
def quality_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiled, catalogs, warnings = _quality(table(spark, sf_dir, "lineitem"), LINEITEM)
    return findings(profiled, catalogs, warnings)


@query(
    f"""WITH m AS (SELECT {READ_SQL} AS x FROM ({MESSY_EVENTS_SQL})), s AS (SELECT count(x) / count(*) AS rate,
    avg(x) AS mean, median(x) AS med, max(x) / min(x) AS spread FROM m)
    SELECT CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS rank, rule, finding FROM (
    SELECT 2 AS place, 'missingness' AS rule, 'Average null ratio exceeds 10%; review missingness patterns.' AS finding
    FROM s WHERE (1 - rate) / 3 > 0.1 UNION ALL
    SELECT 3, 'parse_success', 'Type parsing success below 95%; metadata type mismatch likely.'
    FROM s WHERE (rate + 2) / 3 < 0.95 UNION ALL
    SELECT 4, 'skew', 'Distribution hint: reading appears right-skewed (mean/median gap ratio '
    || format('{{:.2f}}', (mean - med) / med) || ').' FROM s WHERE (mean - med) / med >= 0.5 UNION ALL
    SELECT 5, 'outlier', 'Outlier hint: reading shows wide spread (max/min-style ratio indicator '
    || format('{{:,.2f}}', spread) || ').' FROM s WHERE spread >= 20)"""
)
def quality_findings_messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiled, catalogs, warnings = _quality(messy_events(spark, sf_dir), MESSY_EVENTS)
    return findings(profiled, catalogs, warnings)


@query(
    """WITH s AS (SELECT avg(x) AS mean, median(x) AS med FROM (SELECT (o_orderkey % 100)::DOUBLE ** 4 AS x FROM orders))
    SELECT CAST(1 AS INTEGER) AS rank, 'skew' AS rule, 'Distribution hint: x appears right-skewed (mean/median gap ratio '
    || format('{:.2f}', (mean - med) / med) || ').' AS finding FROM s WHERE (mean - med) / med >= 0.5"""
)
def quality_findings_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.pow((F.col("o_orderkey") % 100).cast("double"), F.lit(4.0)).alias("x")
    catalog = Catalog(("o_orderkey",), (Field("o_orderkey", "Char", "", "Order", "D"), Field("x", "Num", "", "Power", "M")))
    profiled, catalogs, warnings = _quality(table(spark, sf_dir, "orders").select("o_orderkey", x), catalog)
    return findings(profiled, catalogs, warnings)


@query(
    """WITH s AS (SELECT avg(x) AS mean, median(x) AS med FROM (SELECT (o_orderkey % 100)::DOUBLE ** 4 AS x FROM orders))
    SELECT CAST(row_number() OVER (ORDER BY rule DESC) AS INTEGER) AS rank, rule, finding FROM (
    SELECT 'skew' AS rule, 'Distribution hint: x appears right-skewed (mean/median gap ratio '
    || format('{:.2f}', (mean - med) / med) || ').' AS finding FROM s WHERE (mean - med) / med >= 0.5 UNION ALL
    SELECT 'outlier', 'Outlier hint: y shows wide spread (max/min-style ratio indicator inf).'
    FROM orders WHERE o_orderkey % 100 IN (1, 2) HAVING count(DISTINCT o_orderkey % 100) = 2)"""
)
def quality_findings_infinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of ``y`` is no number, so it hides no other field's skew."""
    place = F.col("o_orderkey") % 100
    x = F.pow(place.cast("double"), F.lit(4.0)).alias("x")
    y = F.when(place == 1, float("inf")).when(place == 2, float("-inf")).otherwise(1.0).alias("y")
    fields = [Field("o_orderkey", "Char", "", "Order", "D"), *(Field(n, "Num", "", f"Measure {n}", "M") for n in ("y", "x"))]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", y, x)
    profiled, catalogs, warnings = _quality(rows, Catalog(("o_orderkey",), tuple(fields)))
    return findings(profiled, catalogs, warnings).where(F.col("rule").isin("skew", "outlier")).withColumn(
        "rank", F.row_number().over(Window.orderBy("rank"))
    )


@query(
    """SELECT CAST(1 AS INTEGER) AS rank, 'all_clear' AS rule, 'No major data quality risks detected from quick profile.' AS finding
    FROM (SELECT count(*) - count(DISTINCT o_orderkey) AS repeated, avg(CAST(o_orderstatus IS NULL AS INTEGER)) AS gaps FROM orders)
    WHERE repeated = 0 AND gaps <= 0.1"""
)
def quality_findings_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (Field("o_orderkey", "Char", "", "Order", "D"), Field("o_orderstatus", "Char", "", "Status", "D"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    profiled, catalogs, warnings = _quality(orders, Catalog(("o_orderkey",), fields))
    return findings(profiled, catalogs, warnings)


# Load --------------------------------------------------------------------------------------

_SIDECAR = "FileKey|o_orderkey\n" + "\n".join(
    f"FieldName|{f.name}\nFieldType|{f.type}\nFieldDesc|{f.desc}\nFieldDType|{f.role}" for f in ORDERS.fields
)


@query(profile_sql("orders", ORDERS))
def load_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "orders-csv")
    write_csv(table(spark, sf_dir, "orders"), path)
    spark.createDataFrame([(_SIDECAR,)], "value string").write.text(beside(path, "_Meta"))
    return flat(load_and_profile(spark, path, TOP_N).profile)
