"""Sorting, paging, guards, options and display."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabulant.functions.display import (
    display_measures as show_measures,
    display_nested as show_nested,
    display_number as show_number,
    display_scorecard as show_scorecard,
    metric_label,
)
from tabulant.operators.options import dimension_values as list_values, measure_ranges as list_ranges
from tabulant.operators.ordering import (
    RECORD,
    key_order,
    large_result_guard as guard,
    number_records,
    page as fetch,
    page_after,
    page_of_snapshot,
    preview as first_rows,
    sort_order,
)
from tabulant.operators.profile import profile
from tabulant.operators.quality import scorecard
from tabulant.plans.view import View, ViewSpec, fetch_page
from tabulant.sources.alignment import schema_warnings
from tabulant.sources.snapshot import write_snapshot
from tabulant.storage import stored
from workload.registry import Registry
from workload.tables import LINEITEM, ORDERS, PART, table

REGISTRY = Registry()
query = REGISTRY.query

# Lineitem's declared key repeats, so these columns break its ties.
TIES = ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
_TIES_SQL = ", ".join(TIES)
_LINE_KEYS_SQL = f"CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), {_TIES_SQL}"
_LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
_LINE_COLUMNS_SQL = ", ".join(_LINE_COLUMNS)


@query(
    f"SELECT row_number() OVER (ORDER BY {_LINE_KEYS_SQL}) AS record_number, {_LINE_COLUMNS_SQL} FROM lineitem"
)
def sort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return number_records(lines, key_order(lines, LINEITEM, TIES)).select(RECORD, *_LINE_COLUMNS)


@query(
    """SELECT row_number() OVER (ORDER BY p_brand DESC, CAST(p_size AS VARCHAR), p_partkey) AS record_number,
    p_partkey, p_brand, p_size FROM part"""
)
def sort_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    model = [{"colId": "p_brand", "sort": "desc"}, {"colId": "nothing"}, {"colId": "p_size", "sort": "up"}]
    return number_records(part, sort_order(part, model, ["p_partkey"])).select(RECORD, "p_partkey", "p_brand", "p_size")


@query(
    """SELECT row_number() OVER (ORDER BY CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_brand END DESC NULLS LAST, p_partkey)
    AS record_number, p_partkey FROM part"""
)
def sort_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.expr("CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_brand END")
    part = table(spark, sf_dir, "part").withColumn("p_brand", brand)
    return number_records(part, sort_order(part, [{"colId": "p_brand", "sort": "desc"}], ["p_partkey"])).select(
        RECORD, "p_partkey"
    )


@query(
    """SELECT row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS record_number, o_orderkey, o_orderpriority
    FROM orders"""
)
def record_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return number_records(orders, [F.col("o_orderpriority").asc_nulls_last(), F.col("o_orderkey")])


@query(f"SELECT {_LINE_COLUMNS_SQL} FROM lineitem ORDER BY {_LINE_KEYS_SQL} LIMIT 250")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return first_rows(lines, 250, key_order(lines, LINEITEM, TIES)).select(*_LINE_COLUMNS)


_PAGE_FILTER = {"l_quantity": {"filterType": "number", "type": "greaterThan", "filter": 10}}
_PAGE_SORT = [{"colId": "l_returnflag", "sort": "asc"}, {"colId": "l_extendedprice", "sort": "desc"}]
_PAGE_TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_PAGE_SQL = (
    "SELECT record_number, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT row_number() OVER "
    "(ORDER BY l_returnflag, CAST(l_extendedprice AS VARCHAR) DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) "
    "AS record_number, * FROM lineitem WHERE l_quantity > 10) WHERE record_number > {start} AND record_number <= {end}"
)


def _page(spark: SparkSession, sf_dir: str, start: int, end: int | None, top_rows: int = 100_000) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    rows, _ = fetch(lines, _PAGE_FILTER, _PAGE_SORT, start, end, _PAGE_TIES, top_rows)
    return rows.select(RECORD, *_LINE_COLUMNS)


@query(_PAGE_SQL.format(start=1000, end=1500))
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, 1000, None)


@query(_PAGE_SQL.format(start=3000, end=3700))
def page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, 3000, 3700, top_rows=2000)


_THRICE = "(SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem)"


@query(
    f"""SELECT record_number, l_orderkey, l_linenumber FROM (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber)
    AS record_number, * FROM {_THRICE}) WHERE record_number > 12000 AND record_number <= 12300"""
)
def page_beyond_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    lines = table(spark, sf_dir, "lineitem").select(*keys)
    rows, _ = fetch(lines.unionAll(lines).unionAll(lines), None, None, 12_000, 12_300, keys)
    return rows.select(RECORD, *keys)


@query(
    f"""SELECT * FROM (SELECT row_number() OVER (ORDER BY {_LINE_KEYS_SQL}) AS record_number, {_LINE_COLUMNS_SQL}
    FROM lineitem WHERE l_returnflag = 'R') WHERE record_number BETWEEN 301 AND 700"""
)
def view_snapshot_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ViewSpec(preview_rows=100, dimension_rows=[("l_returnflag", ["R"])], tiebreak=TIES)
    stored_view = View(table(spark, sf_dir, "lineitem"), LINEITEM, spec).snapshot()
    first, second = (fetch_page(stored_view, start=at, end=at + 200)[0] for at in (300, 500))
    return first.unionAll(second).select(RECORD, *_LINE_COLUMNS)


@query("SELECT count(*) AS row_count FROM lineitem WHERE l_quantity > 10")
def page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch(table(spark, sf_dir, "lineitem"), _PAGE_FILTER, _PAGE_SORT, 0, 100, _PAGE_TIES)[1]


@query(
    f"""SELECT * FROM (SELECT row_number() OVER (ORDER BY {_LINE_KEYS_SQL}) AS record_number, {_LINE_COLUMNS_SQL}
    FROM lineitem) WHERE record_number BETWEEN 2001 AND 2500"""
)
def page_from_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    snapshot = write_snapshot(lines, key_order(lines, LINEITEM, TIES))
    return page_of_snapshot(snapshot, 2000).select(RECORD, *_LINE_COLUMNS)


@query(
    """SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority > '3-MEDIUM'
    OR (o_orderpriority = '3-MEDIUM' AND o_orderkey > 500) ORDER BY o_orderpriority, o_orderkey LIMIT 500"""
)
def page_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    last = {"o_orderpriority": "3-MEDIUM", "o_orderkey": 500}
    rows = page_after(orders, [{"colId": "o_orderpriority"}], last, tiebreak=["o_orderkey"])
    return rows.select("o_orderkey", "o_orderpriority")


@query(
    """SELECT count(*) AS total_rows, CAST(11 AS BIGINT) AS total_columns,
    count(*) > 200000 OR count(*) * 11 > 12000000 AS blocked, CASE WHEN count(*) > 200000 OR count(*) * 11 > 12000000
    THEN 'Large result guard active: ' || format('{:,}', count(*)) || ' rows x 11 columns. Grid rendering is limited to first '
    || '1,000 rows. Use Export Filtered CSV to download the full filtered dataset.' END AS message FROM lineitem"""
)
def large_result_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard(table(spark, sf_dir, "lineitem"), 1000)


@query(
    """SELECT count(*) AS total_rows, CAST(11 AS BIGINT) AS total_columns, count(*) > 1000 AS blocked,
    'Large result guard active: ' || format('{:,}', count(*)) || ' rows x 11 columns. Grid rendering is limited to first '
    || '50 rows. Use Export Filtered CSV to download the full filtered dataset.' AS message FROM lineitem"""
)
def large_result_guard_firing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard(table(spark, sf_dir, "lineitem"), 50, most_rows=1000)


@query(
    f"""SELECT l_discount, l_extendedprice, l_linenumber, l_linestatus, l_orderkey, l_partkey, l_quantity, l_returnflag,
    l_shipdate, l_suppkey, l_tax FROM lineitem WHERE l_returnflag IN ('A', 'R') AND (l_quantity BETWEEN 1 AND 10
    OR l_quantity BETWEEN 30 AND 40) AND l_linestatus = 'F'"""
)
def view_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ViewSpec(
        preview_rows=100,
        dimension_rows=[("l_returnflag", ["A", "R"])],
        measure_rows=[("l_quantity", ["between 1 and 10", "between 30 and 40"])],
        drill_dimension="l_linestatus",
        drill_point={"x": "F"},
        alphabetical=True,
    )
    return View(table(spark, sf_dir, "lineitem"), LINEITEM, spec).rows


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus,
    CASE WHEN o_totalprice = floor(o_totalprice) THEN format('{:,}', CAST(o_totalprice AS BIGINT))
    ELSE format('{:,.4f}', o_totalprice) END AS o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P')
    ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 300"""
)
def view_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ViewSpec(
        preview_rows=300,
        dimension_rows=[("o_orderstatus", ["F", "P"])],
        visible=["o_orderkey", "o_orderstatus", "o_totalprice"],
    )
    shown = View(table(spark, sf_dir, "orders"), ORDERS, spec).preview()
    return shown.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderstatus", "o_totalprice")


# Options -----------------------------------------------------------------------------------


@query("SELECT DISTINCT trim(p_name) AS value FROM part WHERE trim(p_name) <> '' ORDER BY value LIMIT 2500")
def dimension_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_values(table(spark, sf_dir, "part"), "p_name", 2500)


@query("SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS value FROM orders")
def dimension_values_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_values(table(spark, sf_dir, "orders"), "o_orderkey")


@query(
    """WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), r AS (
    SELECT CAST(i AS INTEGER) AS position, lo + i * ((hi - lo) / 10) AS low,
    CASE WHEN i = 9 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 10) END AS high FROM b, generate_series(0, 9) AS g(i))
    SELECT position, low, high, 'between ' || CAST(low AS VARCHAR) || ' and ' || CAST(high AS VARCHAR) AS expression,
    CASE WHEN low = floor(low) THEN format('{:,}', CAST(low AS BIGINT)) ELSE format('{:,.4f}', low) END || ' to ' ||
    CASE WHEN high = floor(high) THEN format('{:,}', CAST(high AS BIGINT)) ELSE format('{:,.4f}', high) END AS label FROM r"""
)
def measure_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_ranges(table(spark, sf_dir, "orders"), "o_totalprice")


# Display -----------------------------------------------------------------------------------

_SHOWN_PRICE = (
    "CASE WHEN {x} = floor({x}) THEN format('{{:,}}', CAST({x} AS BIGINT)) ELSE format('{{:,.4f}}', {x}) END"
)


@query(
    f"""SELECT o_orderkey, {_SHOWN_PRICE.format(x='o_totalprice')} AS price, format('{{:,}}', o_custkey) AS customer,
    o_orderpriority AS priority FROM orders"""
)
def display_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey",
        show_number(F.col("o_totalprice"), T.DoubleType()).alias("price"),
        show_number(F.col("o_custkey"), T.LongType()).alias("customer"),
        show_number(F.col("o_orderpriority"), T.StringType()).alias("priority"),
    )


@query(
    f"""SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, {_SHOWN_PRICE.format(x='p_retailprice')} AS p_retailprice,
    p_brand FROM part"""
)
def display_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    return show_measures(part, PART)


@query(
    f"""SELECT o_orderkey, {_SHOWN_PRICE.format(x='o_totalprice')} AS total, format('{{:,}}', o_orderkey) AS first_freq,
    o_orderstatus AS first_value, {_SHOWN_PRICE.format(x='(o_totalprice / 4)')} AS quarter FROM orders"""
)
def display_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.struct(
        F.create_map(
            F.lit("total"), F.col("o_totalprice"), F.lit("quarter"), F.col("o_totalprice") / 4
        ).alias("metrics"),
        F.array(F.struct(F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("freq"))).alias("top_values"),
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", payload.alias("p"))
    shown = rows.select("o_orderkey", show_nested(F.col("p"), rows.schema["p"].dataType).alias("p"))
    return shown.select(
        "o_orderkey",
        F.col("p.metrics")["total"].alias("total"),
        F.col("p.top_values")[0]["freq"].alias("first_freq"),
        F.col("p.top_values")[0]["value"].alias("first_value"),
        F.col("p.metrics")["quarter"].alias("quarter"),
    )


@query(
    """SELECT total_rows, CAST(11 AS BIGINT) AS total_columns, total_rows > 1000 AS blocked, CASE WHEN total_rows > 1000 THEN
    'Large result guard active: ' || format('{:,}', total_rows) || ' rows x 11 columns. Grid rendering is limited to first 50 rows.'
    || ' Use Export Filtered CSV to download the full filtered dataset.' END AS message
    FROM (SELECT count(*) AS total_rows FROM lineitem WHERE l_returnflag = 'R')"""
)
def view_guard_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ViewSpec(preview_rows=50, dimension_rows=[("l_returnflag", ["R"])])
    return View(table(spark, sf_dir, "lineitem"), LINEITEM, spec).counts(most_rows=1000)


@query(
    """SELECT p_partkey, array_to_string(list_transform(string_split(p_name || ' ' || lower(p_type), ' '),
    lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label FROM part"""
)
def metric_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.replace("p_name", F.lit(" "), F.lit("__")), F.lit("_ "), F.lower("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", metric_label(key).alias("label"))


@query(
    """SELECT 'Duplicate Pk Pct' AS metric, '0%' AS value UNION ALL SELECT 'Avg Null Pct', '0%' UNION ALL
    SELECT 'Avg Parse Success Pct', '100%' UNION ALL SELECT 'Invalid Parse Pct', '0%' UNION ALL
    SELECT 'Duplicate Key Count', format('{:,}', count(*) - count(DISTINCT o_orderkey)) FROM orders UNION ALL
    SELECT 'Schema Warning Count', '0'"""
)
def display_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    profiled = stored(profile(orders, ORDERS, 10), "profile")
    return show_scorecard(scorecard(profiled, schema_warnings(orders, ORDERS)))
