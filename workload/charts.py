"""Chart data over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulant.operators.charts import chart_data
from tabulant.operators.ordering import RECORD, number_records
from workload.registry import Registry
from workload.tables import MESSY_EVENTS_SQL, READ_SQL, messy_events, table

REGISTRY = Registry()
query = REGISTRY.query


@query("SELECT l_returnflag AS dimension, round(sum(l_extendedprice), 1) AS measure FROM lineitem GROUP BY 1")
def chart_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = chart_data(table(spark, sf_dir, "lineitem"), " Bar ", "l_returnflag", "l_extendedprice")
    return bars.withColumn("measure", F.round("measure", 1))


@query(
    f"""SELECT event_type AS dimension, round(sum(x), 2) AS measure FROM (SELECT *, {READ_SQL} AS x FROM
    (SELECT CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS event_type, reading FROM ({MESSY_EVENTS_SQL})))
    WHERE x IS NOT NULL GROUP BY 1"""
)
def chart_bar_messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE WHEN event_type = 'click' THEN NULL ELSE event_type END")
    bars = chart_data(messy_events(spark, sf_dir).withColumn("event_type", kind), "bar", "event_type", "reading")
    return bars.withColumn("measure", F.round("measure", 2))


@query(
    """SELECT dimension, round(s, 1) AS measure, round(s / sum(s) OVER (), 6) AS share FROM
    (SELECT o_orderpriority AS dimension, sum(o_totalprice) AS s FROM orders GROUP BY 1)"""
)
def chart_pie(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = chart_data(table(spark, sf_dir, "orders"), "Pie", "o_orderpriority", "o_totalprice")
    return slices.select("dimension", F.round("measure", 1).alias("measure"), F.round("share", 6).alias("share"))


@query(
    """SELECT l_returnflag AS dimension, l_linestatus AS color, round(sum(l_quantity), 1) AS measure
    FROM lineitem GROUP BY 1, 2"""
)
def chart_stacked_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = chart_data(table(spark, sf_dir, "lineitem"), "Stacked Bar", "l_returnflag", "l_quantity", "l_linestatus")
    return bars.withColumn("measure", F.round("measure", 1))


@query(
    """SELECT row_number() OVER (ORDER BY o_orderkey) AS dimension, o_totalprice AS measure, o_orderstatus AS color
    FROM orders"""
)
def chart_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = number_records(table(spark, sf_dir, "orders"), [F.col("o_orderkey")])
    return chart_data(numbered, "line", RECORD, "o_totalprice", "o_orderstatus", [F.col(RECORD)])


@query("SELECT l_shipdate AS dimension, l_extendedprice AS measure, l_linestatus AS color FROM lineitem")
def chart_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart_data(table(spark, sf_dir, "lineitem"), "scatter", "l_shipdate", "l_extendedprice", "l_linestatus")


@query(
    """WITH b AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 10 AS w,
    max(l_extendedprice) AS hi FROM lineitem)
    SELECT l_returnflag AS dimension, CAST(least(floor((l_extendedprice - lo) / w), 9) AS INTEGER) AS bin,
    round(min(lo + w * least(floor((l_extendedprice - lo) / w), 9)), 4) AS bin_low, count(*) AS count
    FROM lineitem, b GROUP BY 1, 2"""
)
def chart_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = chart_data(table(spark, sf_dir, "lineitem"), "histogram", "l_returnflag", "l_extendedprice")
    return bars.select("dimension", "bin", F.round("bin_low", 4).alias("bin_low"), "count")


@query(
    """SELECT 'Unsupported chart type: radar' AS message, count(*) AS points FROM orders UNION ALL
    SELECT 'Select both dimension and measure.', count(*) FROM orders UNION ALL
    SELECT 'Selected fields are not available in the dataset.', count(*) FROM orders UNION ALL
    SELECT 'Stacked Bar requires a second dimension.', count(*) FROM orders UNION ALL
    SELECT 'Scatter uses second dimension for color grouping.', count(*) FROM orders"""
)
def chart_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    asked = [
        ("radar", "o_orderstatus", "o_totalprice"),
        ("bar", "", "o_totalprice"),
        ("bar", "O_ORDERSTATUS", "o_totalprice"),
        ("stacked bar", "o_orderstatus", "o_totalprice"),
        ("scatter", "o_orderstatus", "o_totalprice"),
    ]
    messages = []
    for kind, dimension, measure in asked:
        try:
            chart_data(orders, kind, dimension, measure)
        except ValueError as reason:
            messages.append(F.lit(str(reason)))
    points = chart_data(orders, "line", "o_orderdate", "o_totalprice")
    return points.agg(F.count(F.lit(1)).alias("points")).select(F.explode(F.array(*messages)).alias("message"), "points")


@query(
    """WITH b AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 10 AS w FROM lineitem)
    SELECT kind, l_returnflag AS dimension, CASE WHEN kind IN ('bar', 'stacked bar') THEN count(DISTINCT l_linestatus)
    WHEN kind = 'histogram' THEN count(DISTINCT least(floor((l_quantity - lo) / w), 9)) WHEN kind IN ('line', 'scatter') THEN count(*)
    ELSE 1 END AS points,
    CASE kind WHEN 'histogram' THEN count(*) ELSE CAST(sum(l_quantity) AS BIGINT) END AS total
    FROM lineitem, b, unnest(['pie', 'bar', 'stacked bar', 'line', 'scatter', 'histogram']) AS kinds(kind) GROUP BY kind, l_returnflag"""
)
def chart_dispatch_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and total per dimension value of every kind of chart, asked for in any spelling."""
    lines, charts = table(spark, sf_dir, "lineitem"), []
    for kind in ("Pie", " bar", "Stacked Bar", "LINE", "scatter ", "Histogram"):
        data = chart_data(lines, kind, "l_returnflag", "l_quantity", "l_linestatus")
        size = F.sum("count" if "count" in data.columns else "measure").cast("long").alias("total")
        found = data.groupBy("dimension").agg(F.count(F.lit(1)).alias("points"), size)
        charts.append(found.select(F.lit(kind.strip().lower()).alias("kind"), "dimension", "points", "total"))
    return reduce(DataFrame.unionByName, charts)


_SOME_INFINITE = (
    "CASE o_orderkey % 50 WHEN 0 THEN CAST('Infinity' AS DOUBLE) WHEN 1 THEN CAST('-Infinity' AS DOUBLE) ELSE o_totalprice END"
)


@query(
    f"""WITH v AS (SELECT o_orderstatus AS dimension, {_SOME_INFINITE} AS x FROM orders),
    b AS (SELECT min(x) AS lo, (max(x) - min(x)) / 10 AS w FROM v WHERE isfinite(x))
    SELECT dimension, CAST(CASE WHEN x = 'Infinity' THEN 10 WHEN x = '-Infinity' THEN -1
    ELSE least(floor((x - lo) / w), 9) END AS INTEGER) AS bin, count(*) AS count FROM v, b GROUP BY ALL"""
)
def chart_histogram_infinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", F.expr(_SOME_INFINITE).alias("x"))
    return chart_data(orders, "histogram", "o_orderstatus", "x").select("dimension", "bin", "count")
