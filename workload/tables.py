"""The given tables and what is declared about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabulant.catalog import Catalog, Field


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINEITEM = Catalog(
    ("l_orderkey", "l_linenumber"),
    (
        Field("l_orderkey", "Char", "", "Order", "D"),
        Field("l_linenumber", "Num", "", "Line", "D"),
        Field("l_returnflag", "Char", "1", "Return flag", "D"),
        Field("l_linestatus", "Char", "1", "", "D"),
        Field("l_shipdate", "Date", "", "Shipped on", "D"),
        Field("l_quantity", "Num", "", "Quantity", "M"),
        Field("l_extendedprice", "Num", "", "Price", "M"),
        Field("l_discount", "Num", "", " ", "M"),
        Field("l_tax", "Num", "", "Tax", "M"),
    ),
)

ORDERS = Catalog(
    ("o_orderkey",),
    (
        Field("o_orderkey", "Char", "", "Order", "D"),
        Field("o_custkey", "Char", "", "Customer", "D"),
        Field("o_orderstatus", "Char", "1", "Status", "D"),
        Field("o_totalprice", "Num", "", "Total price", "M"),
        Field("o_orderdate", "Date", "", "Ordered on", "D"),
        Field("o_orderpriority", "Char", "", "Priority", "D"),
    ),
)

CUSTOMER = Catalog(
    ("c_custkey",),
    (
        Field("c_custkey", "Char", "", "Customer", "D"),
        Field("c_name", "Char", "", "Name", "D"),
        Field("c_nationkey", "Char", "", "Nation", "D"),
        Field("c_acctbal", "Num", "", "Balance", "M"),
        Field("c_mktsegment", "Char", "", "Segment", "D"),
    ),
)

PART = Catalog(
    ("p_partkey",),
    (
        Field("p_partkey", "Char", "", "Part", "D"),
        Field("p_name", "Char", "", "Name", "D"),
        Field("p_brand", "Char", "", "Brand", "D"),
        Field("p_type", "Char", "", "Type", "D"),
        Field("p_size", "Num", "", "Size", "M"),
        Field("p_retailprice", "Num", "", "Price", "M"),
    ),
)

DOCUMENTS = Catalog(
    ("doc_id",),
    (
        Field("doc_id", "Char", "", "Document", "D"),
        Field("text", "Char", "", "Text", "D"),
        Field("lang", "Char", "", "Language", "D"),
        Field("source", "Char", "", "Source", "D"),
        Field("n_chars", "Num", "", "Length", "M"),
    ),
)

MESSY_EVENTS = Catalog(
    ("event_id",),
    (
        Field("event_id", "Char", "", "Event", "D"),
        Field("event_type", "Char", "", "Type", "D"),
        Field("reading", "Num", "", "Reading", "M"),
    ),
)

# The same expression in both engines: some readings are words, some missing, some badly written.
MESSY_READING_SQL = (
    "CASE WHEN event_type = 'error' THEN 'bad' WHEN event_type = 'signup' THEN NULL "
    "WHEN event_type = 'view' AND value > 100 THEN '1_000' WHEN event_type = 'view' AND value > 50 THEN '1e400' "
    "WHEN event_type = 'view' THEN '5d' ELSE ' ' || CAST(value AS {text}) || ' ' END"
)
MESSY_EVENTS_SQL = (
    f"SELECT event_id, event_type, {MESSY_READING_SQL.format(text='VARCHAR')} AS reading FROM events"
)
# How the SQL side reads such a cell; its own cast accepts more than counts as readable.
READ_SQL = (
    "CASE WHEN regexp_full_match(reading, '\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*') "
    "AND isfinite(TRY_CAST(trim(reading) AS DOUBLE)) THEN TRY_CAST(trim(reading) AS DOUBLE) END"
)


def messy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    reading = F.expr(MESSY_READING_SQL.format(text="STRING"))
    return table(spark, sf_dir, "events").select("event_id", "event_type", reading.alias("reading"))


def rounded(column: str, digits: int, name: str | None = None) -> Column:
    return F.round(F.col(column), digits).alias(name or column)
