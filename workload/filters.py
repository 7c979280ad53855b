"""Filters of every kind over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulant.operators.filters import (
    apply_filters,
    apply_grid_filters,
    apply_value_and_range_filters,
    drill_through as keep_clicked,
)
from tabulant.catalog import Catalog, Field
from workload.registry import Registry
from workload.tables import CUSTOMER, DOCUMENTS, LINEITEM, MESSY_EVENTS_SQL, ORDERS, PART, READ_SQL, messy_events, table

REGISTRY = Registry()
query = REGISTRY.query


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE regexp_matches(c_mktsegment, 'mach|^build', 'i')")
def filter_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = apply_filters(table(spark, sf_dir, "customer"), CUSTOMER, {"c_mktsegment": "mach|^build"}, {})
    return kept.select("c_custkey", "c_mktsegment")


@query("SELECT doc_id, n_chars FROM documents WHERE regexp_matches(text, 'la [a-z]+\\. e|\\bin the\\b', 'i')")
def filter_contains_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = apply_filters(table(spark, sf_dir, "documents"), DOCUMENTS, {"text": r"la [a-z]+\. e|\bin the\b"}, {})
    return kept.select("doc_id", "n_chars")


def _compare(op: str, value: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept = apply_filters(table(spark, sf_dir, "lineitem"), LINEITEM, {}, {"l_quantity": f" {op} {value} "})
        return kept.select("l_orderkey", "l_linenumber", "l_quantity")

    return run


for _name, _op in {"lt": "<", "gt": ">", "le": "<=", "ge": ">=", "eq": "="}.items():
    REGISTRY.add(
        f"filter_compare_{_name}",
        _compare(_op, "25.0"),
        f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_op} 25.0",
    )


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice BETWEEN 1e4 AND 20000.5")
def filter_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = apply_filters(
        table(spark, sf_dir, "lineitem"), LINEITEM, {}, {"l_extendedprice": "BETWEEN 1e4 and 20000.5"}
    )
    return kept.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT p_partkey, p_retailprice FROM part")
def filter_unrecognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = apply_filters(table(spark, sf_dir, "part"), PART, {"no_field": "x"}, {"p_retailprice": "about 900"})
    return kept.select("p_partkey", "p_retailprice")


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
    WHERE regexp_matches(l_returnflag, 'a|n', 'i') AND l_quantity BETWEEN 10 AND 20 AND l_discount >= 0.05"""
)
def filter_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    dimensions = {"l_returnflag": "a|n", "l_linestatus": "  ", "l_quantity": "wrong role"}
    measures = {"l_quantity": "between 10 and 20", "l_discount": ">=0.05", "l_returnflag": ">1", "l_tax": ""}
    kept = apply_filters(table(spark, sf_dir, "lineitem"), LINEITEM, dimensions, measures)
    return kept.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query(
    """SELECT o_orderkey, o_orderpriority, o_custkey FROM orders
    WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_custkey IN (10, 20, 30, 40, 50, 60, 70, 80, 90, 100)"""
)
def filter_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        ("o_orderpriority", ["1-URGENT", "5-LOW", "", None, "5-low"]),
        ("o_custkey", [str(10 * i) for i in range(1, 11)] + ["010", " 20"]),
        ("o_orderstatus", []),
    ]
    kept = apply_value_and_range_filters(table(spark, sf_dir, "orders"), ORDERS, rows, [])
    return kept.select("o_orderkey", "o_orderpriority", "o_custkey")


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
    WHERE (l_quantity BETWEEN 1 AND 5 OR l_quantity > 45 OR l_quantity BETWEEN 20 AND 21) AND l_discount <= 0.03"""
)
def filter_or_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = [("l_quantity", ["between 1 and 5", " >45 ", (20.0, 21.0), ""]), ("l_discount", ["<=0.03"])]
    kept = apply_value_and_range_filters(table(spark, sf_dir, "lineitem"), LINEITEM, [], ranges)
    return kept.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#2'")
def drill_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = keep_clicked(table(spark, sf_dir, "part"), "p_brand", {"label": "Brand#2"})
    return kept.select("p_partkey", "p_brand")


@query("SELECT p_partkey, p_size FROM part WHERE p_size = 11")
def drill_through_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = keep_clicked(table(spark, sf_dir, "part"), "p_size", {"x": 11, "label": "ignored"})
    return kept.select("p_partkey", "p_size")


# Readings that are missing act as empty text, so the negative operators keep them.
_TEXT_OPS = {
    "contains": ("[BD]A", "regexp_matches(cell, '[BD]A', 'i')"),
    "notContains": ("[BD]A", "NOT regexp_matches(cell, '[BD]A', 'i')"),
    "equals": ("BAD", "lower(cell) = 'bad'"),
    "notEqual": (" Bad ", "lower(cell) <> 'bad'"),
    "startsWith": ("Ba", "starts_with(lower(cell), 'ba')"),
    "endsWith": ("_000", "ends_with(lower(cell), '_000')"),
}

_NUMBER_OPS = {
    "equals": ({"filter": "2.64"}, "x = 2.64"),
    "notEqual": ({"filter": "2.64"}, "x <> 2.64"),
    "lessThan": ({"filter": 50}, "x < 50"),
    "lessThanOrEqual": ({"filter": "50"}, "x <= 50"),
    "greaterThan": ({"filter": "1,00"}, "x > 100"),
    "greaterThanOrEqual": ({"filter": 100.5}, "x >= 100.5"),
    "inRange": ({"filter": "10", "filterTo": "1,0.5e1"}, "x BETWEEN 10 AND 105"),
}


def _grid(model: dict):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return apply_grid_filters(messy_events(spark, sf_dir), {"reading": model}).select("event_id", "reading")

    return run


for _op, (_target, _sql) in _TEXT_OPS.items():
    REGISTRY.add(
        f"grid_text_{_op}",
        _grid({"filterType": "text", "type": _op, "filter": _target}),
        f"SELECT event_id, reading FROM (SELECT *, coalesce(reading, '') AS cell FROM ({MESSY_EVENTS_SQL})) WHERE {_sql}",
    )

for _op, (_operands, _sql) in _NUMBER_OPS.items():
    REGISTRY.add(
        f"grid_number_{_op}",
        _grid({"filterType": "number", "type": _op, **_operands}),
        f"SELECT event_id, reading FROM (SELECT *, {READ_SQL} AS x FROM ({MESSY_EVENTS_SQL})) WHERE {_sql}",
    )


@query(
    """SELECT p_partkey, p_name, p_size, p_retailprice FROM part
    WHERE contains(lower(p_name), 'ring') AND p_size BETWEEN 10 AND 40 AND p_retailprice >= 905"""
)
def grid_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = {
        "p_name": {"filterType": "text", "type": "contains", "filter": " RING "},
        "p_size": {"filterType": "number", "type": "inRange", "filter": 10, "filterTo": 40},
        "p_retailprice": {"filterType": "number", "type": "greaterThanOrEqual", "filter": "9,05"},
        "p_brand": {"filterType": "text", "operator": "OR", "condition1": {}, "condition2": {}},
        "p_type": {"filterType": "date", "type": "equals", "filter": "x"},
        "missing": {"filterType": "text", "type": "equals", "filter": "x"},
    }
    kept = apply_grid_filters(table(spark, sf_dir, "part"), model)
    return kept.select("p_partkey", "p_name", "p_size", "p_retailprice")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
def filter_in_list_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.concat(F.lit(" "), F.col("o_orderstatus")))
    kept = apply_value_and_range_filters(padded, ORDERS, [("o_orderstatus", ["O"])], [], trim=True)
    return kept.select("o_orderkey", F.trim("o_orderstatus").alias("o_orderstatus"))


_FAR = 1234567890123456789


@query(
    f"""SELECT o_orderkey + {_FAR} AS far_key, o_orderstatus FROM orders
    WHERE o_orderkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) OR o_orderkey % 100 = 7"""
)
def filter_in_list_bigint(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    far = orders.select((F.col("o_orderkey") + F.lit(_FAR)).alias("far_key"), "o_orderkey", "o_orderstatus")
    catalog = Catalog(("far_key",), (Field("far_key", "Char", "", "Key", "D"),))
    asked = [str(_FAR + k) for k in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)] + ["99999999999999999999", f"0{_FAR}"]
    kept = apply_value_and_range_filters(far, catalog, [("far_key", asked)], [])
    others = far.where("o_orderkey % 100 = 7 AND o_orderkey NOT IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)")
    return kept.unionAll(others).select("far_key", "o_orderstatus")
