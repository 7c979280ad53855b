"""Sidecars: one is derived from every part, so the work grows with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulant.functions.display import with_display_headers
from tabulant.operators.catalogs import (
    bundle_from_json,
    bundle_to_json,
    fields_by_role as keep_role,
    recommend_charts,
    search_fields,
    visible_columns,
    with_labels,
)
from tabulant.sinks.exports import sorted_columns
from tabulant.sources.alignment import alignment_warnings
from tabulant.sources.sidecar import explode_catalogs, missing_sidecars, parse_sidecars
from workload.registry import Registry
from workload.tables import ORDERS, table

REGISTRY = Registry()
query = REGISTRY.query


# Texts are written the same way in both engines; {key} is the part key as text.
PATH_SQL = "'/in/part' || {key} || '.csv_Meta'"
COMPACT_SQL = (
    "'K' || {key} || ', ' || p_brand || ',' || CASE WHEN p_type = 'ECONOMY' THEN 'EXTRA|' ELSE '' END || "
    "'A|' || CASE WHEN p_type = 'ECONOMY' THEN 'Char|12' WHEN p_type = 'PROMO' THEN 'Char40' ELSE 'numeric' END || "
    "'|' || p_name || '|d,B|Num||' || p_type || '|m,C|short, D|' || p_type || '|big ' || p_name || ' |D'"
)
TABULAR_SQL = (
    "'FieldDesc|FieldName|FileKey|FieldDType|FieldType|FieldLength' || chr(10) || p_name || '|A||m|num|' || "
    "{size} || chr(10) || chr(10) || p_type || '|B|K' || {key} || ', A|||' || chr(10) || '|C'"
)
KEY_VALUE_SQL = (
    "'FieldDesc|before' || chr(10) || 'FieldName|A' || chr(10) || 'FieldType|' || lower(p_type) || chr(10) || "
    "'FieldLength|' || {size} || chr(10) || 'FileKey|A' || chr(10) || 'no bar here' || chr(10) || 'Other|x' || chr(10) || "
    "'FieldName|' || p_name || chr(10) || 'FieldDType|m' || chr(10) || 'FieldDType|' || "
    "CASE WHEN p_type = 'PROMO' THEN '' ELSE 'M' END || chr(10) || 'FileKey|A,, K' || {key}"
)
STATUS_SQL = (
    "CASE WHEN p_type = 'ECONOMY' THEN ' ' || chr(10) WHEN p_type = 'PROMO' THEN 'a|b|c|d,' || p_name "
    "WHEN p_type = 'STANDARD' THEN 'plain ' || p_name WHEN p_size > 25 THEN 'FieldName|' || p_name "
    "ELSE 'FieldName|FieldType|FieldLength|FieldDesc|FieldDType|FileKey' || chr(10) || '|num|||M|K' END"
)


def _fill(sql: str, text: str) -> str:
    return sql.format(key=f"CAST(p_partkey AS {text})", size=f"CAST(p_size AS {text})")


def sidecars(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    texts = part.select(F.expr(_fill(PATH_SQL, "STRING")).alias("path"), F.expr(_fill(sql, "STRING")).alias("text"))
    return parse_sidecars(texts)


def _fields_with_keys(parsed: DataFrame) -> DataFrame:
    keys = parsed.select("path", "format", F.concat_ws(",", "file_keys").alias("file_keys"), "status", "fields")
    rows = keys.where(F.col("status") == "ok").select(
        "path", "format", "file_keys", F.posexplode("fields").alias("ordinal", "f")
    )
    return rows.select("path", "format", "file_keys", "ordinal", "f.*")


def _rows_sql(form: str, keys: str, rows: list[tuple[str, str, str, str, str]]) -> str:
    head = f"SELECT {_fill(PATH_SQL, 'VARCHAR')} AS path, '{form}' AS format, {_fill(keys, 'VARCHAR')} AS file_keys"
    names = ("field_name", "field_type", "field_length", "field_desc", "field_dtype")
    parts = []
    for i, row in enumerate(rows):
        cells = ", ".join(f"{_fill(v, 'VARCHAR')} AS {n}" for v, n in zip(row, names))
        parts.append(f"{head}, CAST({i} AS INTEGER) AS ordinal, {cells} FROM part")
    return " UNION ALL ".join(parts)


TITLE_TYPE = "upper(p_type[1]) || lower(p_type[2:])"

REGISTRY.oracle["sidecar_compact"] = _rows_sql(
    "compact",
    "'K' || {key} || ',' || p_brand || CASE WHEN p_type = 'ECONOMY' THEN ',EXTRA' ELSE '' END",
    [
        (
            "'A'",
            "CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'Char' ELSE 'Num' END",
            "CASE WHEN p_type = 'ECONOMY' THEN '12' WHEN p_type = 'PROMO' THEN '40' ELSE '' END",
            "p_name",
            "'D'",
        ),
        ("'B'", "'Num'", "''", "p_type", "'M'"),
        ("'D'", TITLE_TYPE, "''", "'big ' || p_name", "'D'"),
    ],
)
REGISTRY.oracle["sidecar_tabular"] = _rows_sql(
    "tabular",
    "'K' || {key} || ',A'",
    [
        ("'A'", "'Num'", "{size}", "p_name", "'M'"),
        ("'B'", "'Char'", "''", "p_type", "'D'"),
        ("'C'", "'Char'", "''", "''", "'D'"),
    ],
)
REGISTRY.oracle["sidecar_keyvalue"] = _rows_sql(
    "keyvalue",
    "'A,K' || {key}",
    [
        ("'A'", TITLE_TYPE, "{size}", "'before'", "'D'"),
        ("p_name", "'Char'", "''", "''", "CASE WHEN p_type = 'PROMO' THEN 'D' ELSE 'M' END"),
    ],
)


@query()
def sidecar_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields_with_keys(sidecars(spark, sf_dir, COMPACT_SQL))


@query()
def sidecar_tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields_with_keys(sidecars(spark, sf_dir, TABULAR_SQL))


@query()
def sidecar_keyvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields_with_keys(sidecars(spark, sf_dir, KEY_VALUE_SQL))


@query(
    f"""SELECT {_fill(PATH_SQL, 'VARCHAR')} AS path,
    CASE p_type WHEN 'ECONOMY' THEN 'empty' WHEN 'PROMO' THEN 'compact' WHEN 'STANDARD' THEN 'keyvalue'
    ELSE CASE WHEN p_size > 25 THEN 'keyvalue' ELSE 'tabular' END END AS format,
    CASE p_type WHEN 'ECONOMY' THEN 'Metadata file is empty.'
    WHEN 'PROMO' THEN 'Compact metadata requires explicit file keys and field descriptors.'
    WHEN 'STANDARD' THEN 'Metadata does not contain any field definitions.'
    ELSE CASE WHEN p_size > 25 THEN 'ok' ELSE 'Metadata contains an empty FieldName.' END END AS status FROM part"""
)
def sidecar_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sidecars(spark, sf_dir, STATUS_SQL).select("path", "format", "status")


@query(
    """SELECT '/in/' || o_orderkey || '.csv' AS path, '/in/' || o_orderkey || '.csv_Meta' AS sidecar_path,
    'Metadata file not found: /in/' || o_orderkey || '.csv_Meta' AS error FROM orders WHERE o_orderstatus = 'P'"""
)
def sidecar_discovery_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.concat(F.lit("/in/"), F.col("o_orderkey").cast("string"), F.lit(".csv"))
    sidecar = F.when(F.col("o_orderstatus") != "P", F.concat(data, F.lit("_Meta")))
    files = table(spark, sf_dir, "orders").select(F.explode(F.array(data, sidecar)).alias("path"))
    return missing_sidecars(files.where(F.col("path").isNotNull()))


@query(
    """WITH declared AS (SELECT DISTINCT l_orderkey AS dataset, 'line_' || l_linenumber AS name FROM lineitem
    WHERE l_returnflag <> 'R'), present AS (SELECT DISTINCT l_orderkey AS dataset, 'line_' || l_linenumber AS name
    FROM lineitem WHERE l_linestatus = 'O'), both_sides AS (
    SELECT dataset, 0 AS side, name, 'Metadata field missing in data: ' || name AS warning FROM declared
    ANTI JOIN present USING (dataset, name) UNION ALL
    SELECT dataset, 1, name, 'Data column missing in metadata: ' || name FROM present
    ANTI JOIN declared USING (dataset, name))
    SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY side, name) AS INTEGER) AS rank, warning
    FROM both_sides"""
)
def schema_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")).alias("name")
    lines = table(spark, sf_dir, "lineitem")
    declared = lines.where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("dataset"), name)
    present = lines.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("dataset"), name)
    return alignment_warnings(declared, present)


@query(
    f"""SELECT {_fill(PATH_SQL, 'VARCHAR')} AS path, 'K' || p_partkey || ',A' AS file_keys, CAST(3 AS INTEGER) AS field_count,
    'A:Num:' || p_size || ':' || p_name || ':M' AS first_field FROM part"""
)
def catalog_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = bundle_from_json(bundle_to_json(sidecars(spark, sf_dir, TABULAR_SQL)))
    first = F.get("fields", 0)
    shown = F.concat_ws(":", *(first.getField(a) for a in ("field_name", "field_type", "field_length", "field_desc", "field_dtype")))
    return back.select(
        "path", F.concat_ws(",", "file_keys").alias("file_keys"), F.size("fields").alias("field_count"), shown.alias("first_field")
    )


@query("SELECT * FROM orders")
def columns_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorted_columns(table(spark, sf_dir, "orders"))


@query("SELECT concat_ws('|', o_custkey, o_orderkey, o_orderpriority, o_orderstatus) AS cells FROM orders")
def columns_sorted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of the columns as data: each row's cells from left to right."""
    turned = sorted_columns(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_orderpriority", "o_custkey"))
    return turned.select(F.concat_ws("|", *turned.columns).alias("cells"))


@query("SELECT o_totalprice, o_orderstatus, o_orderkey FROM orders")
def columns_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = visible_columns(ORDERS, ["o_totalprice", "nothing", "o_orderstatus"])
    return table(spark, sf_dir, "orders").select(*shown)


@query(
    """SELECT o_orderkey AS "O_ORDERKEY", o_custkey AS "O_CUSTKEY", o_orderstatus AS "O_ORDERSTATUS",
    o_totalprice AS "O_TOTALPRICE", o_orderdate AS "O_ORDERDATE", o_orderpriority AS "O_ORDERPRIORITY" FROM orders"""
)
def display_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_display_headers(table(spark, sf_dir, "orders"))


@query(
    f"""SELECT {_fill(PATH_SQL, 'VARCHAR')} AS path, CAST(0 AS INTEGER) AS ordinal, 'A [' || p_name || ']' AS label FROM part
    UNION ALL SELECT {_fill(PATH_SQL, 'VARCHAR')}, 1, 'B [' || p_type || ']' FROM part
    UNION ALL SELECT {_fill(PATH_SQL, 'VARCHAR')}, 2, 'C' FROM part"""
)
def column_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogs = explode_catalogs(sidecars(spark, sf_dir, TABULAR_SQL))
    return with_labels(catalogs).select("path", "ordinal", "label")


@query(
    f"""SELECT {_fill(PATH_SQL, 'VARCHAR')} AS path, CAST(0 AS INTEGER) AS ordinal, 'A' AS field_name FROM part
    UNION ALL SELECT {_fill(PATH_SQL, 'VARCHAR')}, 1, p_name FROM part WHERE p_type = 'PROMO'"""
)
def fields_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogs = explode_catalogs(sidecars(spark, sf_dir, KEY_VALUE_SQL))
    return keep_role(catalogs, "D").select("path", "ordinal", "field_name")


@query(
    f"""SELECT {_fill(PATH_SQL, 'VARCHAR')} AS path, CAST(1 AS INTEGER) AS ordinal, p_name AS field_name FROM part
    WHERE contains(lower(p_name), 'ring')"""
)
def field_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogs = explode_catalogs(sidecars(spark, sf_dir, KEY_VALUE_SQL))
    return search_fields(catalogs, " RING ").select("path", "ordinal", "field_name")


@query(
    f"""SELECT {_fill(PATH_SQL, 'VARCHAR')} AS path, 'A' AS dimension, 'B' AS measure, 'Bar' AS chart FROM part
    UNION ALL SELECT {_fill(PATH_SQL, 'VARCHAR')}, 'B', 'A',
    CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'Pie' ELSE 'Bar' END FROM part"""
)
def chart_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogs = explode_catalogs(sidecars(spark, sf_dir, COMPACT_SQL))
    chosen = [F.struct(F.lit(d).alias("dimension"), F.lit(m).alias("measure")) for d, m in (("A", "B"), ("B", "A"))]
    path = F.expr(_fill(PATH_SQL, "STRING")).alias("path")
    pairs = table(spark, sf_dir, "part").select(path, F.inline(F.array(*chosen)))
    return recommend_charts(pairs, catalogs)
