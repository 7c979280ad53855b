"""Scans, null tokens, ragged rows, snapshots and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulant.columns import ORDINAL
from tabulant.operators.profile import profile
from tabulant.plans.view import View, ViewSpec
from tabulant.sinks.exports import profile_payload, tsv_of_view, write_csv, write_tsv_of_frame
from tabulant.sources.delimited import QUARANTINED, RAW, quarantine_long_rows, read_delimited
from tabulant.sources.snapshot import read_parquet, write_snapshot
from tabulant.storage import new_path
from workload.registry import Registry
from workload.tables import DOCUMENTS, ORDERS, table

REGISTRY = Registry()
query = REGISTRY.query


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
    CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer"""
)
def scan_delimited_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "customer-csv")
    write_csv(table(spark, sf_dir, "customer"), path)
    return read_delimited(spark, path).drop(ORDINAL)


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars
    FROM documents"""
)
def scan_quoted_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "documents-csv")
    write_csv(table(spark, sf_dir, "documents"), path, order=[F.col("doc_id")])
    return read_delimited(spark, path).drop(ORDINAL)


TOKENS_SQL = (
    "CASE WHEN event_type = 'view' AND value < 10 THEN 'NA' WHEN event_type = 'view' AND value < 30 THEN 'n/a' "
    "WHEN event_type = 'view' THEN '-1.#IND' WHEN event_type = 'error' AND value < 10 THEN '<NA>' "
    "WHEN event_type = 'error' AND value < 30 THEN 'Null' WHEN event_type = 'error' THEN 'NULL' "
    "WHEN event_type = 'click' AND value < 30 THEN '' WHEN event_type = 'click' THEN 'none' "
    "WHEN event_type = 'signup' THEN 'None' ELSE props END"
)


@query(
    f"""SELECT CAST(event_id AS VARCHAR) AS event_id,
    CASE WHEN cell NOT IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN',
    '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null') THEN cell END AS cell
    FROM (SELECT event_id, {TOKENS_SQL} AS cell FROM events)"""
)
def scan_null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens-csv")
    write_csv(table(spark, sf_dir, "events").select("event_id", F.expr(TOKENS_SQL).alias("cell")), path)
    return read_delimited(spark, path).drop(ORDINAL)


RAGGED_SQL = (
    "CASE WHEN o_orderstatus = 'O' THEN {key} || ',' || o_orderpriority || ',' || o_orderstatus || ',more' "
    "WHEN o_orderstatus = 'P' THEN {key} || ',' || o_orderpriority "
    "ELSE {key} || ',' || o_orderpriority || ',' || o_orderstatus END"
)


@query(
    f"""SELECT CASE WHEN NOT long THEN key END AS key, CASE WHEN NOT long THEN o_orderpriority END AS priority,
    CASE WHEN o_orderstatus = 'F' THEN 'F' END AS status, CASE WHEN long THEN line END AS raw, long AS quarantined
    FROM (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority, o_orderstatus, o_orderstatus = 'O' AS long,
    {RAGGED_SQL.format(key='CAST(o_orderkey AS VARCHAR)')} AS line FROM orders)"""
)
def scan_ragged_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ragged-csv")
    line = F.expr(RAGGED_SQL.format(key="CAST(o_orderkey AS STRING)")).alias("key,priority,status")
    lines = table(spark, sf_dir, "orders").select(line)
    # A separator that no line holds keeps the writer from quoting.
    lines.write.option("header", True).option("sep", "\x01").csv(path)
    rows = quarantine_long_rows(spark, path)
    return rows.select("key", "priority", "status", F.col(RAW).alias("raw"), F.col(QUARANTINED).alias("quarantined"))


@query("SELECT p_partkey, p_name FROM part")
def scan_parquet_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    snapshot = write_snapshot(part, [F.col("p_partkey")])
    return read_parquet(spark, snapshot.path, ["p_partkey", "p_name"])


@query("SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS position, l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem")
def snapshot_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = table(spark, sf_dir, "lineitem").select(*keys)
    snapshot = write_snapshot(rows, [F.col(k) for k in keys])
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"]
    return snapshot.frame(columns).select(F.col(ORDINAL).alias("position"), *columns)


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, CAST(n_chars AS VARCHAR) AS n_chars, source, text
    FROM documents WHERE lang IN ('en', 'de') AND n_chars BETWEEN 500 AND 40000"""
)
def export_csv_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ViewSpec(
        preview_rows=100,
        dimension_rows=[("lang", ["en", "de"])],
        measure_rows=[("n_chars", ["between 500 and 40000"])],
        alphabetical=True,
    )
    path = new_path(spark, "export-csv")
    View(table(spark, sf_dir, "documents"), DOCUMENTS, spec).export_csv(path)
    return read_delimited(spark, path).drop(ORDINAL)


@query(
    """SELECT CAST(0 AS BIGINT) AS position, 'DOC_ID' || chr(9) || 'LANG' || chr(9) || 'TEXT' AS line UNION ALL
    SELECT * FROM (SELECT row_number() OVER (ORDER BY doc_id) AS position,
    doc_id || chr(9) || lang || chr(9) || replace(replace(replace(text, chr(9), ' '), chr(13), ' '), chr(10), ' ') AS line
    FROM documents ORDER BY doc_id LIMIT 100000)"""
)
def export_tsv_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return tsv_of_view(documents, ["doc_id", "lang", "text"], [F.col("doc_id")])


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS "CONV_ID", CAST(turn AS VARCHAR) AS "TURN", role AS "ROLE", text AS "TEXT"
    FROM conversations"""
)
def export_tsv_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "export-tsv")
    conversations = table(spark, sf_dir, "conversations")
    write_tsv_of_frame(conversations, path, order=[F.col("conv_id"), F.col("turn")])
    return read_delimited(spark, path, "\t").drop(ORDINAL)


@query(
    """SELECT 'o_orderstatus' AS field_name, 'Char' AS stat_type, CAST(count(*) AS VARCHAR) AS row_count,
    CAST(count(DISTINCT o_orderstatus) AS VARCHAR) AS distinct_count, NULL AS min_value FROM orders UNION ALL
    SELECT 'o_orderdate', 'Date', CAST(count(*) AS VARCHAR), NULL,
    strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') || '+00:00' FROM orders UNION ALL
    SELECT '__FILEKEY__', 'Key', CAST(count(*) AS VARCHAR), NULL, NULL FROM orders"""
)
def profile_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = profile_payload(profile(table(spark, sf_dir, "orders"), ORDERS, 10))
    kept = payload.where(F.col("field_name").isin("o_orderstatus", "o_orderdate", "__FILEKEY__"))
    names = {"stat_type": "$.stat_type", "row_count": "$.metrics.row_count"}
    names |= {"distinct_count": "$.metrics.distinct_count", "min_value": "$.metrics.min"}
    return kept.select("field_name", *(F.get_json_object("payload", at).alias(n) for n, at in names.items()))


# Line ends of all kinds inside cells; the same expression in both engines.
_LINE_ENDS = (
    "CASE doc_id % 3 WHEN 0 THEN replace(text, {lf}, {cr} || {lf}) WHEN 1 THEN replace(text, {lf}, {cr}) ELSE text END"
)


@query(
    f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_LINE_ENDS.format(lf="chr(10)", cr="chr(13)")} AS text, source
    FROM documents"""
)
def scan_quoted_crlf(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "crlf-csv")
    text = F.expr(_LINE_ENDS.format(lf="char(10)", cr="char(13)")).alias("text")
    writer = table(spark, sf_dir, "documents").select("doc_id", text, "source").write
    writer.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return read_delimited(spark, path).drop(ORDINAL)


_STRAY = """CASE p_partkey % 4 WHEN 0 THEN p_size || '" pipe' WHEN 1 THEN 'say "hi" now'
    WHEN 2 THEN ' "z' || p_size || '"' ELSE '"a, b"' END"""


@query(
    f"""SELECT CAST(p_partkey AS VARCHAR) AS part, CASE WHEN cell = '"a, b"' THEN 'a, b' ELSE cell END AS cell, p_brand AS brand
    FROM (SELECT *, {_STRAY} AS cell FROM part)"""
)
def scan_stray_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "stray-csv")
    line = F.expr(f"p_partkey || ',' || {_STRAY} || ',' || p_brand").alias("part,cell,brand")
    # Neither separator nor quote of the writer occurs, so that lines are written as they are.
    table(spark, sf_dir, "part").select(line).write.option("header", True).option("sep", "\x01").option("quote", "").csv(path)
    return read_delimited(spark, path).drop(ORDINAL)


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS start, o_orderstatus AS record_number, o_orderpriority AS "__v",
    CAST(o_custkey AS VARCHAR) AS "ID", CAST(o_orderkey + 1 AS VARCHAR) AS "id.1" FROM orders"""
)
def scan_header_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "names-csv")
    cells = "o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority || ',' || o_custkey || ',' || (o_orderkey + 1)"
    lines = table(spark, sf_dir, "orders").select(F.expr(cells).alias("start,record_number,__v,ID,id"))
    lines.write.option("header", True).option("sep", "\x01").csv(path)
    snapshot = write_snapshot(read_delimited(spark, path), [F.col("start")])
    return snapshot.frame().drop(ORDINAL)


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def scan_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "mixed-csv")
    customer = table(spark, sf_dir, "customer")
    for rest, columns in enumerate((["c_custkey", "c_name", "c_mktsegment"], ["c_mktsegment", "c_custkey", "c_name"])):
        half = customer.where(F.col("c_custkey") % 2 == rest).select(*columns)
        half.write.option("header", True).mode("append").csv(path)
    return read_delimited(spark, path).drop(ORDINAL)


_TWICE = "(SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem)"


@query(
    f"""SELECT CAST(0 AS BIGINT) AS position, 'L_ORDERKEY' || chr(9) || 'L_LINENUMBER' || chr(9) || 'L_PARTKEY' AS line UNION ALL
    SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey),
    l_orderkey || chr(9) || l_linenumber || chr(9) || l_partkey FROM {_TWICE}"""
)
def export_tsv_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    shown = ["l_orderkey", "l_linenumber", "l_partkey"]
    return tsv_of_view(lines.unionAll(lines).select(*shown), shown, [F.col(c) for c in shown])
