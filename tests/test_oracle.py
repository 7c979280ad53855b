"""Every registered query against its SQL in DuckDB, values and all."""

import datetime as dt
import math
import os
from collections import Counter

import duckdb
import pytest

import workload
from tabulant import storage
from tabulant.storage import lifetime

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

QUERIES, ORACLE = workload.queries(), workload.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def kinds(values):
    return {type(v) for v in values if v is not None}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, folder, monkeypatch, name):
    monkeypatch.setattr(storage, "shared_folder", lambda spark: str(folder))
    with lifetime(spark):
        result = QUERIES[name](spark, SF_DIR)
        columns = sorted(result.columns)
        got = [tuple(row[c] for c in columns) for row in result.collect()]
    assert [p for p in folder.rglob("*") if p.is_file()] == [], "stored tables are left"
    assert got, "no rows"
    if name not in ORACLE:
        return
    answer = duck.execute(ORACLE[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = [tuple(row[i] for i in at) for row in answer.fetchall()]
    assert len(got) == len(expected)
    left, right = (Counter(tuple(map(canonical, r)) for r in rows) for rows in (got, expected))
    assert left == right, f"{list((left - right))[:3]} != {list((right - left))[:3]}"
    for column, ours, theirs in zip(columns, zip(*got), zip(*expected)):
        assert kinds(ours) == kinds(theirs), column


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
