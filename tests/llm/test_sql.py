"""Queries that SQL can express, against DuckDB."""

from collections import Counter

import pytest
from conftest import SF_DIR

from tabulant.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    columns = sorted(result.columns)
    got = [tuple(row[c] for c in columns) for row in result.collect()]
    answer = duck.execute(ORACLE[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in answer.fetchall()]
    left, right = Counter(map(repr, got)), Counter(map(repr, expected))
    assert got and left == right, f"{list(left - right)[:3]} != {list(right - left)[:3]}"
