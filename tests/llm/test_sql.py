"""Queries of the training-data operators that SQL can express, against it."""

import pytest

from strandlog.llm.queries import ORACLES, QUERIES

from ..session import DATA, rows_of, spark, sql_rows


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_its_sql(name):
    found = QUERIES[name](spark(), f"{DATA}/sf0.001")
    names, rows = sql_rows(ORACLES[name], f"{DATA}/sf0.001")
    assert sorted(found.columns) == names
    assert rows_of(found) == rows
