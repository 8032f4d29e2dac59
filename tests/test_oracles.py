"""Every query of the library against its SQL, on the smallest tables."""

import pytest

from strandlog.plans.oracles import ORACLES
from strandlog.plans.queries import QUERIES

from .session import DATA, rows_of, spark, sql_rows


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_its_sql(name):
    found = QUERIES[name](spark(), f"{DATA}/sf0.001")
    names, rows = sql_rows(ORACLES[name], f"{DATA}/sf0.001")
    assert sorted(found.columns) == names
    assert rows_of(found) == rows
