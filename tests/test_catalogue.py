"""Every query of the catalogue against its SQL twin."""

from __future__ import annotations

import pytest
from conftest import SF
from oracle import connect, rows_of_frame, rows_of_sql

from tidemark.plans import catalogue


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_equals_sql(spark, con, name):
    names, rows = rows_of_frame(catalogue.queries()[name](spark, SF))
    want_names, want = rows_of_sql(con, catalogue.oracle_sql()[name])
    assert names == want_names
    assert len(rows) == len(want)
    assert rows == want


def test_every_query_has_sql():
    assert catalogue.queries().keys() == catalogue.oracle_sql().keys()
