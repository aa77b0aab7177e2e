"""Every registered query gives the rows of its SQL, on the smallest test data."""

from __future__ import annotations

import pytest

from checks.compare import compare, connection
from checks.oracles import ORACLES
from checks.queries import REGISTERED

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return connection(DATA)


def test_every_query_has_sql():
    assert set(ORACLES) == set(REGISTERED)


@pytest.mark.parametrize("name", list(REGISTERED))
def test_query(spark, database, name):
    assert compare(spark, database, DATA, name) == ""


def test_flagship(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
