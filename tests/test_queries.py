"""Every registered query against its SQL on the smallest tables."""

import pytest

from lorespark.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    status, rows, _, note = compare(spark, duck, small, name, QUERIES[name], ORACLES.get(name))
    assert status in ("ok", "ROWS") or (status == "EMPTY" and rows == 0 and name in ORACLES), note
