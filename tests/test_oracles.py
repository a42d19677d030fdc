"""Every core query against its SQL on the smallest tables."""

import pytest

from larkspur.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(name, spark, duck, same_rows):
    same_rows(QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLES[name]).df())


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
