"""Every registered query against its SQL statement."""

import pytest

from tests.oracle import connect, differences
from workloads import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLES[name]) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == [
        "user_id", "view_id", "view_ts", "view_value", "buy_id", "buy_ts", "buy_value"
    ]
