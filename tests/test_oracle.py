"""Every registered query against its SQL on the smallest tables."""

import pytest

from workloads import ORACLES, QUERIES
from workloads.compare import difference, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    problem = difference(spark, con, FOLDER, name)
    assert problem is None, problem


def test_entry_runs(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) > 0 and rows[0].customers >= rows[-1].customers
