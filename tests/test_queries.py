"""Every registered query against its SQL, and the rest for rows only."""

import pytest

from spanloom.registry import ORACLE_SQL, QUERIES
from tests import oracle


#: Rows that queries without SQL give at least; tests of their operators hold them against plain versions.
LEAST = {"adwin": 0, "greedy_text_clusters": 0, "page_hinkley_resets": 0}


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLE_SQL:
        assert oracle.differences(spark, QUERIES[name], ORACLE_SQL[name], con=con) == []
    else:
        rows = QUERIES[name](spark, oracle.DATA)
        assert rows.columns and rows.count() >= LEAST.get(name, 1), name
