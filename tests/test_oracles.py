"""Every query with an oracle gives the oracle's rows; every other one runs and gives rows."""

import pytest

from orrery.plans.catalogue import ORACLES, QUERIES
from tests.oracle import SF, connect, rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == rows_of_sql(connect(), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_does_not_need_llm(spark):
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(entry.oracle_sql())
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
