"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as spark_entry
import oracle
from tallymill.plans.bindings import QUERIES
from tallymill.plans.oracles import ORACLES as SQL


@pytest.fixture(scope="module")
def con(medium):
    return oracle.connect(medium)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(spark_entry.queries())
    assert set(SQL) <= set(spark_entry.oracle_sql())


@pytest.mark.parametrize("key", list(QUERIES))
def test_same_rows(spark, con, medium, key):
    found = oracle.spark_table(QUERIES[key](spark, medium))
    wanted = oracle.duck_table(con, SQL[key])
    assert found[0] == wanted[0]
    assert len(found[1]) == len(wanted[1]) > 0
    assert found[1] == wanted[1]


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.columns == ["word", "n"]
    assert df.count() > 0
