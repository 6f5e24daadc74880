"""Every catalogue query against its SQL twin on the smallest tables."""

import pytest

import check_oracle
from __spark_entry__ import entry, oracle_sql, queries
from threadloom.catalogue.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) <= set(queries())
    assert set(QUERIES) - set(oracle_sql()) == set()


def test_entry(spark):
    found = entry(spark)
    assert found.columns == ["conv_key", "message_id", "instruction", "response"]
    assert found.count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    verdict = check_oracle.compare(spark, SF, name)
    assert verdict.startswith(("equal", "rows")), verdict
