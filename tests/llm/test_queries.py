"""The registered queries against their SQL on the given tables."""

import pytest

import __spark_entry__ as contract
import check
from tidelog.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, sf_dir, name):
    verdict = check.compare(spark, check.oracle_connection(sf_dir), name, catalog.QUERIES[name], catalog.ORACLE[name], sf_dir)
    assert verdict.startswith("ok"), verdict


def test_queries_are_registered():
    assert set(catalog.QUERIES) <= set(contract.queries())
    assert set(catalog.ORACLE) <= set(contract.oracle_sql())
