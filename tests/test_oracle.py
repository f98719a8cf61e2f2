"""Every registered query against its SQL on the given tables."""

import subprocess
import sys

import pytest

import __spark_entry__ as contract
import check
from conftest import ROOT
from tidelog.catalog import load

QUERIES, ORACLE = load()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return check.oracle_connection(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, sf_dir, name):
    verdict = check.compare(spark, connection, name, QUERIES[name], ORACLE.get(name), sf_dir)
    assert not verdict.startswith("FAIL"), verdict


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


def test_contract_has_every_query():
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLE) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 12


def test_contract_imports_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
