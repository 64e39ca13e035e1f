"""Every registered query against its DuckDB SQL, on the smallest tables."""

import pytest

import __spark_entry__ as spark_entry
from tools.check_oracle import compare, connect

QUERIES = {k: q for k, q in spark_entry.queries().items() if k not in spark_entry.LLM_QUERIES}
ORACLE = {k: q for k, q in spark_entry.oracle_sql().items() if k not in spark_entry.LLM_QUERIES}
SLOW = ("X", "E4_closed", "E4_charges", "E4_debited", "J5_import_errors", "J5_imported")


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(SLOW)])
def test_equals_sql(spark, con, sf_dir, name):
    ok, count, _, detail = compare(spark, con, name, sf_dir, QUERIES[name], ORACLE[name])
    assert ok, detail


def test_flagship(spark):
    df = spark_entry.entry(spark)
    assert df.count() > 0 and "total_revenue" in df.columns
