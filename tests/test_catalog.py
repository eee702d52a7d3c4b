"""Every registered query against DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from docpress import catalog
from tests import oracle
from tests.conftest import TESTDATA

SF_DIR = f"{TESTDATA}/sf0.01"
ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF_DIR)
    if name in ROWS_ONLY:
        assert df.count() == 1
        return
    sql = catalog.oracle_sql()[name]
    assert not oracle.type_differences(df, con, sql)
    assert oracle.spark_rows(df) == oracle.sql_rows(con, sql)


def test_only_known_queries_lack_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == ROWS_ONLY


def test_entry_returns_documents(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["_id", "original_size", "compressed_size", "compression_ratio",
                          "data", "metadata"]
    assert df.count() > 0
