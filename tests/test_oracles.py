"""Every registered query against its DuckDB oracle (the driver's check), at sf0.001."""

from __future__ import annotations

import os

import pytest
from oracle_check import compare, duck

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    problems, n, _, _ = compare(spark, con, name, SF, E.queries()[name], E.oracle_sql()[name])
    assert not problems, problems
    assert n > 0


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql())))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["page_id", "link_rank", "url", "text"]
    assert df.count() > 0
