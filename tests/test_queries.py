"""Every registered query against its DuckDB oracle at sf0.001; the smoke entry."""

from __future__ import annotations

import pytest

from helpers import SF0001
from oracle_compare import compare, duck

import __spark_entry__ as E

# The corpus queries have tests of their own beside them.
QUERIES = {k: v for k, v in E.queries().items() if k not in E.CORPUS}
ORACLES = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


def test_every_query_is_registered_with_an_oracle():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, SF0001, name, QUERIES[name], ORACLES.get(name), con)
    assert res["status"] in ("match", "rows-only"), res
    assert res["spark_rows"] > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["first_name", "total_count"]
    assert 0 < df.count() <= 10
