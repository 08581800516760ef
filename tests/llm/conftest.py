from __future__ import annotations

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import DATA, EDGES, make  # noqa: E402


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = path.rsplit("/", 1)[1].removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.fixture(scope="session")
def texts(duck):
    return dict(duck.execute("select doc_id, text from documents order by 1").fetchall())


@pytest.fixture
def edges(spark):
    return make(spark, EDGES)


@pytest.fixture
def empty(spark):
    return make(spark, [])
