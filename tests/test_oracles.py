"""Every registered query of the shop equals its DuckDB oracle at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

import compare
from shopflow.plans import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) >= 100


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, con, name):
    got, want = QUERIES[name](spark, str(SF)).toArrow(), con.sql(ORACLES[name]).to_arrow_table()
    assert compare.rows(got) == compare.rows(want)
