"""What SQL can say of the operators' results, at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

import compare
from shopflow.llm import contracts, queries

SF = Path("/root/testdata/sf0.001")
ALL = {**contracts.ORACLE_SQL, **{n: s for n, s in queries.ORACLE_SQL.items() if n.startswith(("op11_", "op12_"))}}


@pytest.mark.parametrize("name", sorted(ALL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    query = contracts.QUERIES.get(name) or queries.QUERIES[name]
    assert compare.rows(query(spark, str(SF)).toArrow()) == compare.rows(con.sql(ALL[name]).to_arrow_table())
