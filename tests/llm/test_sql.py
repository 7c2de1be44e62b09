"""The queries that SQL can express against it, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from pagemill.llm import queries, sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = con.execute(sql.oracle_sql()[name])
    names = [d[0] for d in got.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    want = sorted(map(repr, got.fetchall()))
    assert want and sorted(repr(tuple(r)) for r in df.select(*names).collect()) == want


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, 11)]
