"""Every query of the catalogue against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime

import duckdb
import pytest

from pagemill.plans import catalog, catalog_sql

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return round(value, 3) if isinstance(value, float) else value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("pages", "documents", "events", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog_sql.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = duck.execute(catalog_sql.SQL[name])
    assert sorted(df.columns) == sorted(d[0] for d in got.description)
    want = rows([d[0] for d in got.description], got.fetchall())
    assert rows(df.columns, df.collect()) == want
    assert want


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog_sql.SQL)


def test_url_patterns_run_once(spark, capsys):
    """Values that several expressions need are computed once: columns pasted into one another aren't."""
    plan = catalog.link_graph_degree(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_") + plan.count("RLIKE") <= 15
