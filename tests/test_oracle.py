"""Every registered query against its DuckDB oracle on the smallest scale
(the driver runs the same comparison at sf0.01)."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else f"{round(v, 6):.6f}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6f}"
    if hasattr(v, "isoformat"):
        return str(v).replace("T", " ")
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    r = con.execute(E.oracle_sql()[name])
    want = _rows([d[0] for d in r.description], r.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in r.description)
    assert got == want


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "tenant_id" in df.columns


def test_every_query_has_builder():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 90
