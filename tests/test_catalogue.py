"""Every query runs; those with SQL give the rows that DuckDB gives."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from pagewright.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def plain(rows, columns):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)

    return sorted([tuple(one(r[c]) for c in columns) for r in rows])


@pytest.fixture(scope="module")
def duck(small):
    db = duckdb.connect()
    for name in os.listdir(small):
        db.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{small}/{name}'")
    return db


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    made = QUERIES[name](spark, small)
    assert len(set(made.columns)) == len(made.columns)
    rows = made.collect()
    if name in SQL:
        found = duck.sql(SQL[name])
        columns = sorted(found.columns)
        assert sorted(made.columns) == columns
        wanted = [dict(zip(found.columns, r)) for r in found.fetchall()]
        assert plain(rows, columns) == plain(wanted, columns)
