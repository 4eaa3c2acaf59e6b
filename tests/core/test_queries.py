"""Every query with SQL must give DuckDB's rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from plumbline.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def normal(rows):
    def one(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return x
        return None if isinstance(x, float) and math.isnan(x) else float(x)

    return sorted([tuple(one(x) for x in r) for r in rows], key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    mine, theirs = normal(tuple(r) for r in got.select(*names).collect()), normal(want.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)), (a, b)
