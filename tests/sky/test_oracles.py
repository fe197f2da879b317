"""Every query with an SQL twin against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from skyquilt import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def plain(v):
    return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = want.fetchall()
    assert sorted(tuple(plain(v) for v in r) for r in got.select(*columns).collect()) == sorted(tuple(plain(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - {"solve_star_lists", "quads_capped"}))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_capped_quads(spark):
    from collections import Counter

    rows = catalog.QUERIES["quads_capped"](spark, DATA).collect()
    assert rows
    cells, use = Counter((r.level, r.cell) for r in rows), Counter()
    for r in rows:
        assert len({r.a, r.b, r.c, r.d}) == 4 and r.cx <= r.dx and r.cx + r.dx <= 65535 + 1
        use.update((r.level, r.cell, s) for s in (r.a, r.b, r.c, r.d))
        assert len(r.checks) in (0, 2, 4)
    assert max(cells.values()) <= 4 and max(use.values()) <= 2
