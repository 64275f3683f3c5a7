"""Every catalog query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from wayline.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def close(a, b):
    if a is None or b is None or isinstance(a, float) and math.isnan(a) or isinstance(b, float) and math.isnan(b):
        return (a is None or a != a) and (b is None or b != b)
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return abs(a - b) <= 2e-5 * max(1, abs(b))
    return str(a) == str(b)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_has_the_rows_of_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE_SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(cols)
    order = sorted(cols)
    at = [cols.index(c) for c in order]

    def key(r):
        return tuple((x is None or x != x, x if isinstance(x, (int, str)) else round(float(x), 3) if x is not None and x == x else 0) for x in r)

    a = sorted((tuple(r[c] for c in order) for r in got.collect()), key=key)
    b = sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=key)
    assert len(a) == len(b)
    assert all(close(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", ["around_segments", "around_stacked", "around_segments_all", "around_stacked_all"])
def test_windows_are_made_round_every_enter_event(spark, name):
    entered = catalog.QUERIES["events_edges"](spark, SF).where("edge_code = 1")
    most = entered.groupBy("user_id").count().agg({"count": "max"}).first()[0]
    assert most > 3 and catalog.QUERIES[name](spark, SF).count() == 5 * entered.count()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
