"""Every query of the navigation engine against its SQL; test_routes.py holds those without SQL against plain Python."""

import duckdb
import pytest

from nautigraph import queries as N

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(columns, values):
    """Sorted rows with columns by name; values as Python has them, as pandas turns whole numbers beside nulls into floats."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([v[k] for k in order]) for v in values)


@pytest.mark.parametrize("name", sorted(N.queries()))
def test_query(spark, sf, duck, name):
    got = N.queries()[name](spark, sf)
    found = [tuple(r) for r in got.collect()]
    if sql := N.oracle_sql().get(name):
        want = duck.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(columns)
        assert rows(got.columns, found) == rows(columns, want.fetchall())
    else:
        assert name in ("routes", "itineraries", "route_geojson") and found


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(N.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
