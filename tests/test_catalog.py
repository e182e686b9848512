"""Every query with SQL gives the rows that DuckDB gives; every other one runs."""

import math

import duckdb
import pytest

from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf, duck):
    got = catalog.queries()[name](spark, sf)
    data = got.collect()
    if name in catalog.oracle_sql():
        rel = duck.execute(catalog.oracle_sql()[name])
        names = [c[0] for c in rel.description]
        want = rel.fetchall()
        assert sorted(got.columns) == sorted(names)
        ours, theirs = rows(got.columns, data), rows(names, want)
        assert len(ours) == len(theirs)
        for a, b in zip(ours, theirs):
            assert a == b or all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1.01e-4 * max(1, abs(x))) for x, y in zip(a, b)), (a, b)
    else:
        assert data
