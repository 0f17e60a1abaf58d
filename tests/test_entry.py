"""The driver contract, and every query of this library against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def text(v):
    return "%.9g" % v if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def tables():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


from marlstone.plans.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    result = tables.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    ours = sorted(tuple(text(r[c]) for c in names) for r in df.collect())
    assert ours == sorted(tuple(map(text, r)) for r in result.fetchall())
