"""The registered caption queries against their SQL, and the driver's contract."""

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry
from kinescribe.plans.queries import oracle_sql, queries

SF = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in SF.iterdir():
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    got = queries()[name](spark, str(SF)).toPandas()
    assert len(got) or name == "q19_ngram_loop"
    if name in oracle_sql():
        want = con.sql(oracle_sql()[name]).df()
        rows = lambda df: sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
