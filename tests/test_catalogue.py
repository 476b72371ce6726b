"""Every query with SQL gives what the SQL gives in DuckDB."""

import glob
import os

import pytest

from lodestone.plans import catalogue, oracle

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def rows(df):
    def plain(v):
        if v is None or v != v:
            return None
        return round(float(v), 6) if "float" in type(v).__name__ else int(v) if "int" in type(v).__name__ else v

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_as_sql(spark, sf, con, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), con.execute(oracle.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(oracle.SQL) - {"cv_grid"}))
def test_runs(spark, sf, name):
    # the smallest tables have no two users with 29 days in common
    assert catalogue.QUERIES[name](spark, sf).count() > (-1 if name == "girvan_newman" else 0)
