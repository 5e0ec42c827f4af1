"""Every registered query with SQL gives the same rows as DuckDB."""

import os

import duckdb
import pytest

from lattica.plans import catalogue


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, db, name):
    got = catalogue.queries()[name](spark, sf_dir).toPandas()
    want = db.execute(catalogue.oracle_sql()[name]).df()
    assert list(sorted(got.columns)) == list(sorted(want.columns))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["mixture_cutoff", "fast_weights", "fit_twostage", "fit_adam"])
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0
