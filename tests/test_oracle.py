"""Every query of the engine against its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from lumenaudit.plans import oracle, queries


def rows(df, columns):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        if isinstance(x, bool) or type(x).__name__ == "bool":
            return int(x)
        if isinstance(x, (int, float)) or hasattr(x, "dtype"):
            return round(float(x), 6)
        return str(x)

    return sorted((tuple(plain(None if str(x) in ("<NA>", "NaT") else x) for x in r) for r in df[columns].itertuples(index=False)), key=lambda r: (*(x for x in map(repr, r) if x[0] == "'"), repr(r)))


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def test_every_sql_has_a_query():
    assert set(oracle.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_same_as_sql(name, spark, sf_dir, duck):
    got = queries.queries()[name](spark, sf_dir).toPandas()
    want = duck.sql(oracle.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = rows(got, columns), rows(want, columns)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracle.oracle_sql())))
def test_runs(name, spark, sf_dir):
    assert queries.queries()[name](spark, sf_dir).count() > 0


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
