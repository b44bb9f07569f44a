"""Every query with SQL against DuckDB on the smallest tables; the entry and the rest of the queries run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

Q, O = entry.queries(), entry.oracle_sql()
CORE = [n for n in Q if not any(n.startswith(f"p{i}_") for i in (6, 7, 8))]


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.sql("SET timezone='UTC'")
    for t in os.listdir(data):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{data}/{t}'")
    return c


def rows(df):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
            return "NULL"
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, bool):
            return str(v)
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in CORE if n in O])
def test_matches_sql(spark, data, duck, name):
    got, want = Q[name](spark, data).toPandas(), duck.sql(O[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in CORE if n not in O])
def test_runs(spark, data, name):
    df = Q[name](spark, data)
    assert df.columns and df.count() >= 0
    df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
