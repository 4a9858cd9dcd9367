"""Every query with SQL against DuckDB on the small tables."""

import glob
import os

import duckdb
import pytest

from ledgerline.plans import catalogue
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(df):
    told = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    flat = lambda v: None if v is None else int(v) if isinstance(v, float) and v == int(v) else v
    return sorted(tuple(str(flat(v)) for v in r) for r in told.values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.queries()[name](spark, SMALL).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_admission_equals_a_fold(spark):
    got = catalogue.queries()["append_admission"](spark, SMALL).toPandas().sort_values(["stream_id", "seq"])
    for _, part in got.groupby("stream_id"):
        n = used = 0
        for size, admitted in zip(part["bytes"], part["admitted"], strict=True):
            fits = n < 48 and used + size <= 8000
            assert admitted == fits
            n, used = n + fits, used + size * fits


def test_filters_reach_the_scan(spark):
    plan = spark.read.parquet(f"{SMALL}/events.parquet").where("user_id = 3").select("event_id")._jdf.queryExecution().toString()
    assert "EqualTo(user_id,3)" in plan
