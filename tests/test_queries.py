"""Every query against its DuckDB text over the smallest tables."""

import datetime
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidelake.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return tuple(map(plain, v))
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (datetime.datetime, pd.Timestamp)):
        return str(v.date()) if v.time() == datetime.time() else str(v)
    if isinstance(v, datetime.date):
        return str(v)
    if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool):
        return float(v)
    return v


def rows(pdf):
    return sorted(str(tuple(map(plain, r))) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_finds_something(spark, name):
    """Their values are held against closed forms and brute force in test_operators.py."""
    assert registry.queries()[name](spark, SF).count() > 0


def test_seconds_of_a_published_service_are_rounded(spark, tmp_path):
    """Moments about midnight in Istanbul with parts of a second, halves among them."""
    midnight, part = datetime.datetime(2024, 1, 21, 21), [-1.5, -0.6, -0.5, -0.4, -1e-6, 0.0, 0.5]
    made = [(i, midnight + datetime.timedelta(seconds=p + odd)) for i, (p, odd) in enumerate((p, odd) for p in part for odd in (0, 1) for _ in range(3))]
    spark.createDataFrame(made, "event_id long, ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got, want = registry.queries()["src_http_series"](spark, str(tmp_path)).toPandas(), con.execute(registry.oracle_sql()["src_http_series"]).df()
    assert rows(got) == rows(want)
