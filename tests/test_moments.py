"""Statistics from sums against the same from whole vectors, and as table functions."""

import datetime

import numpy as np
import pytest

from tidelake.functions import causality as cz
from tidelake.functions import moments, stats, tables


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(4)
    made = {f"walk{n}": 1e7 + 1e5 * rng.standard_normal(n).cumsum() for n in (12, 30, 81, 240)} | {f"noise{n}": rng.standard_normal(n) for n in (10, 60, 150)} | {"wave": np.sin(np.arange(90) / 3) + 0.1 * rng.standard_normal(90), "flat": np.full(40, 3.0), "two": np.array([1.0, 2.0])}
    pairs = {k: (y, 0.5 * np.roll(y, 1) + rng.standard_normal(len(y))) for k, y in made.items()}
    rows = [(k, datetime.date(2000, 1, 1) + datetime.timedelta(days=i), float(a), float(b)) for k, (y, x) in pairs.items() for i, (a, b) in enumerate(zip(y, x, strict=True))]
    rows += [("walk81", datetime.date(2030, 1, 1), None, 1.0), ("none", datetime.date(2030, 1, 1), None, None)]
    return pairs, spark.createDataFrame(rows, "series_id string, period date, value double, x double").repartition(5)


def answer(f, *args):
    try:
        return f(*args)
    except (stats.Refused, ValueError, ZeroDivisionError, np.linalg.LinAlgError):
        return None


def test_unit_roots_from_sums(series):
    pairs, table = series
    got = {r.series_id: r for r in moments.unit_roots(table).collect()}
    assert set(got) == {*pairs, "none"}
    for k, (y, _) in pairs.items():
        if np.ptp(y) == 0 or len(y) < 10:
            assert got[k].statistic is None
            continue
        t, lag = stats.unit_root((y - y.mean()) / y.std(ddof=1))  # of large values NumPy loses digits
        assert got[k].lag == lag and got[k].statistic == pytest.approx(t, rel=1e-6) and got[k].p == pytest.approx(stats.unit_root_p(t), abs=1e-9), k


def test_unit_roots_of_large_values_keep_their_digits():
    rng = np.random.default_rng(7)
    for y in (rng.standard_normal(80), rng.standard_normal(80).cumsum(), rng.standard_normal(25)):
        for trend in (1, 2):
            t, lag = stats.unit_root(y, trend=trend)
            for scale, shift in ((1e9, 1e10), (1e-6, 0.0), (1e7, 3e9)):
                got = stats.unit_root(scale * y + shift, trend=trend)
                assert got[1] == lag and got[0] == pytest.approx(t, rel=1e-8)
        assert stats.unit_root(1e9 * y, trend=0) == pytest.approx(stats.unit_root(y, trend=0), rel=1e-8)


def test_table_function_equals_the_sums_on_large_values(spark):
    rng = np.random.default_rng(8)
    made = {f"s{n}": 4e8 + 3e7 * rng.standard_normal(n) for n in (3, 24, 80, 120)}
    table = spark.createDataFrame([(k, datetime.date(2000, 1, 1) + datetime.timedelta(days=i), float(v)) for k, y in made.items() for i, v in enumerate(y)], "series_id string, period date, value double")
    want = {r.series_id: r for r in moments.unit_roots(table).collect()}
    tables.register(spark)
    got = {r.series_id: r for r in spark.sql("SELECT * FROM unit_root(TABLE({t}) PARTITION BY series_id ORDER BY period)", t=table).collect()}
    assert set(got) == set(made) and got["s3"].statistic is None and want["s3"].statistic is None
    assert all(got[k].lag == want[k].lag and got[k].statistic == pytest.approx(want[k].statistic, abs=1e-7) and got[k].p == pytest.approx(want[k].p, abs=1e-9) for k in made if k != "s3")


def test_orders_from_sums(series):
    pairs, table = series
    got = {r.series_id: r.lag for r in moments.lag_orders(table, "x", "value").collect()}
    for k, (y, x) in pairs.items():
        if len(y) > 12 and np.ptp(y) > 0:
            assert got[k] == cz.select_lag(np.column_stack([np.diff(x), np.diff(y)]), 3), k
    assert got["two"] is None and got["none"] is None


def test_stationarity_from_sums(series):
    pairs, table = series
    got = {r.series_id: r for r in moments.stationarity(table).collect()}
    for k, (y, _) in pairs.items():
        s = stats.kpss(y)
        if np.isfinite(s):
            assert got[k].statistic == pytest.approx(s, rel=1e-9) and got[k].p == pytest.approx(stats.kpss_p(s), abs=1e-9), k


def test_table_functions_give_the_same_rows(spark, series):
    pairs, table = series
    tables.register(spark)
    call = lambda f, of="TABLE({t}) PARTITION BY series_id ORDER BY period": spark.sql(f"SELECT * FROM {f}({of})", t=table)
    got = {r.series_id: (r.statistic, r.p) for r in call("kpss").collect()}
    assert set(got) == {*pairs, "none"} and all(got[k] == (s, stats.kpss_p(s)) for k, (y, _) in pairs.items() if np.isfinite(s := stats.kpss(y)))
    got = {r.series_id: (r.statistic, r.lag) for r in call("unit_root").collect()}
    assert all(got[k] == (answer(stats.unit_root, y) or (None, None)) for k, (y, _) in pairs.items() if len(y) > 2)
    broken = spark.createDataFrame([("s", datetime.date(2000, 1, 1) + datetime.timedelta(days=i), float(i > 20) * 9) for i in range(40)], "series_id string, period date, value double")
    assert [(r.series_id, r.position, r.kind) for r in spark.sql("SELECT * FROM change_points(TABLE({t}) PARTITION BY series_id ORDER BY period) WHERE kind = 'level'", t=broken).collect()] == [("s", 21, "level")]
    for bad in ("TABLE(SELECT 1 AS a)", "5", "TABLE(SELECT 'a' AS series_id, 'b' AS value)"):
        with pytest.raises(Exception, match="observations"):
            spark.sql(f"SELECT * FROM kpss({bad})").collect()
