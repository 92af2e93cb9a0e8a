"""Operators on small literal series, and the statistics against closed forms and brute force."""

import datetime
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.functions import causality, numeric, stats
from tidelake.operators import accumulation, alignment
from tidelake.sources import documents
from tidelake.streaming import collapse as streaming


def months(n, start=2021):
    return [datetime.date(start + i // 12, i % 12 + 1, 1) for i in range(n)]


def series(spark, values, name="s", dates=None):
    return spark.createDataFrame([(name, d, v) for d, v in zip(dates or months(len(values)), values, strict=True)], "series_id string, period date, value double")


def column(df):
    return [r.value for r in df.orderBy("period").collect()]


def test_decumulate_fills_nothing(spark):
    assert column(accumulation.decumulate(series(spark, [10.0, 30.0, None, 80.0, 90.0]))) == [10.0, 20.0, None, None, 10.0]
    late = series(spark, [10.0, 50.0, 7.0, 9.0], dates=[datetime.date(2021, 3, 1), datetime.date(2021, 5, 1), datetime.date(2022, 2, 1), datetime.date(2022, 3, 1)])
    assert column(accumulation.decumulate(late)) == [10.0, 40.0, 7.0, 2.0]  # a year's first figure is its own
    assert column(accumulation.decumulate(late, "inception")) == [None, 40.0, -43.0, 2.0]
    assert column(accumulation.decumulate(late, "none")) == [10.0, 50.0, 7.0, 9.0]
    with pytest.raises(accumulation.Ambiguous):
        accumulation.decumulate(late, "ambiguous")


def test_classify_needs_thirteen_points_and_resets(spark):
    ytd = [float(i % 12 + 1) * 10 for i in range(36)]
    mode = lambda v: accumulation.classify(series(spark, v)).first().mode
    assert mode(ytd) == "ytd"
    assert mode(ytd[:12]) == "ambiguous"
    assert mode([float(i) for i in range(36)]) == "ambiguous"
    assert mode([float(i * 7 % 5) + 1 for i in range(36)]) == "none"


def test_collapse_by_rule_and_refusal(spark):
    x = series(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0]).withColumn("aggregation_rule", F.lit("sum"))
    assert column(alignment.collapse(x, "Q")) == [3.0, 15.0]
    assert column(alignment.collapse(x.withColumn("aggregation_rule", F.lit("last")), "Q")) == [2.0, 6.0]
    assert column(alignment.collapse(x.withColumn("value", F.lit(None).cast("double")), "Q")) == [None, None]
    with pytest.raises(alignment.UpsampleRefused):
        alignment.collapse(x, "M", native="Q")


def test_join_keeps_the_spine_and_refuses_taken_keys(spark):
    spine = spark.createDataFrame([(d,) for d in months(4)], "period date")
    x = series(spark, [1.0, 2.0])
    assert alignment.join_series(spine, x, {"a": "s"}).count() == 4
    with pytest.raises(ValueError):
        alignment.join_series(spine, x, {"a": "s", "b": "s"})
    with pytest.raises(ValueError):
        alignment.join_series(spine, x, {"period": "s"})


def test_strict_numbers_raise(spark):
    x = spark.createDataFrame([("1.2x",)], "s string")
    with pytest.raises(Exception, match="Turkish"):
        x.select(numeric.parse_tr(F.col("s"), strict=True)).collect()


def test_anomalies_find_injected_spikes():
    y = [100 + 8 * math.sin(2 * math.pi * i / 12) + 0.15 * i for i in range(72)]
    y[31] += 35
    y[50] -= 30
    found = {a["index"]: a["direction"] for a in stats.anomalies(y, 12)}
    assert found.get(31) == "high" and found.get(50) == "low"
    with pytest.raises(stats.Refused):
        stats.anomalies(y[:20], 12)


def test_pelt_equals_exact_search():
    rng = np.random.default_rng(1)
    y = np.concatenate([rng.normal(0, 1, 9), rng.normal(6, 1, 8), rng.normal(-3, 1, 7)])
    cost = lambda a, b: ((y[a:b] - y[a:b].mean()) ** 2).sum()
    best = (math.inf, None)
    for k in range(4):
        for cut in itertools.combinations(range(3, len(y) - 2), k):
            edges = [0, *cut, len(y)]
            if min(np.diff(edges)) >= 3:
                best = min(best, (sum(cost(a, b) for a, b in zip(edges, edges[1:], strict=False)) + 5 * k, list(cut)))
    assert stats.pelt(y, 5, 3) == best[1]
    assert stats.change_points([0.0] * 60 + [12.0] * 60, *stats.penalties([0.0] * 60 + [12.0] * 60), 6)[0] == (60, "level")


def test_causality_of_seeded_series():
    rng = np.random.RandomState(42)
    x, y = [0.0], [0.0]
    for _ in range(299):
        x.append(0.5 * x[-1] + rng.normal())
        y.append(0.3 * y[-1] + 0.8 * x[-2] + rng.normal())
    got = causality.causality(x, y, "monthly")
    assert got.status == "predictive_relationship_supported" and got.p_x_to_y < 1e-6 and got.method == "granger_stationary_var" and got.direction == "x_to_y"
    assert causality.causality(x[:49], y[:49], "monthly").reason == "insufficient_observations"
    assert causality.causality(x[:80], y[:80], "monthly").reason in ("insufficient_degrees_of_freedom", "stationarity_ambiguous")
    assert causality.causality(x, y, "quarterly").reason == "irregular_frequency"
    assert causality.causality([1.0] * 100, y[:100], "monthly").reason == "constant_series"
    assert causality.causality(x, y, "monthly", [(5, "level")]).reason == "structural_break_confounding"
    split = causality.causality(x, y, "monthly", [(150, "level")])
    assert len(split.regimes) == 2 and split.status != "not_identifiable"
    with pytest.raises(stats.Refused):
        causality.causality(x, y, "monthly", significance=1.5)
    assert abs(stats.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9 and abs(stats.chi2_sf(1.0, 4) - 0.9097959895689501) < 1e-9


def test_tails_and_tables():
    assert abs(causality.f_sf(4.964602743730711, 1, 10) - 0.05) < 1e-9 and abs(causality.f_sf(3.3258345304130126, 5, 10) - 0.05) < 1e-9
    assert abs(causality.f_sf(2.0, 2, 10) - (1 + 2 * 2.0 / 10) ** -5) < 1e-12
    assert abs(stats.unit_root_p(-2.86154) - 0.05) < 1e-3 and abs(stats.unit_root_p(-3.33613, 2) - 0.05) < 1e-3
    assert stats.unit_root_p(5.0) == 1.0 and stats.unit_root_p(-30.0) == 0.0 and stats.kpss_p(0.463) == 0.05 and stats.kpss_p(9.0) == 0.01
    assert causality.holm([0.01, 0.04]) == [0.02, 0.04] and causality.holm([0.04, 0.03]) == [0.06, 0.06]


def test_unit_roots_and_breaks_of_seeded_series():
    rng = np.random.RandomState(42)
    noise, walk = rng.normal(size=300), rng.normal(size=300).cumsum()
    assert stats.integration_order(noise) == "I(0)" and stats.integration_order(walk) == "I(1)"
    t, lag = stats.unit_root(walk, most=0)
    z = np.column_stack([walk[:-1], np.ones(299)])
    beta = np.linalg.solve(z.T @ z, z.T @ np.diff(walk))
    res = np.diff(walk) - z @ beta
    assert lag == 0 and abs(t - beta[0] / math.sqrt(res @ res / 297 * np.linalg.inv(z.T @ z)[0, 0])) < 1e-9
    broken = noise + np.where(np.arange(300) >= 140, 8.0, 0.0)
    t, at = stats.zivot_andrews(broken)
    assert t < stats.BREAK_CRITICAL and abs(at - 139) <= 2


def test_cointegration_and_error_correction_of_seeded_series():
    rng = np.random.RandomState(42)
    x = rng.normal(size=400).cumsum()
    y = np.empty(400)
    y[0] = 0
    for t in range(1, 400):
        y[t] = y[t - 1] + 0.4 * (2 * x[t - 1] - y[t - 1]) + 0.5 * rng.normal()
    assert causality.engle_granger(x, y)[1] < 0.01 and causality.engle_granger(x, rng.normal(size=400).cumsum())[1] > 0.05
    fit = causality.fit_vecm(np.column_stack([x, y]), 2)
    assert fit.stable and fit.ps[0] < 1e-6 and fit.passes
    assert causality.toda_yamamoto(np.column_stack([x, y]), 2, 1)[0] < 1e-6
    assert causality.select_lag(np.column_stack([np.diff(x), np.diff(y)]), 3) in (1, 2, 3)
    same = np.column_stack([x, x])
    assert causality.select_lag(same, 3) is None
    with pytest.raises(stats.Refused):
        causality.fit_var(same, 1)


def test_wald_statistic_is_the_gain_in_fit():
    """For one equation the statistic is the growth of squared residuals without the tested lags, over their variance."""
    rng = np.random.RandomState(7)
    data = rng.normal(size=(200, 2)).cumsum(axis=0) * 0.1 + rng.normal(size=(200, 2))
    z = np.column_stack([np.ones(198), data[1:-1], data[:-2]])
    rss = lambda m: float(((data[2:, 1] - m @ np.linalg.lstsq(m, data[2:, 1], rcond=None)[0]) ** 2).sum())
    want = (rss(z[:, [0, 2, 4]]) - rss(z)) / (rss(z) / (198 - 5))
    assert abs(causality.fit_var(data, 2).statistics[0] - want) < 1e-8


def test_html_is_read_without_scripts():
    got = documents.parse_html('<title>A</title><script>x</script><p>b <a href="/c">d</a><a href="/c">e</a><table><tr><td>1<td>2</td></tr></table>', "https://h.org/")
    assert got["title"] == "A" and "x" not in got["text"].split() and got["links"] == ["https://h.org/c"] and got["n_tables"] == 1
    assert documents.parse_html(None, None)["text"] == "" and not got["cut"]
    many = documents.parse_html("".join(f'<a href="/{i}">x</a>' for i in range(documents.MAX_LINKS + 1)), "https://h.org/")
    assert many["cut"] and len(many["links"]) == documents.MAX_LINKS
    assert documents.parse_html("w " * documents.MAX_CHARS, "")["cut"] and documents.parse_html('<a href="http://[x/">y</a>', "https://h.org/")["links"] == []


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(datetime.datetime(2024, 1, d, 5), "a", 1.5) for d in (1, 1, 2, 9, 20)], "ts timestamp, event_type string, value double")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    streaming.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    closed = {(r.day, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {(datetime.date(2024, 1, 1), 2), (datetime.date(2024, 1, 2), 1)} <= closed <= {(r.day, r.n) for r in streaming.daily_totals(events).collect()}
