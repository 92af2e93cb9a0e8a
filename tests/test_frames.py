"""Refusals of the frame operations, and what each leaves as it was."""

import datetime
from dataclasses import replace

import pytest

from tidelake.frames import frame as fr
from tidelake.frames.chart import ChartRefused, select_chart

DAYS = [datetime.date(2020, m, 1) for m in range(1, 7)]


@pytest.fixture(scope="module")
def start(spark):
    rows = [(d, float(i * 10), 100.0 + i if i != 3 else None, -1.0) for i, d in enumerate(DAYS)]
    data = spark.createDataFrame(rows, "period date, loans double, cpi double, odd double")
    columns = (fr.Measure("loans", "Loans", "TRY", 1e3, "stock"), fr.Measure("cpi", "Prices", "endeks", 1.0, "index"), fr.Measure("odd", "Odd", "endeks", 1.0, "index"))
    return fr.Frame("f", data, columns)


@pytest.fixture(scope="module")
def lake(spark):
    catalog = spark.createDataFrame([("m", "stock", "last", "M", "TRY"), ("q", "stock", "last", "Q", "TRY"), ("x", "unknown", "last", "M", "TRY"), ("old", "stock", "last", "M", "TRY"), ("w", "rate", "mean", "W", "%")], "series_id string, measure_type string, aggregation_rule string, native_freq string, unit string")
    obs = [("m", DAYS[1], 5.0), ("q", DAYS[0], 1.0), ("x", DAYS[0], 1.0), ("old", datetime.date(2001, 1, 1), 1.0), ("w", datetime.date(2020, 2, 3), 1.0), ("w", datetime.date(2020, 2, 10), 4.0)]
    return fr.Lake(catalog, spark.createDataFrame(obs, "series_id string, period date, value double"))


def reason(error, *args, **kw):
    with pytest.raises(error) as e:
        fr.execute(*args, **kw)
    return e.value.reason


def test_add_and_revert(start, lake):
    one = fr.execute(start, "add_column", 0, lake, series_id="w", key="rate")
    assert [r["rate"] for r in one.data.orderBy("period").collect()] == [None, 2.5, None, None, None, None]
    assert one.version == 1 and one.columns[-1].how == "collapse_frequency W to M" and one.missing()["rate"] == 5
    said = fr.find(one, "a", "x", ("rate",))
    back = fr.execute(said, "revert_to", 1, target_version=0)
    assert back.version == 2 and back.data.columns == start.data.columns and len(back.findings) == 1
    for series, key, why in (("none", "k", "not_found"), ("x", "k", "measure"), ("q", "k", "frequency"), ("old", "k", "empty"), ("m", "loans", "collision"), ("m", "period", "collision")):
        assert reason(fr.AddRefused, start, "add_column", 0, lake, series_id=series, key=key) == why


def test_deflate(start):
    out = fr.execute(start, "deflate_column", 0, key="loans", deflator="cpi", base=DAYS[1])
    got = [r[-1] for r in out.data.orderBy("period").collect()]
    assert got[3] is None and got[4] == pytest.approx(40 * 101 / 104)
    bad = lambda **kw: reason(fr.DeflateRefused, start, "deflate_column", 0, **({"key": "loans", "deflator": "cpi", "base": DAYS[1]} | kw))
    assert bad(convention="other") == "convention"
    assert bad(key="none") == "not_found"
    assert bad(key="odd") == "target_measure"
    assert bad(deflator="odd") == "deflator_value"
    assert bad(base=datetime.date(1999, 1, 1)) == "base_not_found"
    assert bad(base=DAYS[3]) == "base_missing"
    assert reason(fr.DeflateRefused, out, "deflate_column", 1, key="loans", deflator="cpi", base=DAYS[1]) == "collision"


def test_index(start):
    out = fr.execute(start, "index_column", 0, key="loans", base=DAYS[1])
    assert [r[-1] for r in out.data.orderBy("period").collect()] == pytest.approx([0, 100, 200, 300, 400, 500])
    assert out.columns[-1].unit == "index"
    for key, base, why in (("loans", DAYS[0], "base_zero"), ("cpi", DAYS[3], "base_missing"), ("none", DAYS[0], "not_found")):
        assert reason(fr.IndexRefused, start, "index_column", 0, key=key, base=base) == why


def test_versions(start):
    assert reason(fr.ExecuteRefused, start, "index_column", 4, key="loans", base=DAYS[1]) == "version"
    assert reason(fr.ExecuteRefused, start, "drop_column", 0) == "unsupported"
    assert reason(fr.HistoryRefused, start, "revert_to", 0, target_version=0) == "not_found"
    one = fr.execute(start, "index_column", 0, key="loans", base=DAYS[1])
    other = fr.execute(start, "index_column", 0, key="loans", base=DAYS[2])
    store = fr.FrameStore()
    store.put(start)
    store.put(one)
    for call, why in ((lambda: store.put(other), "conflict"), (lambda: store.put(start), "stale"), (lambda: store.get("f", 7), "not_found"), (lambda: store.current("f", 0), "stale"), (lambda: store.current("g"), "not_found")):
        with pytest.raises(fr.HistoryRefused) as e:
            call()
        assert e.value.reason == why


def test_findings(start):
    one = fr.find(fr.find(start, "a", "x", ("loans",)), "b", "y", ("cpi",), supersedes="a")
    assert [f.finding_id for f in fr.active(one)] == ["b"]
    for args, why in ((("a", "x", ("loans",)), "duplicate"), (("c", "x", ("none",)), "evidence"), (("c", "x", ("loans",), "z"), "not_found"), (("c", "x", ("loans",), "a"), "already_superseded")):
        with pytest.raises(fr.FindingRefused) as e:
            fr.find(one, *args)
        assert e.value.reason == why


def test_chart(start):
    chart = select_chart(start, ["loans", "cpi"])
    assert chart.axes == (("loans", "left"), ("cpi", "right")) and not chart.indexing_recommended
    assert chart == select_chart(start, ["loans", "cpi"])
    far = replace(start, data=start.data.withColumn("loans", start.data["loans"] * 1e6))
    assert select_chart(far, ["loans", "cpi"]).indexing_recommended
    many = replace(start, columns=(*start.columns[:2], replace(start.columns[2], unit="%")))
    for f, kw, why in ((start, {"keys": ["none"]}, "unknown_column"), (start, {"keys": ["cpi", "cpi"]}, "invalid_override"), (many, {}, "too_many_unit_groups"), (replace(start, columns=()), {}, "no_numeric_columns"), (start, {"axes": {"loans": "right"}}, "invalid_override")):
        with pytest.raises(ChartRefused) as e:
            select_chart(f, **kw)
        assert e.value.reason == why


def test_spine(spark):
    for rows in ([], [(DAYS[0],), (DAYS[0],)], [(None,)]):
        with pytest.raises(fr.AddRefused):
            fr.new_frame("f", spark.createDataFrame(rows, "period date"))
