"""The store, gates, retrieval, comparison and fetching on small literal tables."""

import datetime
import io
import re
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tidelake.frames import compare
from tidelake.functions import retrieval, stats
from tidelake.functions import text as txt
from tidelake.operators import gates
from tidelake.plans import series as plans
from tidelake.sources import bronze, fetching, lake, store

SF = "/root/testdata/sf0.001"


def day(m, d=1):
    return datetime.date(2021, m, d)


# ---- store


def test_a_point_lookup_opens_one_folder_and_pushes_its_id(spark):
    plan = lake.point(spark, SF, "flow.NATION_19")._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "PartitionFilters" in line][0]
    assert "source" in scan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(series_id,flow.NATION_19)" in scan
    assert "ReadSchema: struct<series_id:string,period:date,value_reported:double>" in scan


def test_a_store_is_replaced_as_a_whole_and_checked(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = [("a", "a.1", day(1), 1.0, 1.0), ("b", "b.1", day(1), None, None), ("b", "b.1", day(2), 2.0, 3.0)]
    obs = spark.createDataFrame(rows, "source string, series_id string, period date, value double, value_reported double")
    kinds = spark.createDataFrame([(s, "flow", "sum", "M", "none", "x", "adet", "t", "L") for s in "ab"], "family string, measure_type string, aggregation_rule string, native_freq string, cumulative_mode string, statement_kind string, unit string, source_ref string, label string")
    store.write_observations(obs, root)
    store.write_catalog(lake.describe(store.read_observations(spark, root), kinds), root)
    store.check(spark, root)
    known = {r.series_id: r for r in store.read_catalog(spark, root).collect()}
    assert len(store.CATALOG_COLUMNS) == 25 and store.read_catalog(spark, root).columns == store.CATALOG_COLUMNS
    assert (known["b.1"].observations, known["b.1"].nonzero_observations, known["b.1"].coverage_end) == (2, 1, day(2))
    store.write_observations(obs.where("source = 'a'"), root)
    assert store.read_observations(spark, root).count() == 1  # nothing of the former store is left
    store.write_observations(obs.union(obs), root)
    with pytest.raises(store.StoreRefused):
        store.check(spark, root)
    store.write_observations(obs.withColumn("series_id", F.concat("series_id", F.lit("x"))), root)
    with pytest.raises(store.StoreRefused):
        store.check(spark, root)


def test_a_folder_is_needed_on_a_cluster(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        store.shared_dir(Session())


def test_silver_types_and_coverage(spark, tmp_path):
    points = spark.createDataFrame([("s", day(1), "1.5", "2024-01-01 00:00:00"), ("s", day(2), None, "2024-01-01 00:00:00")], "series_code string, period date, value string, retrieved_at string")
    stored = store.write_silver(points, f"file://{tmp_path}")
    assert dict(stored.dtypes) == {"series_code": "string", "period": "date", "value": "decimal(38,10)", "retrieved_at": "timestamp"}
    got = {r.series_code: (r.n, r.missing, r.status) for r in store.coverage(stored, spark.createDataFrame([("s",), ("t",)], "series_code string")).collect()}
    assert got == {"s": (2, 1, "ok"), "t": (0, 0, "no_data")}


# ---- gates


def test_partition_gate_finds_a_breach_and_needs_all_parts(spark):
    whole = spark.createDataFrame([(day(1), 1000.0), (day(2), 1000.0), (day(3), 1000.0), (day(4), 10.0)], "period date, whole double")
    parts = [(day(1), "a", 400.0), (day(1), "b", 600.0), (day(2), "a", 400.0), (day(2), "b", 606.0), (day(3), "a", 1000.0), (day(4), "a", 5.0), (day(4), "b", 6.5)]
    x = gates.whole_and_parts(whole, spark.createDataFrame(parts, "period date, part string, v double"), spark.createDataFrame([("a",), ("b",)], "part string"))
    assert {r.period.month: r.parts for r in x.collect()} == {1: 1000.0, 2: 1006.0, 3: None, 4: 11.5}
    got = gates.gate("g", x.where("parts IS NOT NULL"), gates.partition_breach()).first()
    assert (got.checked, got.breaches, got.status) == (3, 1, "fail")  # in the fourth month the gap is small in units
    assert gates.gate("g", x.where("whole < 0"), gates.partition_breach()).first().status == "fail"  # compared nothing


def test_units_nofill_and_bronze_gates_find_what_is_planted(spark):
    table = spark.createDataFrame([(1, 10, 2.5, 0.4, 10000.0), (2, 10, 2.5, 0.4, 9000.0)], "k int, branches int, people_per_branch double, money_per_head double, money double")
    assert gates.gate("u", gates.rebuilt_units(table), gates.units_breach()).first().breaches == 1
    source = spark.createDataFrame([("s", day(1), 1.0), ("s", day(2), None)], "series_id string, period date, value double")
    output = spark.createDataFrame([("s", day(1), 1.0), ("s", day(2), 1.0), ("s", day(3), None)], "series_id string, period date, value double")
    assert tuple(gates.filled(output, source).first()) == (3, 1, 1)
    manifest = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2"), ("c", "3")], "path string, digest string")
    stored = spark.createDataFrame([("a", "1", "TRY"), ("b", "9", "TRY"), ("d", "4", "USD")], "path string, now string, unit string")
    got = gates.bronze(manifest, stored, spark.createDataFrame([("a",), ("e",)], "path string")).first().asDict()
    assert got == {"listed": 4, "absent": 1, "altered": 1, "twice": 1, "unlisted": 1, "uncovered": 1, "units": 2}


# ---- hierarchy, selection, formulas


def test_climbing_stops_at_roots_and_cycles(spark):
    tree = spark.createDataFrame([("a", "b", None), ("b", "c", None), ("c", None, "u"), ("x", "y", None), ("y", "x", "v"), ("l", "gone", None)], "id string, parent string, unit string")
    got = {r.id: (r.root, r.depth, r.unit) for r in plans.climb(tree).collect()}
    assert got == {"a": ("c", 2, "u"), "b": ("c", 1, "u"), "c": ("c", 0, "u"), "x": ("y", 1, "v"), "y": ("x", 1, "v"), "l": ("gone", 1, None)}


def test_caps_count_pinned_rows(spark):
    rows = [(i, "g" if i < 8 else "h", i, i in (0, 9)) for i in range(12)]
    got = plans.capped(spark.createDataFrame(rows, "k int, g string, score int, pinned boolean"), "g", "k", 3, 5).collect()
    assert [r.k for r in got] == [9, 0, 11, 10, 7]


def test_formulas_go_however_deep(spark):
    deep = "x " + "(" * 40 + "1" + "+2)" * 40 + " y (z)"
    rows = spark.createDataFrame([(deep,), ("a (1 (b) 2)",), (None,), ("((5/7)*100) (YÜZDE)",)], "s string")
    assert [r.s for r in rows.select(txt.strip_formulas(F.col("s")).alias("s")).collect()] == ["x y (z)", "a (1 (b) 2)", None, "(YÜZDE)"]


# ---- retrieval


SERIES = "series_id string, source string, raw_label string, measure_type string, sector_scope string, province string, currency_basis string, native_freq string, has_data boolean"


def catalog(spark):
    rows = [
        ("b.1", "m", "Konut Kredisi", "stock", "Sektör", None, "Toplam", "M", True), ("b.2", "m", "Konut Kredisi", "stock", "Kamu", None, "Toplam", "M", True), ("f.1", "q", "Konut Kredileri Toplamı", "stock", None, "IZMIR", None, "Q", True),
        ("e.1", "e", "Mevduat Faizi", "rate", None, None, None, "W", True), ("z.1", "m", "Konut Kredi", "stock", "Sektör", None, "Toplam", "M", False),
    ]
    return spark.createDataFrame(rows, SERIES), spark.createDataFrame([("IZMIR",)], "province string")


def test_questions_resolve_to_series(spark):
    series, places = catalog(spark)
    questions = spark.createDataFrame([(1, "konut kredisi"), (2, "konut kredisi kamu"), (3, "konut kredisi IZMIR"), (4, "mevduat faizi kamu"), (5, "konut kredisi faiz oranı"), (6, "hava"), (7, "")], "id int, s string")
    got = {}
    for r in retrieval.resolve_series(questions, series, places).collect():
        got.setdefault(r.id, []).append((r.series_id, r.narrowed, r.intent_satisfied))
    assert got[1] == [("b.1", True, True)]  # nationwide, of the whole sector; the measure without data comes last
    assert got[2] == [("b.2", True, True)]
    assert got[3] == [("f.1", True, True)]  # the measure that is published by province
    assert got[4] == [("e.1", False, True)]  # a bank group was named that the source doesn't have
    assert {x[2] for x in got[5]} == {False} or got[5][0][0] == "e.1"
    assert 6 not in got and 7 not in got
    with pytest.raises(retrieval.LimitRefused):
        retrieval.ranked(retrieval.scores(questions, retrieval.concepts(series)), 101)


def test_dispatch_gives_tools_what_they_need(spark):
    series, places = catalog(spark)
    asked = [(1, "konut kredisi anomali"), (2, "mevduat faizi rejim"), (3, "konut kredisi ile mevduat faizi arasında nedensellik"), (4, "hava"), (5, "https://a.org"), (6, "zzz granger")]
    got = {r.id: r for r in retrieval.dispatch(spark.createDataFrame(asked, "id int, s string"), series, places).collect()}
    assert (got[1].tool, got[1].series, got[1].period) == ("anomaly", ["b.1"], 12)
    assert (got[2].tool, got[2].series, got[2].shortest) == ("change_detection", ["e.1"], 8)
    assert (got[3].tool, got[3].series, got[3].refusal) == ("causality", ["b.1", "e.1"], "")
    assert got[4].refusal == "no tool" and (got[5].tool, got[5].refusal) == ("url_agent", "") and got[6].refusal == "too few series"


# ---- comparison


def test_nested_rows_differ_by_path(spark):
    schema = "k int, a struct<x: double, y: array<struct<z: string, w: int>>>, m map<string, double>, `dotted.name` int"
    left = spark.createDataFrame([(1, (1.0, [("p", 1), ("q", 2)]), {"u": 1.0}, 1), (2, (None, []), {}, None), (3, None, None, 5)], schema)
    right = spark.createDataFrame([(1, (1.0 + 1e-12, [("p", 1), ("r", 2), ("s", 3)]), {"u": 1.1}, 1), (2, (None, []), {}, None), (4, None, None, 5)], schema)
    got = {(r.k, r.path) for r in compare.differences(left, right, "k").collect()}
    assert got == {(1, "a.y[1].z"), (1, "a.y[2].z"), (1, "a.y[2].w"), (1, "m[u]"), *((k, p) for k in (3, 4) for p in ("a", "m", "dotted.name"))}
    assert compare.differences(left, left, "k").count() == 0


# ---- fetching


def test_addresses_and_redirects(spark):
    cases = {
        "http://8.8.8.8/x": None, "https://example.org:443/a?b#c": None, "HTTPS://Example.ORG.": None, "http://172.15.0.1/": None, "http://172.16.0.1/": "private", "http://localhost:80": "private", "http://a.local/": "private", "http://printer/": "private",
        "http://user@example.org/": "credentials", "http://example.org\\@10.0.0.1/": None, "file:///etc/passwd": "scheme", "javascript:alert(1)": "scheme", None: "scheme", "": "scheme", "http:///x": "host", "http://[fe80::1]/": "literal", "http://0177.0.0.1/": "literal",
        "http://127.1/": "literal", "http://3232235777/": "literal", "http://255.255.255.255/": "private", "http://192.0.2.9/": "private",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", fetching.refusal(F.col("u")).alias("why")).collect()
    assert {r.u: r.why for r in rows} == cases
    ok = "https://example.org/"
    hops = spark.createDataFrame([(1, [ok]), (2, [ok, "http://10.0.0.1/"]), (3, [ok] * 6), (4, [ok] * 7)], "id int, hops array<string>")
    assert [r.why for r in hops.select(fetching.chain_refusal(F.col("hops")).alias("why")).collect()] == [None, "private", None, "redirects"]


def test_workbooks_that_cannot_be_read_say_why(spark):
    def book(parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in parts.items():
                z.writestr(name, body)
        return out.getvalue()

    cases = [(1, None), (2, b""), (3, b"\xd0\xcf\x11\xe0rest"), (4, b"no zip"), (5, book({"a.txt": "x"})), (6, book({"xl/workbook.xml": "<broken", "xl/_rels/workbook.xml.rels": "<R/>"}))]
    got = {r.id: r.refusal for r in fetching.extract_workbooks(spark.createDataFrame([(i, b and bytearray(b)) for i, b in cases], "id long, body binary")).collect()}
    assert got == {1: "empty", 2: "empty", 3: "unsupported", 4: "extraction", 5: "extraction", 6: "extraction"}


def test_work_beyond_the_deadline_is_cancelled(spark):
    def slow():
        return spark.range(8, numPartitions=8).mapInPandas(lambda frames: (time.sleep(30) or f for f in frames), "id long").count()

    began = time.monotonic()
    done, late = fetching.Deadline(spark, 4).run({"quick": spark.range(10).count, "slow": slow, "never": spark.range(3).count})
    assert done == {"quick": 10} and late == ["slow", "never"] and time.monotonic() - began < 25
    with pytest.raises(ZeroDivisionError):
        fetching.Deadline(spark, 60).run({"wrong": lambda: 1 // 0})


def test_an_interrupted_crawl_goes_on(spark):
    wanted = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "page_id int, url string")
    tries = spark.createDataFrame([(1, 0, 500), (1, 1, 200), (2, 0, 503), (2, 1, 500), (3, 0, 1), (3, 1, 1), (3, 2, 1)], "page_id int, t int, status int")
    got = {r.url: (r.tried, r.wait, r.last) for r in bronze.resumed(wanted, tries, 3).collect()}
    assert got == {"b": (2, 4, 500), "d": (0, 1, None)}


def test_a_break_test_that_cannot_be_computed_is_said(monkeypatch):
    import numpy as np

    walk = np.random.RandomState(42).normal(size=300).cumsum()
    assert stats.diagnosis(walk) == ("I(1)", False)
    monkeypatch.setattr(stats, "zivot_andrews", lambda y: (float("inf"), 0))
    assert stats.diagnosis(walk) == ("I(1)", True)
    assert abs(stats.break_p(-4.81067) - 0.05) < 1e-12 and stats.break_p(-9) == 0.01


def test_distinct_parts_of_quarters_and_what_is_shuffled_for_them(spark, tmp_path):
    """Quarters of many eras, parts and days that are missing, copies of lines; a part is shuffled once for 64 quarters."""
    stamp = lambda y, m, d: datetime.datetime(y, m, d, 13)
    days = [stamp(y, m, d) for y in (1, 1899, 1944, 1983, 1984, 1999, 2000, 2015, 2016, 2100) for m, d in ((1, 1), (3, 31), (4, 1), (12, 31))]
    lines = [(part, status, day) for i, day in enumerate(days) for part in (1, 2, 2**40 + i % 3, i) for status in ("F", "O") if (i + part) % 3 or status == "F"]
    lines += [(None, "O", stamp(2015, 1, 5)), (None, "O", stamp(1950, 7, 5)), (7, None, stamp(2015, 1, 5))] + lines[::2]
    spark.createDataFrame(lines, "l_partkey long, l_linestatus string, l_shipdate timestamp_ntz").repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    want = {}
    for part, status, day in lines:
        key = (status and f"count.{status}", datetime.date(day.year, (day.month - 1) // 3 * 3 + 1, 1))
        want.setdefault(key, set()).update([] if part is None else [part])
    made = lake.build_quarterly_count(spark, str(tmp_path))
    assert {(r.series_id, r.period): r.value for r in made.collect()} == {k: float(len(v)) for k, v in want.items()}
    assert dict(made.dtypes) == {"series_id": "string", "period": "date", "value": "double"}
    keys = re.findall(r"hashpartitioning\(([^()]*)", made._jdf.queryExecution().executedPlan().toString())
    assert {tuple(c.strip().partition("#")[0] for c in k.split(",") if "#" in c) for k in keys} == {("status", "era"), ("status", "era", "part")}


def test_lines_without_a_day_make_a_period_that_a_store_refuses(spark, tmp_path):
    spark.createDataFrame([(1, "F", None), (2, "F", None), (2, "F", datetime.datetime(2000, 5, 5))], "l_partkey long, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r.period, r.value) for r in lake.build_quarterly_count(spark, str(tmp_path)).collect()}
    assert got == {(None, 2.0), (datetime.date(2000, 4, 1), 1.0)}


def test_orders_are_summed_after_they_meet_their_customers(spark):
    """Sums by customer and month would be nearly as many as orders."""
    plan = lake.monthly_orders(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "HashAggregate" not in plan.partition("SortMergeJoin")[2]
