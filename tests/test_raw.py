"""Trees of raw files, manifests, configurations and gates: what is skipped, what is refused, and that every gate finds what is planted."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, Not, StringContains

from tidelake.operators import gates
from tidelake.sources import bronze, raw, store

FILES = [(f"2021-{m:02}/t{t:02}_x_taraf{p}.json", f'{{"m": {m}, "t": {t}}}') for m in (1, 2, 3) for t in (1, 14) for p in (10001, 10002)]


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('tree')}/raw"
    raw.write(spark.createDataFrame([*FILES, ("2021-13/t01_taraf1.json", "no month"), ("notes.txt", "no payload"), ("2021-02/t1_taraf1.json", "no table")], "path string, content string").repartition(3), root)
    return root


def test_a_tree_is_read_by_its_facts(spark, tree):
    got = {r.path.lstrip("/"): r for r in raw.scan(spark, tree, "monthly").collect()}
    assert {k: r.content for k, r in got.items()} == dict(FILES)
    one = got["2021-02/t14_x_taraf10002.json"]
    assert (one.period, one.table_no, one.part, one.bytes) == (datetime.date(2021, 2, 1), 14, "10002", len(dict(FILES)["2021-02/t14_x_taraf10002.json"]))


def listed(tree, *filters):
    reader = raw.TreeReader({"path": tree, "layout": "monthly"})
    left = list(reader.pushFilters(list(filters)))
    files = [f[0].rpartition("raw/")[2] for p in reader.partitions() for f in p.files]
    return left, reader.listed, files


def test_filters_skip_folders_and_files(tree):
    left, folders, files = listed(tree, EqualTo(("period",), datetime.date(2021, 2, 1)), EqualTo(("table_no",), 14))
    assert left == [] and folders == ["", "/2021-02"] and files == [f"2021-02/t14_x_taraf{p}.json" for p in (10001, 10002)]
    left, folders, files = listed(tree, GreaterThanOrEqual(("period",), datetime.date(2021, 3, 1)), In(("part",), ("10001", "x")))
    assert left == [] and folders == ["", "/2021-03"] and len(files) == 2
    others = [Not(EqualTo(("table_no",), 1)), StringContains(("content",), "m"), EqualTo(("bytes",), 3)]
    left, folders, files = listed(tree, *others)
    assert left == others and len(files) == len(FILES)  # Spark judges these
    assert listed(tree, EqualTo(("table_no",), 99))[2] == []


def test_files_that_are_not_asked_for_are_not_opened(spark, tmp_path):
    root = f"file://{tmp_path}/raw"
    raw.write(spark.createDataFrame(FILES, "path string, content string"), root)
    (tmp_path / "raw/2021-03/t01_x_taraf10001.json").write_bytes(b"\xff\xfe broken")
    x = raw.scan(spark, root, "monthly")
    assert x.where("period < DATE '2021-03-01'").count() == 8 and x.where("table_no = 14").count() == 6
    assert x.where("table_no = 14 AND length(content) > 5 AND part <> '10001'").count() == 3
    with pytest.raises(Exception, match="UTF-8"):
        x.where("table_no = 1").count()


def test_layouts_with_parts(spark, tmp_path):
    for layout, path, want in (("quarterly", "TURKEY/x/2021-3/tablo6.json", (datetime.date(2021, 3, 1), 6, "TURKEY/x")), ("weekly", "TP/20210108/tablo289.html", (datetime.date(2021, 1, 8), 289, "TP")), ("weekly", "20210108/tablo289.html", (datetime.date(2021, 1, 8), 289, ""))):
        root = f"file://{tmp_path}/{len(path)}"
        raw.write(spark.createDataFrame([(path, None)], "path string, content string"), root)
        (r,) = raw.scan(spark, root, layout).collect()
        assert (r.period, r.table_no, r.part) == want and r.content == ""
    with pytest.raises(Exception, match="path and content"):
        spark.range(1).write.format("raw_tree").mode("append").save(f"file://{tmp_path}/no")


def test_the_writer_lists_what_it_wrote(spark, tree):
    lines = bronze.manifest(spark, f"{tree}/{raw.MANIFEST}").collect()
    assert {r.path: r.sha256 for r in lines if r.path in dict(FILES)} == {p: hashlib.sha256(c.encode()).hexdigest() for p, c in FILES}
    assert len(lines) == len(FILES) + 3 and all(r.fetched_at and r.broken is None for r in lines)


def test_provenance_of_torn_lines(spark, tmp_path):
    h = [hashlib.sha256(bytes([i])).hexdigest() for i in range(4)]
    rows = {"1": [{"path": "a", "sha256": h[0], "fetched_at": "2024-01-02T00:00:00+00:00"}, {"path": "b", "sha256": h[1], "fetched_at": "soon"}, {"path": "b", "sha256": h[1]}], "2": [{"path": "c", "fetched_at": "2024-05-01T00:00:00+00:00"}, {"path": "d", "sha256": " "}]}
    for source, some in rows.items():
        (tmp_path / f"source={source}").mkdir()
        text = [json.dumps(x) for x in some] + ["", '{"path": "torn', "no json"]
        (tmp_path / f"source={source}" / "m.jsonl").write_text("\n".join(text))
    got = {r.source: r for r in bronze.provenance(bronze.manifest(spark, f"file://{tmp_path}", "source")).collect()}
    assert (got[1].files, got[1].malformed, got[1].newest) == (3, 2, datetime.datetime(2024, 1, 2)) and (got[2].files, got[2].malformed, got[2].digest, got[2].newest) == (0, 2, None, datetime.datetime(2024, 5, 1))
    again = bronze.provenance(bronze.manifest(spark, f"file://{tmp_path}", "source").orderBy(F.desc("path"))).where("source = 1").first()
    assert again.digest == got[1].digest


GOOD = {"start_date": "2024-01-01", "end_date": "2024-12-31", "complete": False, "scope_note": "some", "known_gaps": ["weekly"], "series": [{"code": "A.B-1", "name": "x", "frequency": "m", "unit": "TL"}, {"code": " C", "name": "y", "frequency": "D"}]}


@pytest.mark.parametrize(
    ("change", "why"),
    [
        ({}, None), ({"complete": True, "known_gaps": []}, None), ({"end_date": "2023-01-01"}, "before"), ({"start_date": None}, "start"), ({"scope_note": " "}, "scope"), ({"known_gaps": [" "]}, "gaps"), ({"series": []}, "no series"),
        ({"series": [{"code": "A", "name": "x", "frequency": "m"}] * 2}, "twice"), ({"series": [{"code": "A B", "name": "x", "frequency": "m"}]}, "codes"), ({"series": [{"code": "A", "name": "", "frequency": "m"}]}, "names"), ({"series": [{"code": "A", "name": "x", "frequency": "y"}]}, "frequencies"),
        ({"series": "none"}, "not a configuration"),
    ],
)
def test_configurations_are_read_or_refused(spark, tmp_path, change, why):
    (tmp_path / "c.json").write_text(json.dumps(GOOD | change, indent=2))
    path = f"file://{tmp_path}/c.json"
    if why:
        with pytest.raises(bronze.BadConfig, match=why):
            bronze.read_config(spark, path)
    else:
        got = bronze.read_config(spark, path).collect()
        assert [(r.code, r.frequency, r.unit) for r in got] == [("A.B-1", "M", "TL"), ("C", "D", "")]


def test_metrics_are_observed_while_observations_are_written(spark, tmp_path):
    rows = [("count", "count.N", datetime.date(1996, 1, 1), 5.0, 5.0), ("rate", "rate.A", datetime.date(2000, 1, 3), float("nan"), None), ("index", "index.price", None, 1.0, 1.0), ("flow", None, datetime.date(2000, 1, 1), None, None), ("count", "count.N", datetime.date(1997, 1, 1), -5.0, 5.0)]
    obs = spark.createDataFrame(rows, "source string, series_id string, period date, value double, value_reported double")
    store.write_observations(obs, f"file://{tmp_path}", gates.watched(obs))
    got = {(r.gate, r.data): (r.checked, r.breaches, r.status) for r in gates.observed(store.read_metrics(spark, f"file://{tmp_path}")).collect()}
    s, p = gates.STORED, gates.PLANTED
    assert got == {("written: keys", s): (5, 2, "fail"), ("written: keys", p): (5, 2, "fail"), ("written: signs", s): (5, 1, "fail"), ("written: signs", p): (5, 2, "fail"), ("written: finite", s): (5, 1, "fail"), ("written: finite", p): (5, 1, "fail")}
    assert store.read_observations(spark, f"file://{tmp_path}").count() == 5


def test_a_gate_that_compared_nothing_fails(spark):
    none = spark.createDataFrame([], "data string, breach boolean")
    assert [(r.checked, r.status) for r in gates.verdicts("g", none).collect()] == [(0, "fail")] * 2
    some = gates.doubled(spark.createDataFrame([(1,), (2,)], "v int"), v=F.lit(-1)).select("data", (F.col("v") < 0).alias("breach"))
    assert {r.data: (r.checked, r.breaches, r.status) for r in gates.verdicts("g", some).collect()} == {gates.STORED: (2, 0, "pass"), gates.PLANTED: (2, 2, "fail")}


def test_publishers_agree_are_stable_or_drift(spark):
    rows = [(k, float(i), float(i) * 1000 * f) for k, fs in {"same": (1.0, 1.01, 0.99), "factor": (1.3, 1.3, 1.3), "drift": (1.0, 1.2, 1.5)}.items() for i, f in enumerate(fs, 1)]
    got = {r.k: (r.n, r.agrees, r.stable) for r in gates.reconcile(spark.createDataFrame(rows, "k string, a double, b double"), ["k"]).collect()}
    assert got == {"same": (3, True, True), "factor": (3, False, True), "drift": (3, False, False)} or got["same"][1] and got["factor"][1:] == (False, True) and got["drift"][1:] == (False, False)


def test_raw_files_that_contradict_themselves(spark):
    day = lambda m: datetime.date(2021, m, 1)
    rows = [(day(m), 3, p, f"2021-{m:02}", "TL", ["a", "b *"]) for m in (1, 2, 3) for p in ("x", "y")]
    rows[1] = (day(1), 3, "y", "2021-02", "TL", ["a", "b *"])  # another period in its caption
    rows[2] = (day(2), 3, "x", None, "bin TL", ["a", "b"])  # no period, another unit, another spelling, so another label
    rows.pop()  # y lacks March
    facts = spark.createDataFrame([(gates.STORED, *r) for r in rows], "data string, period date, table_no int, part string, stated string, unit string, labels array<string>")
    got = {r.gate: (r.checked, r.breaches) for r in gates.suite(gates.payloads(facts), ["caption", "unit", "drift", "spelling", "coverage"]).where(F.col("data") == gates.STORED).collect()}
    assert got == {"caption": (4, 1), "unit": (1, 1), "drift": (3, 2), "spelling": (2, 1), "coverage": (6, 1)}
    known = {r.gate: r.breaches for r in gates.suite(gates.payloads(facts, ["b", "b *"]), ["drift"]).collect()}
    assert known == {"drift": 0}
