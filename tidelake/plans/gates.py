"""Queries of the gates. Each runs over the data as stored and, in the same pass, over a copy with a planted breach, which it must find."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions import numeric as num
from tidelake.operators import accumulation as acc
from tidelake.operators import alignment as al
from tidelake.operators import gates
from tidelake.operators.gates import PLANTED, STORED
from tidelake.plans import bulletins
from tidelake.plans.registry import query
from tidelake.sources import bronze, lake, raw, store
from tidelake.sources.lake import SQL

BOTH = f", both_(data) AS (VALUES ('{STORED}'), ('{PLANTED}')) "
_OWN = ", own AS (SELECT series_id, period, CASE WHEN row_number() OVER w = 1 THEN value ELSE value - lag(value) OVER w END AS value, value AS value_reported FROM ytd WINDOW w AS (PARTITION BY series_id, year(period) ORDER BY period)) "


def _is(planted: str, otherwise: str, when: str) -> str:
    return f"CASE WHEN data = '{PLANTED}' AND {when} THEN {planted} ELSE {otherwise} END"


def _verdict(gate: str, rows: str) -> str:
    """SQL: the verdict over rows (data, breach)."""
    return f"SELECT '{gate}' AS gate, data, count(r.breach) AS checked, count(*) FILTER (r.breach) AS breaches, CASE WHEN count(r.breach) = 0 OR count(*) FILTER (r.breach) > 0 THEN 'fail' ELSE 'pass' END AS status FROM both_ LEFT JOIN {rows} r USING (data) GROUP BY data"


# ---- I1: a year's own figures add up to December as published

_I1 = (
    ", i1x AS (SELECT data, series_id, year(period) AS year, month(period) AS m, " + _is("value * 1.5", "value", "month(period) = 6 AND year(period) = 1996") + " AS value, value_reported FROM own, both_), "
    "i1y AS (SELECT data, series_id, year, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, max(CASE WHEN m = 12 THEN value_reported END) AS december, count(value) AS n FROM i1x GROUP BY ALL), "
    "i1 AS (SELECT data, abs(total - december) > 0.005 * abs(december) AS breach FROM i1y WHERE december IS NOT NULL AND abs(december) > 1 AND n = 12) "
)


def closure_rows(spark, sf) -> DataFrame:
    own = acc.decumulate(lake.ytd(spark, sf))
    own = gates.doubled(own, value=F.when((F.month("period") == 6) & (F.year("period") == 1996), F.col("value") * 1.5).otherwise(F.col("value")))
    return acc.closure(own, keys=("data",)).select("data", (~F.col("closes")).alias("breach"))


@query(SQL + _OWN + BOTH + _I1 + _verdict("closure", "i1"))
def dq_i1_closure(spark, sf):
    return gates.verdicts("closure", closure_rows(spark, sf))


# ---- I2: counts are never negative

_I2 = ", i2 AS (SELECT data, " + _is("-value", "value", "period = DATE '1996-01-01'") + " < 0 AS breach FROM parts, both_) "


@query(SQL + BOTH + _I2 + _verdict("sign", "i2"))
def dq_i2_sign(spark, sf):
    x = gates.doubled(lake.quarterly_count(spark, sf), value=F.when(F.col("period") == F.lit("1996-01-01").cast("date"), -F.col("value")).otherwise(F.col("value")))
    return gates.verdicts("sign", x.select("data", (F.col("value") < 0).alias("breach")))


# ---- I3a: a series that accumulates starts anew in most Januaries

_I3A = (
    ", i3x AS (SELECT data, series_id, year(period) AS y, max(CASE WHEN month(period) = 1 THEN " + _is("value * 1000", "value", "TRUE") + " END) AS jan, max(CASE WHEN month(period) = 12 THEN value END) AS dec FROM ytd, both_ GROUP BY ALL), "
    "i3y AS (SELECT a.data, a.series_id, a.jan <= 0.5 * b.dec AS reset FROM i3x a JOIN i3x b ON a.data = b.data AND a.series_id = b.series_id AND b.y = a.y - 1 WHERE a.jan IS NOT NULL AND b.dec > 0), "
    "i3a AS (SELECT data, count(*) FILTER (reset) < 0.6 * count(*) AS breach FROM i3y GROUP BY data, series_id) "
)


def reset_rows(spark, sf) -> DataFrame:
    x = gates.doubled(lake.ytd(spark, sf), value=F.when(F.month("period") == 1, F.col("value") * 1000).otherwise(F.col("value")))
    at = lambda m: F.max(F.when(F.month("period") == m, F.col("value")))
    year = x.groupBy("data", "series_id", F.year("period").alias("y")).agg(at(1).alias("jan"), at(12).alias("dec"))
    own = Window.partitionBy("data", "series_id").orderBy("y")
    before = F.when(F.lag("y").over(own) == F.col("y") - 1, F.lag("dec").over(own))
    year = year.withColumn("reset", F.when(F.col("jan").isNotNull() & (before > 0), F.col("jan") <= acc.RESET_DROP * before))
    return year.where("reset IS NOT NULL").groupBy("data", "series_id").agg((F.count_if("reset") < acc.MIN_RESET_RATIO * F.count("*")).alias("breach")).select("data", "breach")


@query(SQL + BOTH + _I3A + _verdict("reset", "i3a"))
def dq_i3a_reset(spark, sf):
    return gates.verdicts("reset", reset_rows(spark, sf))


# ---- I3b: what a series' pattern says differs from what accounting says no more often than is known

_I3B = (
    ", i3m AS (SELECT data, family, " + _is("'ytd'", "cumulative_mode", "family = 'stock'") + " AS mode, statement_kind FROM catalog, both_), "
    "i3t AS (SELECT data, count(*) AS n, count(*) FILTER ((mode = 'ytd') <> (statement_kind = 'income_statement') AND family <> 'flow') AS d FROM i3m GROUP BY 1), "
    f"i3b AS (SELECT data, n, d, d > floor({gates.DISAGREE_SHARE!r} * n) AS breach FROM i3t) "
)


def disagree_rows(spark, sf) -> DataFrame:
    """One row for each copy of the catalog: how many series, how many whose two verdicts differ. Families that publish own figures of an income statement (flow) are known to."""
    x = gates.doubled(lake.catalog(spark, sf), cumulative_mode=F.when(F.col("family") == "stock", "ytd").otherwise(F.col("cumulative_mode")))
    differ = ((F.col("cumulative_mode") == "ytd") != (F.col("statement_kind") == "income_statement")) & (F.col("family") != "flow")
    n = x.groupBy("data").agg(F.count("*").alias("checked"), F.count_if(differ).alias("disagree"))
    return n.withColumn("breach", F.col("disagree") > F.floor(gates.DISAGREE_SHARE * F.col("checked")))


@query(SQL + BOTH + _I3B + "SELECT data, n AS checked, d AS disagree, CASE WHEN breach THEN 'fail' ELSE 'pass' END AS status FROM i3b")
def dq_i3b_disagree(spark, sf):
    """Verdicts of the pattern against those of accounting: a greater share of the catalog than the baseline fails."""
    return disagree_rows(spark, sf).select("data", "checked", "disagree", F.when(F.col("breach"), "fail").otherwise("pass").alias("status"))


# ---- I4: a total can be rebuilt from the columns beside it

_I4 = (
    ", i4n AS (SELECT c_nationkey AS k, count(*) AS people, sum(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE AS money FROM customer GROUP BY 1), i4s AS (SELECT s_nationkey AS k, count(*) AS branches FROM supplier GROUP BY 1), "
    "i4x AS (SELECT k, branches, round(people::DOUBLE / branches, 3) AS ppb, round(money / people / 1000, 5) AS mph, money FROM i4n JOIN i4s USING (k)), "
    "i4 AS (SELECT data, abs(branches * ppb * " + _is("mph * 1000", "mph", "k % 10 = 3") + " * 1000 - money) > 0.005 * abs(money) AS breach FROM i4x, both_) "
)


def units_rows(spark, sf) -> DataFrame:
    head = F.col("money_per_head")
    x = gates.doubled(bulletins.published(spark, sf), money_per_head=F.when(F.col("k") % 10 == 3, head * 1000).otherwise(head))
    return gates.rebuilt_units(x).select("data", gates.units_breach().alias("breach"))


@query("WITH zero AS (SELECT 0)" + BOTH + _I4 + _verdict("units", "i4"))
def dq_i4_units(spark, sf):
    """Planted: some provinces are given in another unit."""
    return gates.verdicts("units", units_rows(spark, sf))


# ---- I5: two publishers agree at a power of ten, or differ by a stable factor

_I5 = (
    ", i5a AS (SELECT data, series_id, value AS a, value / 1000 * CASE WHEN k % 3 = 1 THEN 1.37::DOUBLE WHEN k % 3 = 2 AND data = '" + PLANTED + "' THEN 1 + (year(period) * 12 + month(period) - 23904) * 0.01::DOUBLE ELSE 1 + (month(period) % 3 - 1) * 0.005::DOUBLE END AS b "
    "FROM (SELECT *, regexp_extract(series_id, '([0-9]+)$', 1)::INT AS k FROM flow WHERE value <> 0), both_), i5r AS (SELECT data, series_id, b / a AS r FROM i5a), "
    "i5m AS (SELECT data, series_id, pow(10.0, round(log10(median(r)))) AS scale FROM i5r WHERE r > 0 GROUP BY ALL), "
    "i5s AS (SELECT data, series_id, count(*) AS n, max(abs(r / scale - 1)) <= 0.02 AS agrees, coalesce(stddev_samp(r / scale) <= 0.01, FALSE) AS stable FROM i5r JOIN i5m USING (data, series_id) GROUP BY ALL), "
    "i5 AS (SELECT data, NOT (agrees OR stable) AS breach FROM i5s) "
)


def reconciled(spark, sf) -> DataFrame:
    """A second publisher of the flows gives them in thousands: a third of the series rounded, a third at a constant factor; in the planted copy the last third drifts away."""
    k, months = F.regexp_extract("series_id", "([0-9]+)$", 1).cast("int"), F.year("period") * 12 + F.month("period") - 23904
    near = 1 + (F.month("period") % 3 - 1) * F.lit(0.005)
    x = lake.flow(spark, sf).where("value <> 0").withColumn("other", F.when(k % 3 == 1, F.lit(1.37)).otherwise(near))
    x = gates.doubled(x, other=F.when(k % 3 == 2, 1 + months * F.lit(0.01)).otherwise(F.col("other")))
    return gates.reconcile(x.select("data", "series_id", F.col("value").alias("a"), (F.col("value") / 1000 * F.col("other")).alias("b")), ["data", "series_id"])


@query(SQL + BOTH + _I5 + "SELECT data, series_id, n, agrees, stable FROM i5s")
def dq_i5_reconcile(spark, sf):
    """Two publishers agree within 2 in 100 at a power of ten, or differ by a stable factor, or neither."""
    return reconciled(spark, sf)


def publisher_rows(spark, sf) -> DataFrame:
    return reconciled(spark, sf).select("data", (~(F.col("agrees") | F.col("stable"))).alias("breach"))


# ---- I6: parts add up to the whole

_I6 = (
    ", i6w AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS whole FROM orders GROUP BY 1), "
    "i6c AS (SELECT period, nation, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM facts GROUP BY ALL), "
    "i6p AS (SELECT data, period, nation, " + _is("v * 2", "v", "nation = 'NATION_3' AND month(period) = 5") + f" AS v FROM i6c, both_ WHERE NOT (data = '{PLANTED}' AND nation = 'NATION_4' AND month(period) = 7)), "
    "i6s AS (SELECT data, period, count(*) AS k, CAST(SUM(v) AS DOUBLE) AS parts FROM i6p GROUP BY ALL), "
    "i6 AS (SELECT data, abs(whole - parts) > 2.0 AND abs(whole - parts) > 0.005 * abs(whole) AS breach FROM i6w JOIN i6s USING (period) WHERE k = (SELECT count(*) FROM nation)) "
)


def partition_rows(spark, sf) -> DataFrame:
    """Each month's orders as stored against the sum of the nations'. Planted: one nation's May is doubled, another's July is missing."""
    whole = lake.table(spark, sf, "orders").groupBy(lake.month("o_orderdate").alias("period")).agg(lake.money("o_totalprice").alias("whole"))
    part = lake.order_facts(spark, sf).groupBy("period", F.col("nation").alias("part")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    month = F.month("period")
    part = gates.doubled(part, v=F.when((F.col("part") == "NATION_3") & (month == 5), F.col("v") * 2).when(~((F.col("part") == "NATION_4") & (month == 7)), F.col("v")))
    x = gates.whole_and_parts(whole, part, lake.table(spark, sf, "nation"), ["data"])
    return x.where("parts IS NOT NULL").select("data", gates.partition_breach().alias("breach"))


@query(SQL + BOTH + _I6 + _verdict("partition", "i6"))
def dq_i6_partition(spark, sf):
    return gates.verdicts("partition", partition_rows(spark, sf))


# ---- I7: what is missing stays missing

_I7 = (
    ", i7j AS (SELECT 'ytd.' || n_name AS series_id, period FROM nation, (SELECT DISTINCT period FROM ytd)), i7s AS (SELECT * FROM ytd WHERE month(period) <> 6 AND NOT (series_id = 'ytd.NATION_2' AND year(period) = 1996)), "
    "i7o AS (SELECT j.series_id, j.period, s.value, last_value(s.value IGNORE NULLS) OVER (PARTITION BY j.series_id ORDER BY j.period) AS carried FROM i7j j LEFT JOIN i7s s USING (series_id, period)), "
    f"i7 AS (SELECT data, value IS NULL AND CASE WHEN data = '{PLANTED}' THEN carried ELSE value END IS NOT NULL AS breach, value IS NULL AS gap FROM i7o, both_) "
)


def fill_rows(spark, sf) -> DataFrame:
    """Cells of a spine against the source that was joined to it, which has gaps. Planted: figures are carried forward."""
    y = lake.ytd(spark, sf)
    source = y.where("month(period) <> 6 AND NOT (series_id = 'ytd.NATION_2' AND year(period) = 1996)")
    spine = lake.table(spark, sf, "nation").select(F.concat(F.lit("ytd."), "n_name").alias("series_id")).crossJoin(F.broadcast(y.select("period").distinct()))  # months are a fixed calendar
    out = al.spine_join(spine, source, "value", ["series_id", "period"])
    carried = F.last("value", True).over(Window.partitionBy("series_id").orderBy("period"))
    x = out.select("series_id", "period", "value", carried.alias("carried")).join(source.select("series_id", "period", F.col("value").alias("have")), ["series_id", "period"], "left")
    return gates.doubled(x, value=F.col("carried")).select("data", (F.col("have").isNull() & F.col("value").isNotNull()).alias("breach"), F.col("have").isNull().alias("gap"))


@query(SQL + BOTH + _I7 + "SELECT data, count(*) AS checked, count(*) FILTER (gap) AS missing, count(*) FILTER (breach) AS filled FROM i7 GROUP BY 1")
def dq_i7_nofill(spark, sf):
    return fill_rows(spark, sf).groupBy("data").agg(F.count("*").alias("checked"), F.count_if("gap").alias("missing"), F.count_if("breach").alias("filled"))


# ---- I8: every configured source is stamped

_I8 = (
    ", i8f AS (SELECT event_type AS source, count(DISTINCT CAST(ts AS DATE)) AS files FROM events GROUP BY 1), i8c AS (SELECT source FROM i8f UNION ALL SELECT 'never_fetched'), "
    "i8x AS (SELECT data, source, CASE WHEN data = '" + PLANTED + "' AND source = 'click' THEN 0 ELSE coalesce(files, 0) END AS files FROM i8c LEFT JOIN i8f USING (source), both_ WHERE source <> 'never_fetched' OR data = '" + PLANTED + "'), "
    "i8 AS (SELECT data, files = 0 AS breach FROM i8x) "
)


def stamped(spark, sf) -> DataFrame:
    """Sources of the configuration against what the manifest of their files says. Planted: a source that was never fetched, and one whose lines have no digests."""
    sources = bulletins.config(spark, sf).select(F.col("code").alias("source"), F.lit(False).alias("extra"))
    sources = gates.doubled(sources.union(sources.sparkSession.createDataFrame([("never_fetched", True)], "source string, extra boolean"))).where(f"NOT extra OR data = '{PLANTED}'")
    seen = bronze.provenance(bronze.manifest(spark, f"{bulletins.weekly_tree(spark, sf)}/{raw.MANIFEST}").withColumn("source", F.split_part("path", F.lit("/"), F.lit(1))))
    x = sources.join(seen, "source", "left")
    files = F.when((F.col("data") == PLANTED) & (F.col("source") == "click"), 0).otherwise(F.coalesce("files", F.lit(0)))
    return x.select("data", "source", files.cast("long").alias("files"), "newest").withColumn("stamped", (F.col("files") > 0) & F.col("newest").isNotNull())


@query("WITH zero AS (SELECT 0)" + BOTH + _I8 + "SELECT data, source, files, files > 0 AS stamped FROM i8x")
def dq_i8_fresh(spark, sf):
    return stamped(spark, sf).select("data", "source", "files", "stamped")


def fresh_rows(spark, sf) -> DataFrame:
    return stamped(spark, sf).select("data", (~F.col("stamped")).alias("breach"))


# ---- what raw files say of themselves


_PAYLOADS = ("caption", "unit", "drift", "spelling", "coverage")
_STATED = _is("'1900-01'", "strftime(period, '%Y-%m')", "month(period) = 7")
_UNIT = _is("'bin TL'", "'milyon TL'", "year(period) = 1995")
_SPELT = _is("list_transform(labels, lambda x: x || ' (**)')", "labels", "month(period) = 3")


@query(
    bulletins.SEGMENT_SQL + BOTH + ", pf AS (SELECT period, (10001 + rk)::INT AS part, list_sort(list_append(list(segment || ' *'), 'no numbers')) AS labels FROM seg GROUP BY ALL), "
    f"pd AS (SELECT data, period, part, {_STATED} AS stated, {_UNIT} AS unit, list_sort({_SPELT}) AS labels FROM pf, both_ WHERE NOT (data = '{PLANTED}' AND month(period) = 11 AND part = 10002)), "
    "caption AS (SELECT data, stated <> strftime(period, '%Y-%m') AS breach FROM pd), unit AS (SELECT data, count(DISTINCT unit) > 1 AS breach FROM pd GROUP BY 1), "
    "drift AS (SELECT data, labels <> before AS breach FROM (SELECT *, lag(labels) OVER (PARTITION BY data, part ORDER BY period) AS before FROM pd) WHERE before IS NOT NULL), "
    r"spelling AS (SELECT data, count(*) > 1 AS breach FROM (SELECT DISTINCT data, label, regexp_replace(label, '(?:\s*\(\*+\)|\s*\*+)+$', '') AS k FROM (SELECT data, unnest(labels) AS label FROM pd)) GROUP BY data, k), "
    "coverage AS (SELECT a.data, d.part IS NULL AS breach FROM (SELECT DISTINCT data, part FROM pd) a JOIN (SELECT DISTINCT data, period FROM pd) b USING (data) LEFT JOIN pd d ON d.data = a.data AND d.part = a.part AND d.period = b.period) "
    + " UNION ALL ".join(_verdict(k, k) for k in _PAYLOADS)
)
def dq_bronze_payloads(spark, sf):
    """Captions, units, drift of labels, their spellings, and coverage of the monthly files; each is planted in the copy."""
    facts = bronze.payload_facts(raw.scan(spark, bulletins.monthly_tree(spark, sf), "monthly"))
    month = F.month("period")
    facts = gates.doubled(
        facts, stated=F.when(month == 7, "1900-01").otherwise(F.col("stated")), unit=F.when(F.year("period") == 1995, "bin TL").otherwise(F.col("unit")),
        labels=F.when(month == 3, F.array_sort(F.transform("labels", lambda x: F.concat(x, F.lit(" (**)"))))).otherwise(F.col("labels")),
    ).where(~((F.col("data") == PLANTED) & (month == 11) & (F.col("part") == "10002")))
    return gates.suite(gates.payloads(facts), list(_PAYLOADS))


# ---- all of them after a write

_WRITTEN = ", w AS (SELECT family AS source, series_id, period, value FROM observations WHERE family <> 'ytd' UNION ALL SELECT 'ytd', series_id, period, value FROM own) " + "".join(
    f", {name} AS (SELECT data, CASE WHEN data = '{PLANTED}' THEN {planted} ELSE {plain} END AS breach FROM w, both_) "
    for name, plain, planted in (
        ("wk", "series_id IS NULL OR period IS NULL", "series_id IS NULL OR period IS NULL OR series_id = 'index.price'"),
        ("wn", "source = 'count' AND value < 0", "source = 'count' AND CASE WHEN period = DATE '1996-01-01' THEN -value ELSE value END < 0"),
        ("wf", "value IS NOT NULL AND NOT isfinite(value)", "source = 'rate' OR (value IS NOT NULL AND NOT isfinite(value))"),
    )
)
_ALL = [("written: keys", "wk"), ("written: signs", "wn"), ("written: finite", "wf"), ("closure", "i1"), ("sign", "i2"), ("reset", "i3a"), ("disagree", "i3b"), ("units", "i4"), ("publishers", "i5"), ("partition", "i6"), ("no fill", "i7"), ("fresh", "i8")]


@query(SQL + _OWN + BOTH + _I1 + _I2 + _I3A + _I3B + _I4 + _I5 + _I6 + _I7 + _I8 + _WRITTEN + " UNION ALL ".join(_verdict(*x) for x in _ALL))
def dq_gate(spark, sf):
    """Every gate over the written store. What one pass over the rows can tell was observed while they were written (keys, signs, finite values) and is read from the store's metrics; the others need groups or joins. The store stays as written, whatever the verdict."""
    root = lake.gold(spark, sf)
    observed = gates.observed(store.read_metrics(spark, root))
    sign = gates.doubled(lake.quarterly_count(spark, sf), value=F.when(F.col("period") == F.lit("1996-01-01").cast("date"), -F.col("value")).otherwise(F.col("value"))).select("data", (F.col("value") < 0).alias("breach"))
    rows = {"closure": closure_rows(spark, sf), "sign": sign, "reset": reset_rows(spark, sf), "disagree": disagree_rows(spark, sf), "units": units_rows(spark, sf), "publishers": publisher_rows(spark, sf), "partition": partition_rows(spark, sf), "no fill": fill_rows(spark, sf), "fresh": fresh_rows(spark, sf)}
    every = None
    for name, x in rows.items():
        one = x.select(F.lit(name).alias("gate"), "data", "breach")
        every = one if every is None else every.unionAll(one)
    return observed.unionAll(gates.suite(every, list(rows)))
