"""Queries of the statistics, the documents and the streaming twin."""

from __future__ import annotations

import io
import zipfile
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelake.functions import causality as cz
from tidelake.functions import moments, stats, tables
from tidelake.functions import text as txt
from tidelake.plans.registry import query
from tidelake.sources import documents, fetching, lake
from tidelake.sources.lake import SQL

PERIODS = {"D": 7, "W": 52, "M": 12, "Q": 4}
SEGMENTS = {"D": 14, "W": 8, "M": 6, "Q": 3}


@query()
def fn_anomaly(spark, sf):
    """Robust seasonal outliers of each monthly series; a group is one series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period")
        try:
            found = stats.anomalies([None if pd.isna(v) else v for v in pdf["value"]], PERIODS["M"])
        except stats.Refused:
            found = []
        rows = [(pdf["series_id"].iloc[0], pdf["period"].iloc[a["index"]], a["observed"], a["expected"], a["score"], a["direction"]) for a in found]
        return pd.DataFrame(rows, columns=["series_id", "period", "observed", "expected", "score", "direction"])

    return lake.flow(spark, sf).groupBy("series_id").applyInPandas(run, "series_id string, period date, observed double, expected double, score double, direction string")


@query()
def fn_change_points(spark, sf):
    """Level and trend breaks of each monthly series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period")
        values = pdf["value"].tolist()
        try:
            found = stats.change_points(values, *stats.penalties(values), SEGMENTS["M"])
        except stats.Refused:
            found = []
        return pd.DataFrame([(pdf["series_id"].iloc[0], pdf["period"].iloc[i], k) for i, k in found], columns=["series_id", "period", "kind"])

    return lake.observations(spark, sf).where("family IN ('flow', 'stock')").groupBy("series_id").applyInPandas(run, "series_id string, period date, kind string")


def _pairs(spark, sf):
    """series_id, period, x (the price index), value: each flow beside the index."""
    price = lake.price_index(spark, sf).select("period", F.col("value").alias("x"))
    return lake.flow(spark, sf).join(price, "period")


def _each_pair(spark, sf, schema: str, f):
    """One row for each pair of series by a function of (x, y); what refuses gives nulls. A group is one pair."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = pdf.sort_values("period").dropna(subset=["x", "value"])
        try:
            got = f(whole["x"].to_numpy(float), whole["value"].to_numpy(float))
        except (stats.Refused, np.linalg.LinAlgError, ZeroDivisionError, ValueError):
            got = (None,) * (len(names) - 1)
        return pd.DataFrame([(pdf["series_id"].iloc[0], *got)], columns=names)

    return _pairs(spark, sf).groupBy("series_id").applyInPandas(run, schema)


def _stack(x, y):
    return np.column_stack([np.diff(x), np.diff(y)])


@query()
def fn_causality(spark, sf):
    """Whether the price index helps to predict each flow, or it them."""

    def run(x, y):
        a = cz.causality(x, y, "monthly")
        return a.status, a.reason, a.method, a.lag, a.p_x_to_y, a.p_y_to_x, a.robust

    return _each_pair(spark, sf, "series_id string, status string, reason string, method string, lag int, p_x_to_y double, p_y_to_x double, robust string", run)


@query()
def fn_regimes(spark, sf):
    """The same with a break of level in the middle of the sample."""

    def run(x, y):
        a = cz.causality(x, y, "monthly", [(len(x) // 2, "level")])
        return a.status, a.reason, ",".join(a.regimes)

    return _each_pair(spark, sf, "series_id string, status string, reason string, regimes string", run)


_NUMBERED = SQL + (
    ", p0 AS (SELECT f.series_id, f.period, p.value AS x, f.value AS y FROM flow f JOIN price p USING (period) WHERE f.value IS NOT NULL AND p.value IS NOT NULL), "
    "num AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY period) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n, x, y FROM p0) "
)
#: SQL: from matrices g0 (id, m: lists of rows) the pivots of an elimination in order, and what is left of the last column's squares before each.
_ELIMINATED = (
    ", el(id, k, m, pivots, rest) AS (SELECT id, 1, m, []::DOUBLE[], []::DOUBLE[] FROM g0 UNION ALL SELECT id, k + 1, list_transform(m, lambda r: list_transform(range(1, len(r) + 1), lambda j: r[j] - r[k] * m[k][j] / m[k][k])), "
    "list_append(pivots, m[k][k]), list_append(rest, m[len(m)][len(m)]) FROM el WHERE k <= len(m)), done AS (SELECT id, pivots, rest FROM el WHERE k = len(m) + 1) "
)
_GRAM = "g1 AS (SELECT id, i, j, sum(v[i] * v[j]) AS s FROM (SELECT id, v, unnest(range(1, len(v) + 1)) AS i FROM vec), LATERAL (SELECT unnest(range(1, len(v) + 1)) AS j) GROUP BY ALL), g2 AS (SELECT id, i, list(s ORDER BY j) AS r FROM g1 GROUP BY ALL), g0 AS (SELECT id, list(r ORDER BY i) AS m FROM g2 GROUP BY 1)"
_LOW, _SPLIT, _HIGH, _BELOW, _ABOVE = stats.SURFACES[1]
_POLY = "CASE WHEN t <= {split} THEN {below} ELSE {above} END".format(split=_SPLIT, below=" + ".join(f"{c!r} * pow(t, {i})" for i, c in enumerate(_BELOW)), above=" + ".join(f"{c!r} * pow(t, {i})" for i, c in enumerate(_ABOVE)))
#: SQL: the normal distribution function of z, by its series.
_PHI = "0.5 + sign(z) * list_sum(list_transform(range(0, 120), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) - lgamma(k + 1) - k * ln(2)) / (2 * k + 1))) / sqrt(2 * pi())"
_ADF = (
    _NUMBERED.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", st AS (SELECT series_id, i, n, greatest(0, least(ceil(12 * pow(n / 100, 0.25)), n // 2 - 2))::INT AS most, (y - avg(y) OVER w) / stddev_samp(y) OVER w AS y FROM num WINDOW w AS (PARTITION BY series_id)), "
    "df AS (SELECT *, lag(y) OVER w AS b, y - lag(y) OVER w AS d FROM st WINDOW w AS (PARTITION BY series_id ORDER BY i)), la AS (SELECT *, i - 1 AS t, list_reverse(list(d) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) AS lags FROM df), "
    "vec AS (SELECT series_id AS id, [1.0, b] || lags[1:most] || [d] AS v FROM la WHERE i > 0 AND t >= most), " + _GRAM + _ELIMINATED
    + ", ch AS (SELECT id, arg_min(p, n * ln(rest[p + 3] / n) + 2 * (p + 2)) AS lag FROM (SELECT id, rest, n - 1 - most AS n, unnest(range(0, most + 1)) AS p FROM done JOIN (SELECT DISTINCT series_id AS id, n, most FROM st) USING (id)) GROUP BY 1) "
)
_ADF2 = (
    ", vec2 AS (SELECT series_id AS id, [1.0] || lags[1:lag] || [b, d] AS v FROM la JOIN ch ON ch.id = series_id WHERE i > 0 AND t >= lag), " + _GRAM.replace("g1", "h1").replace("g2", "h2").replace("g0", "h0").replace("FROM vec)", "FROM vec2)")
    + _ELIMINATED.replace("el(", "el2(").replace("FROM g0", "FROM h0").replace("FROM el ", "FROM el2 ").replace("done AS", "done2 AS")
    + ", fi AS (SELECT d.id, lag, n - 1 - lag AS n, pivots[len(pivots) - 1] AS a, rest[len(rest) - 1] - rest[len(rest)] AS bb, rest[len(rest)] AS rss FROM done2 d JOIN ch USING (id) JOIN (SELECT DISTINCT series_id AS id, n FROM st) USING (id)), "
    # b's sign: that of the last column's product with the level, before the level is taken out
    "sg AS (SELECT id, sign(m[len(m) - 1][len(m)]) AS s FROM el2 WHERE k = len(m) - 1), ts AS (SELECT id, lag, s * sqrt(bb / (rss / (n - lag - 2))) AS t FROM fi JOIN sg USING (id)), "
    f"zs AS (SELECT *, {_POLY} AS z FROM ts) SELECT id AS series_id, round(t, 6) AS statistic, CASE WHEN t > {_HIGH} THEN 1.0 WHEN t < {_LOW} OR z < -5 THEN 0.0 WHEN z > 5 THEN 1.0 ELSE round({_PHI}, 6) END AS p, lag::INT AS lag FROM zs"
)


@query(_ADF + _ADF2)
def fn_adf(spark, sf):
    """The unit-root test of each flow, from sums of cross products."""
    return moments.unit_roots(_pairs(spark, sf).dropna(subset=["x", "value"])).select("series_id", F.round("statistic", 6).alias("statistic"), F.round("p", 6).alias("p"), "lag")


#: SQL: level stationarity of each flow.
_INTERP = " ".join(f"WHEN s <= {b!r} THEN {u!r} + (s - {a!r}) / ({b!r} - {a!r}) * ({v!r} - {u!r})" for a, b, u, v in zip(stats.KPSS_POINTS, stats.KPSS_POINTS[1:], stats.KPSS_LEVELS, stats.KPSS_LEVELS[1:], strict=False))


_KPSS = (
    _NUMBERED + ", e AS (SELECT series_id, i, n, y - avg(y) OVER (PARTITION BY series_id) AS e FROM num), q AS (SELECT series_id, n, sum(s * s) AS squares FROM (SELECT series_id, n, sum(e) OVER (PARTITION BY series_id ORDER BY i) AS s FROM e) GROUP BY ALL), "
    "c AS (SELECT a.series_id, a.n, b.i - a.i AS k, sum(a.e * b.e) AS c FROM e a JOIN e b ON a.series_id = b.series_id AND b.i >= a.i GROUP BY ALL), "
    "s AS (SELECT series_id, n, sum(CASE WHEN k = 0 THEN c / n ELSE c / (n / 2) END) AS s0, sum(CASE WHEN k = 0 THEN 0 ELSE k * c / (n / 2) END) AS s1 FROM c WHERE k <= floor(pow(n, 2.0 / 9)) GROUP BY ALL), "
    "w AS (SELECT series_id, n, floor(least(1.1447 * pow(pow(s1 / s0, 2), 1.0 / 3) * pow(n, 1.0 / 3), n - 1)) AS most FROM s), l AS (SELECT series_id, sum(CASE WHEN k = 0 THEN c ELSE 2 * c * (1 - k / (most + 1)) END) / any_value(c.n) AS long FROM c JOIN w USING (series_id) WHERE k <= most GROUP BY 1), "
    f"t AS (SELECT series_id, squares / (n * n) / long AS s FROM l JOIN q USING (series_id)) SELECT series_id, round(s, 6) AS statistic, round(CASE WHEN s <= {stats.KPSS_POINTS[0]!r} THEN {stats.KPSS_LEVELS[0]!r} {_INTERP} ELSE {stats.KPSS_LEVELS[-1]!r} END, 6) AS p FROM t"
)


@query(_KPSS)
def fn_kpss(spark, sf):
    """Level stationarity of each flow, from partial sums and autocovariances."""
    return moments.stationarity(_pairs(spark, sf).dropna(subset=["x", "value"])).select("series_id", F.round("statistic", 6).alias("statistic"), F.round("p", 6).alias("p"))


@query(_KPSS)
def fn_table_kpss(spark, sf):
    """The same as a function of SQL that takes a table in parts by series, in order of periods."""
    tables.register(spark)
    return spark.sql("SELECT series_id, round(statistic, 6) AS statistic, round(p, 6) AS p FROM kpss(TABLE(SELECT series_id, period, value FROM {flows}) PARTITION BY series_id ORDER BY period)", flows=_pairs(spark, sf).dropna(subset=["x", "value"]))


@query(_ADF + _ADF2)
def fn_table_unit_root(spark, sf):
    """The unit-root test as a function of SQL."""
    tables.register(spark)
    return spark.sql("SELECT series_id, round(statistic, 6) AS statistic, round(p, 6) AS p, lag FROM unit_root(TABLE(SELECT series_id, period, value FROM {flows}) PARTITION BY series_id ORDER BY period)", flows=_pairs(spark, sf).dropna(subset=["x", "value"]))


@query()
def fn_zivot_andrews(spark, sf):
    """Null below 80 observations."""

    def run(x, y):
        if len(y) < 80:
            raise stats.Refused("too few values")
        return stats.zivot_andrews(y)

    return _each_pair(spark, sf, "series_id string, statistic double, before int", run)


@query()
def fn_engle_granger(spark, sf):
    return _each_pair(spark, sf, "series_id string, statistic double, p double", cz.engle_granger)


@query(
    _NUMBERED.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", df AS (SELECT series_id, i, x - lag(x) OVER w AS x, y - lag(y) OVER w AS y FROM num WINDOW w AS (PARTITION BY series_id ORDER BY i)), st AS (SELECT series_id, i - 1 AS t, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS x, (y - avg(y) OVER w) / stddev_samp(y) OVER w AS y FROM df WHERE i > 0 WINDOW w AS (PARTITION BY series_id)), "
    "la AS (SELECT *, [lag(x) OVER w, lag(y) OVER w, lag(x, 2) OVER w, lag(y, 2) OVER w, lag(x, 3) OVER w, lag(y, 3) OVER w] AS lags FROM st WINDOW w AS (PARTITION BY series_id ORDER BY t)), "
    "vec AS (SELECT series_id || '|' || p AS id, [1.0] || lags[1:2 * p] || [x, y] AS v FROM la, (VALUES (1), (2), (3)) o(p) WHERE t >= p), " + _GRAM + _ELIMINATED
    + ", sz AS (SELECT split_part(d.id, '|', 1) AS series_id, split_part(d.id, '|', 2)::INT AS p, ln(pivots[len(pivots) - 1] * pivots[len(pivots)] / (n * n)) + ln(n) / n * 2 * (len(pivots) - 2) AS size FROM done d JOIN (SELECT id, count(*) AS n FROM vec GROUP BY 1) USING (id) WHERE n > len(pivots) - 2) "
    "SELECT series_id, arg_min(p, size) AS lag FROM sz GROUP BY 1"
)
def fn_select_lag(spark, sf):
    """The order of the model of each pair's differences, from sums of cross products."""
    return moments.lag_orders(_pairs(spark, sf), "x", "value")


def _model(f):
    def run(x, y):
        fit = f(x, y)
        return *fit.statistics, *fit.ps, fit.stable, fit.white, fit.passes

    return run


_MODEL = "series_id string, x_to_y double, y_to_x double, p_x_to_y double, p_y_to_x double, stable boolean, white double, passes boolean"


@query()
def fn_var_granger(spark, sf):
    return _each_pair(spark, sf, _MODEL, _model(lambda x, y: cz.fit_var(_stack(x, y), 2)))


@query()
def fn_vecm_granger(spark, sf):
    return _each_pair(spark, sf, _MODEL, _model(lambda x, y: cz.fit_vecm(np.column_stack([x, y]), 2)))


@query()
def fn_toda_yamamoto(spark, sf):
    return _each_pair(spark, sf, "series_id string, p_x_to_y double, p_y_to_x double", lambda x, y: cz.toda_yamamoto(np.column_stack([x, y]), 2, 1))


_AROUND = [("x_to_y", "x_to_y,x_to_y"), ("x_to_y", "y_to_x,x_to_y"), ("x_to_y", "none,x_to_y"), ("x_to_y", "?,x_to_y"), ("none", "none"), ("bidirectional", "x_to_y,y_to_x"), ("y_to_x", "?,x_to_y"), ("none", "")]


_DIRECTIONS = ["x_to_y", "y_to_x", "bidirectional", "none"]
_CHOSEN = (
    "WITH a(k, around) AS (VALUES " + ", ".join(f"({i}, '{d}')" for i, (_, d) in enumerate(_AROUND)) + "), l AS (SELECT p_partkey AS id, ['x_to_y', 'y_to_x', 'bidirectional', 'none'][p_size % 4 + 1] AS chosen, list_filter(string_split(around, ','), lambda d: d <> '') AS ds, "
    f"p_partkey % 5 < 2 AS untested, p_partkey % 7 = 3 AS unverified, p_partkey % 11 = 4 AS insensitive FROM part JOIN a ON k = p_partkey % {len(_AROUND)}), "
    "r AS (SELECT *, CASE WHEN (chosen = 'x_to_y' AND list_contains(ds, 'y_to_x')) OR (chosen = 'y_to_x' AND list_contains(ds, 'x_to_y')) THEN 'reversed' WHEN len(ds) = 0 OR list_contains(ds, '?') THEN 'unavailable' WHEN len(list_filter(ds, lambda d: d <> chosen)) > 0 THEN 'inconclusive' ELSE 'passed' END AS robust FROM l) "
)


def _told(spark, sf):
    """For each part a direction, its robustness by directions at the lags beside, and the evidence's class."""
    few = spark.createDataFrame([(i, d) for i, (_, d) in enumerate(_AROUND)], "k int, around string")
    n = F.col("p_partkey")
    x = lake.table(spark, sf, "part").join(F.broadcast(few), F.col("k") == n % len(_AROUND))  # eight cases
    chosen = F.get(F.array(*map(F.lit, _DIRECTIONS)), (F.col("p_size") % 4).cast("int"))
    x = x.select(n.alias("id"), chosen.alias("chosen"), "around", (n % 5 < 2).alias("untested"), (n % 7 == 3).alias("unverified"), (n % 11 == 4).alias("insensitive"))

    def run(frames):
        for pdf in frames:
            robust = [cz.robustness(c, {k: None if d == "?" else d for k, d in enumerate(filter(None, around.split(",")))}) for c, around in zip(pdf["chosen"], pdf["around"], strict=True)]
            status = [cz.classify(c, r, bool(u), bool(v), bool(s))[0] for c, r, u, v, s in zip(pdf["chosen"], robust, pdf["untested"], pdf["unverified"], pdf["insensitive"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "chosen": pdf["chosen"], "robust": robust, "status": status})

    return x.mapInPandas(run, "id long, chosen string, robust string, status string")


@query(_CHOSEN + "SELECT id, chosen, robust FROM r")
def fn_adjacent_lags(spark, sf):
    return _told(spark, sf).select("id", "chosen", "robust")


@query(_CHOSEN + "SELECT id, robust, CASE WHEN chosen = 'none' THEN 'not_identifiable' WHEN robust <> 'passed' OR untested OR unverified OR insensitive THEN 'limited_evidence' ELSE 'predictive_relationship_supported' END AS status FROM r")
def fn_classify_evidence(spark, sf):
    return _told(spark, sf).select("id", "robust", "status")


@query(
    "WITH m AS (SELECT nation, period, row_number() OVER (PARTITION BY nation ORDER BY period) - 1 AS i FROM (SELECT DISTINCT n_name AS nation, CAST(date_trunc('month', o_orderdate) AS DATE) AS period FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)), "
    "b(id, day, kind) AS (VALUES (0, DATE '1994-03-15', 'level'), (1, DATE '1996-01-01', 'trend'), (2, DATE '2050-01-01', 'level'), (3, DATE '1995-01-01', 'slope')), e AS (SELECT nation, min(period) AS lo, max(period) AS hi FROM m GROUP BY 1) "
    "SELECT 'flow.' || e.nation AS series_id, id, CASE WHEN kind IN ('level', 'trend') AND day BETWEEN lo AND hi THEN (SELECT min(i) FROM m WHERE m.nation = e.nation AND period >= day)::INT END AS position FROM e, b"
)
def fn_normalize_breaks(spark, sf):
    """The position in each series of the first period on or after a break; none for breaks outside its sample or of another kind. One pass over the periods, which meet a few breaks."""
    few = [(0, date(1994, 3, 15), "level"), (1, date(1996, 1, 1), "trend"), (2, date(2050, 1, 1), "level"), (3, date(1995, 1, 1), "slope")]
    breaks = spark.createDataFrame(few, "id int, day date, kind string")
    own = Window.partitionBy("series_id").orderBy("period")
    x = lake.flow(spark, sf).withColumn("i", (F.row_number().over(own) - 1).cast("int")).crossJoin(F.broadcast(breaks))  # four rows
    g = x.groupBy("series_id", "id", "kind", "day").agg(F.min("period").alias("lo"), F.max("period").alias("hi"), F.min(F.when(F.col("period") >= F.col("day"), F.col("i"))).alias("i"))
    return g.select("series_id", "id", F.when(F.col("kind").isin("level", "trend") & F.col("day").between(F.col("lo"), F.col("hi")), F.col("i")).alias("position"))


@query()
def fn_integration_order(spark, sf):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("period")["value"].dropna().to_numpy(float)
        return pd.DataFrame([(pdf["series_id"].iloc[0], stats.integration_order(y) if len(y) >= 50 else "insufficient")], columns=["series_id", "verdict"])

    return lake.flow(spark, sf).groupBy("series_id").applyInPandas(run, "series_id string, verdict string")


@query()
def doc_html(spark, sf):
    return documents.extract_html(lake.table(spark, sf, "pages"))


def _with_tables(spark, sf) -> DataFrame:
    """Pages with two tables more: one with a caption and headings, cells that end without a mark, and figures; one within a cell of a table without headings; and a link to a place on the page."""
    n = F.col("page_id")
    figure = F.concat((n % 900 + 100).cast("string"), F.lit("."), F.lpad((n * 37 % 1000).cast("string"), 3, "0"), F.lit(","), F.lpad((n * 7 % 100).cast("string"), 2, "0"))
    first = F.concat(F.lit("<table id=a><caption> Sayfa\n <b>"), n, F.lit("</b></caption><tr></tr><tr><th>Ad<th> Tutar </tr><tr><td>"), F.coalesce("url", F.lit("")), F.lit("<td>"), figure, F.lit("</td></tr><tr><th>toplam</th><th>-</th></tr></table>"))
    second = F.concat(F.lit("<table><tr><td>dış<table><tr><td>"), n * 2, F.lit("</td></tr></table> son</td><td>(12,5)</td></tr></table><a href='#top'>x</a><a href='mailto:a@b'>y</a>"))
    return lake.table(spark, sf, "pages").withColumn("html", F.concat(F.coalesce("html", F.lit("")), first, second))


@query(
    "WITH p AS (SELECT page_id, coalesce(url, '') AS url, (page_id % 900 + 100)::VARCHAR AS a, lpad((page_id * 37 % 1000)::VARCHAR, 3, '0') AS b, lpad((page_id * 7 % 100)::VARCHAR, 2, '0') AS c FROM pages), "
    "t AS (SELECT page_id, 0 AS table_no, 'Sayfa ' || page_id AS caption, 0 AS row_no, 0 AS column_no, 'Ad' AS head, trim(regexp_replace(url, '\\s+', ' ', 'g')) AS cell, NULL::DOUBLE AS value FROM p UNION ALL SELECT page_id, 0, 'Sayfa ' || page_id, 0, 1, 'Tutar', a || '.' || b || ',' || c, (a || b || '.' || c)::DOUBLE FROM p "
    "UNION ALL SELECT page_id, 0, 'Sayfa ' || page_id, 1, 0, 'Ad', 'toplam', NULL FROM p UNION ALL SELECT page_id, 0, 'Sayfa ' || page_id, 1, 1, 'Tutar', '-', NULL FROM p UNION ALL SELECT page_id, 1, NULL, 0, 0, NULL, 'dış son', NULL FROM p UNION ALL SELECT page_id, 1, NULL, 0, 1, NULL, '(12,5)', -12.5 FROM p "
    "UNION ALL SELECT page_id, 2, NULL, 0, 0, NULL, (page_id * 2)::VARCHAR, page_id * 2 FROM p) SELECT * FROM t"
)
def doc_tables(spark, sf):
    """Every cell of the pages' tables, with its heading and its number."""
    return documents.cells(documents.extract_html(_with_tables(spark, sf)))


@query("SELECT page_id, CASE WHEN regexp_matches(lower(substr(html, 1, 15)), '^\\s*<(?:!doctype|html)') THEN 'html' END AS kind FROM pages")
def doc_route(spark, sf):
    return lake.table(spark, sf, "pages").select("page_id", documents.kind_of(F.lit(None).cast("string"), F.col("html").cast("binary")).alias("kind"))


@query("SELECT page_id, s + CASE WHEN s > 0 AND regexp_extract(lower(url), '\\.([a-z0-9]+)(?:[?#].*)?$', 1) IN ('pdf', 'xlsx', 'xls', 'csv', 'docx') THEN 1 ELSE 0 END AS score FROM (SELECT page_id, url, (CASE WHEN contains(lower(url), 'org') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(url), '/en/') THEN 1 ELSE 0 END) AS s FROM pages)")
def doc_score_link(spark, sf):
    return lake.table(spark, sf, "pages").select("page_id", documents.score_link(F.lit(""), F.col("url"), ["org", "/en/"]).alias("score"))


#: Addresses with a fault each, and some without; {} stands for the host of a page.
_URLS = [
    "http://{}/a", "https://user:pw@{}/", "ftp://{}/", "http://10.1.2.3/", "http://172.31.0.1:8080/x", "http://172.32.0.1/", "http://100.64.0.1/", "http://169.254.169.254/latest", "http://127.0.0.1/", "http://8.8.8.8/", "http://0x7f000001/", "http://2130706433/",
    "http://[::1]/", "https://localhost./", "http://db.internal/", "http://intranet/", "HTTP://198.18.0.1/", "http://224.0.0.1/", "https:///x", "http://1.2.3.400/", "",
]
_HOST = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '(?i)^https?://([^/?#\\\\]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '\\.$', '')"
_SAFE = (
    "WITH i(k, t) AS (VALUES " + ", ".join(f"({k}, '{u}')" for k, u in enumerate(_URLS)) + "), p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS h FROM pages), "
    f"hop AS (SELECT page_id, j, replace(t, '{{}}', h) AS u FROM p, range(7) r(j) JOIN i ON k = CASE WHEN j = 0 THEN page_id % {len(_URLS)} WHEN page_id % 4 = 1 AND j = 1 THEN (page_id // 4) % {len(_URLS)} ELSE 0 END WHERE j < CASE WHEN page_id % 13 = 5 THEN 7 ELSE page_id % 3 + 1 END), "
    f"x AS (SELECT *, {_HOST} AS host, lower(regexp_extract(u, '(?i)^https?://([^/?#\\\\]*)', 1)) AS au FROM hop), "
    "y AS (SELECT *, CASE WHEN regexp_full_match(host, '((0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])\\.){3}(0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])') THEN list_reduce(list_transform(string_split(host, '.'), lambda v: v::BIGINT), lambda a, b: a * 256 + b) END AS ip FROM x), "
    "z AS (SELECT page_id, j, CASE WHEN NOT regexp_matches(u, '(?i)^https?://') THEN 'scheme' WHEN contains(au, '@') THEN 'credentials' WHEN host = '' THEN 'host' WHEN host[1] = '[' OR (ip IS NULL AND regexp_full_match(list_last(string_split(host, '.')), '[0-9]+|0x[0-9a-f]*')) THEN 'literal' WHEN "
    + " OR ".join("coalesce(ip BETWEEN {} AND {}, FALSE)".format(*fetching.block(*b)) for b in fetching.SPECIAL) + " OR list_last(string_split(host, '.')) IN (" + ", ".join(f"'{n}'" for n in fetching.LOCAL_NAMES) + ") OR (NOT contains(host, '.') AND ip IS NULL) THEN 'private' END AS why FROM y) "
)


@query(_SAFE + "SELECT page_id, CASE WHEN count(*) > 6 THEN 'redirects' ELSE list(why ORDER BY j) FILTER (why IS NOT NULL)[1] END AS refusal FROM z GROUP BY 1".replace("list(why ORDER BY j) FILTER (why IS NOT NULL)[1]", "(list(why ORDER BY j) FILTER (why IS NOT NULL))[1]"))
def doc_fetch(spark, sf):
    """Why a page's address, or one that it redirects to, may not be fetched."""
    few = F.array(*map(F.lit, _URLS))
    host, k, n = F.regexp_extract("url", "^https?://([^/?#]*)", 1), F.col("page_id"), len(_URLS)
    which = lambda j: F.when(j == 0, k % n).when((k % 4 == 1) & (j == 1), F.floor(k / 4) % n).otherwise(0).cast("int")
    length = F.when(k % 13 == 5, 7).otherwise(k % 3 + 1).cast("int")
    hops = F.transform(F.sequence(F.lit(0), length - 1), lambda j: F.replace(F.get(few, which(j)), F.lit("{}"), host))
    return lake.table(spark, sf, "pages").select("page_id", hops.alias("hops")).select("page_id", fetching.chain_refusal(F.col("hops")).alias("refusal"))


@query("SELECT page_id, coalesce(octet_length(encode(html)), 0)::BIGINT AS bytes, CASE WHEN coalesce(html, '') = '' THEN 'empty' WHEN octet_length(encode(html)) > 4000 THEN 'too_large' END AS refusal, CASE WHEN html <> '' AND octet_length(encode(html)) <= 4000 THEN sha256(html) END AS digest FROM pages")
def doc_upload(spark, sf):
    """Uploads of up to 4,000 bytes with the digest they are known by; empty and larger ones are refused."""
    return fetching.upload(lake.table(spark, sf, "pages"), "html", 4000).select("page_id", "bytes", "refusal", "digest")


def workbooks(spark, sf):
    """A workbook for each region: a sheet of its nations with a gap between the columns, and one of their number. One is in the old binary format."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        region = int(pdf["n_regionkey"].iloc[0])
        main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        names = sorted(pdf["n_name"])
        rows = "".join(f'<row r="{i}"><c r="A{i}" t="s"><v>{i - 1}</v></c><c r="C{i}"><v>{i}</v></c></row>' for i in range(1, len(names) + 1))
        parts = {
            "xl/workbook.xml": f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="nations" sheetId="1" r:id="a"/><sheet name="count" sheetId="2" r:id="b"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {main}>" + "".join(f"<si><t>{n[:3]}</t><r><t>{n[3:]}</t></r></si>" for n in names) + "</sst>",
            "xl/worksheets/sheet1.xml": f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>",
            "xl/worksheets/sheet2.xml": f'<worksheet {main}><sheetData><row><c t="inlineStr"><is><t>n</t></is></c><c><v>{len(names)}</v></c></row></sheetData></worksheet>',
        }
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            for name, text in parts.items():
                book.writestr(name, text)
        return pd.DataFrame({"id": [region], "body": [b"\xd0\xcf\x11\xe0" if region == 4 else out.getvalue()]})

    return lake.table(spark, sf, "nation").groupBy("n_regionkey").applyInPandas(make, "id long, body binary")


@query(
    "WITH n AS (SELECT n_regionkey::BIGINT AS id, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation) SELECT id, 'nations' AS sheet, string_agg(n_name || chr(9) || chr(9) || k, chr(10) ORDER BY k) AS text, FALSE AS cut, NULL::VARCHAR AS refusal FROM n WHERE id <> 4 GROUP BY id "
    "UNION ALL SELECT id, 'count', 'n' || chr(9) || count(*), FALSE, NULL FROM n WHERE id <> 4 GROUP BY id UNION ALL SELECT DISTINCT id, NULL, NULL, NULL::BOOLEAN, 'unsupported' FROM n WHERE id = 4"
)
def doc_excel(spark, sf):
    return fetching.extract_workbooks(workbooks(spark, sf))


@query("SELECT 'pages' AS work, count(*) AS n, FALSE AS late FROM pages UNION ALL SELECT 'suppliers', count(*), FALSE FROM supplier")
def doc_deadline(spark, sf):
    """Two pieces of work under one clock, each with what came of it in time."""
    done, late = fetching.Deadline(spark).run({"pages": lake.table(spark, sf, "pages").count, "suppliers": lake.table(spark, sf, "supplier").count})
    return spark.createDataFrame([(k, v, False) for k, v in done.items()] + [(k, None, True) for k in late], "work string, n long, late boolean")


@query(
    "WITH n AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') AS url, nullif(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '\\s+', ' ', 'g')), '') AS title FROM pages WHERE regexp_matches(url, '^https?://[^/@?#]+')), "
    "o AS (SELECT lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host, url, min(page_id) AS page_id, arg_min(title, page_id) AS title FROM n GROUP BY ALL) SELECT host, page_id, url, title FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS k FROM o) WHERE k <= 10"
)
def web_search(spark, sf):
    """For each host asked for the first ten results: addresses without fragments and last slashes, safe, each once, titles with single spaces."""
    page = lake.table(spark, sf, "pages").where(fetching.refusal(F.col("url")).isNull())
    x = page.select("page_id", F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "/$", "").alias("url"), txt.collapse_space(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("title"))
    x = x.groupBy(fetching.authority(F.col("url")).alias("host"), "url").agg(F.min("page_id").alias("page_id"), F.min_by("title", "page_id").alias("title"))
    by = Window.partitionBy("host").orderBy("page_id")
    return x.withColumn("k", F.row_number().over(by)).where("k <= 10").select("host", "page_id", "url", "title")


@query(
    "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS c FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id IN (0, 1, 2)) "
    "SELECT query_id, vec_id, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS k FROM s) WHERE k <= 5"
)
def src_vector_store(spark, sf):
    """The five nearest vectors of three given ones by cosine: three columns beside each stored vector, no join."""
    e = F.col("embedding").cast("array<double>")
    good = lake.table(spark, sf, "embeddings").select("vec_id", e.alias("e")).where("size(e) > 0").where(~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    asked = [(r.vec_id, r.e) for r in good.where("vec_id IN (0, 1, 2)").collect()]  # three vectors at most
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    hits = F.array(*(F.struct(F.lit(i).alias("query_id"), F.array(*map(F.lit, v)).alias("q")) for i, v in asked))
    x = good.select("vec_id", "e", F.explode(hits).alias("h")).select("vec_id", "e", "h.*").where("vec_id <> query_id AND size(e) = size(q)")
    x = x.withColumn("c", dot(F.col("e"), F.col("q")) / F.sqrt(dot(F.col("e"), F.col("e")) * dot(F.col("q"), F.col("q"))))
    by = Window.partitionBy("query_id").orderBy(F.desc(F.round("c", 9)), "vec_id")
    return x.withColumn("k", F.row_number().over(by)).where("k <= 5").select("query_id", "vec_id", F.round("c", 6).alias("cosine"))


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(CAST(value AS DECIMAL(18,6)))::DOUBLE, 4) AS total FROM events GROUP BY ALL")
def stream_collapse(spark, sf):
    """The batch form of streaming.daily_totals, which tests hold against it."""
    x = lake.table(spark, sf, "events").groupBy("event_type", F.col("ts").cast("date").alias("day"))
    return x.agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,6)")).cast("double"), 4).alias("total"))
