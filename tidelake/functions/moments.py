"""Statistics of series from sums: cross products of lagged columns are summed by Spark, so a series needn't fit a task, and what is left for each, a matrix of a few columns, is solved row by row.

Columns are centred and scaled first. All models have a constant, so the statistics don't change by it, and the sums keep their digits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions import stats

def own():
    return Window.partitionBy("series_id").orderBy("i")


def standard(column: str) -> Column:
    """A column less its mean, in standard deviations of its series; null where it doesn't vary."""
    whole = Window.partitionBy("series_id")
    return F.try_divide(F.col(column) - F.avg(column).over(whole), F.nullif(F.stddev_samp(column).over(whole), F.lit(0.0)))


def numbered(obs: DataFrame, *columns: str) -> DataFrame:
    """series_id, i (from 0, in order of periods), columns: rows in which all of these have a value."""
    x = obs.dropna(subset=list(columns)).withColumn("i", F.row_number().over(Window.partitionBy("series_id").orderBy("period")) - 1)
    return x.select("series_id", "i", *columns)


def gram(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, n, g: of rows with a vector v of k numbers (a null counts for nothing) how many there are and their cross products, row by row of the matrix."""
    sums = [F.coalesce(F.sum(F.get("v", F.lit(i)) * F.get("v", F.lit(j))), F.lit(0.0)) for i in range(k) for j in range(i + 1)]
    at = {(i, j): n for n, (i, j) in enumerate((i, j) for i in range(k) for j in range(i + 1))}
    full = F.array(*(F.get("s", F.lit(at[max(i, j), min(i, j)])) for i in range(k) for j in range(k)))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*sums).alias("s")).select(*keys, "n", full.alias("g"))


def _lags(column: str, most: int) -> Column:
    """The values before this row's, the last one first, as many as there are up to most."""
    return F.reverse(F.collect_list(column).over(own().rowsBetween(-most, -1))) if most else F.array().cast("array<double>")


def residuals(g: np.ndarray) -> list[float]:
    """Of a matrix of cross products: what is left of the last column's squares before the first, second, ... column is taken out of it."""
    m, out = g.copy(), []
    for k in range(len(m) - 1):
        out.append(float(m[-1, -1]))
        if m[k, k] <= 1e-10 * g[k, k]:
            raise stats.Refused("columns depend on each other")
        m -= np.outer(m[:, k], m[k]) / m[k, k]
    return [*out, float(m[-1, -1])]


def unit_roots(obs: DataFrame, column: str = "value") -> DataFrame:
    """series_id, statistic, p, lag: the augmented Dickey-Fuller test with a constant, its lag by the Akaike criterion over a common sample; null where it can't be computed."""
    x = numbered(obs, column).withColumn("y", standard(column)).withColumn("n", F.count("*").over(Window.partitionBy("series_id")))
    most = F.greatest(F.lit(0), F.least(F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))), F.floor(F.col("n") / 2) - 2)).cast("int")
    x = x.withColumn("most", most).withColumn("before", F.lag("y").over(own())).withColumn("d", F.col("y") - F.col("before"))
    width = x.agg(F.max("most")).first()[0] or 0  # a dozen, for a hundred observations
    x = x.withColumn("lags", _lags("d", width)).where("i > 0").withColumn("t", F.col("i") - 1)  # t: the difference's number

    def vectors(rows: DataFrame, p: str) -> DataFrame:
        some = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.when(k < F.col(p), F.get("lags", k))) if width else F.array().cast("array<double>")
        return rows.where(F.col("t") >= F.col(p)).withColumn("v", F.concat(F.array(F.lit(1.0), F.col("before")), some, F.array("d")))

    k = width + 3

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for n, most, g in zip(pdf["n"], pdf["most"], pdf["g"], strict=True):
            at = [*range(2 + most), k - 1]
            try:
                rest = residuals(np.array(g).reshape(k, k)[np.ix_(at, at)])
                out.append(min(range(most + 1), key=lambda p: (n * math.log(rest[p + 2] / n) + 2 * (p + 2), p)) if n > 0 and min(rest) > 0 else None)
            except (stats.Refused, ValueError):
                out.append(None)
        return pd.DataFrame({"series_id": pdf["series_id"], "lag": out})

    def each(f, schema: str):
        def run(frames):
            for pdf in frames:
                yield f(pdf)

        return lambda df: df.mapInPandas(run, schema)

    lag = each(chosen, "series_id string, lag double")(gram(vectors(x, "most"), ["series_id", "most"], k)).select("series_id", F.when(~F.isnan("lag"), F.col("lag")).cast("int").alias("lag"))

    def tested(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for n, p, g in zip(pdf["n"], pdf["lag"], pdf["g"], strict=True):
            at = [0, *range(2, 2 + p), 1, k - 1]  # the level last
            m = np.array(g).reshape(k, k)[np.ix_(at, at)]
            for j in range(p + 1):
                m = m - np.outer(m[:, j], m[j]) / m[j, j]
            a, b, c = m[-2, -2], m[-2, -1], m[-1, -1]
            s2 = (c - b * b / a) / (n - p - 2) if n > p + 2 else 0.0
            t = b / a / math.sqrt(s2 / a) if s2 > 0 else None
            out.append((t, None if t is None else stats.unit_root_p(t), None if t is None else p))
        return pd.DataFrame({"series_id": pdf["series_id"], "statistic": [o[0] for o in out], "p": [o[1] for o in out], "lag": pd.array([o[2] for o in out], "Int64")})

    sample = vectors(x.join(lag.where("lag IS NOT NULL"), "series_id"), "lag")
    found = each(tested, "series_id string, statistic double, p double, lag long")(gram(sample, ["series_id", "lag"], k))
    return obs.select("series_id").distinct().join(found, "series_id", "left").select("series_id", "statistic", "p", F.col("lag").cast("int").alias("lag"))


def lag_orders(obs: DataFrame, x: str, y: str, most: int = 3) -> DataFrame:
    """series_id, lag: the order of a two-variable autoregression of the differences of x and y with the least Bayesian criterion, each over its own sample; null if none can be fitted."""
    z = numbered(obs, x, y)
    for c in (x, y):
        z = z.withColumn(f"d{c}", F.col(c) - F.lag(c).over(own()))
    z = z.where("i > 0").withColumn("t", F.col("i") - 1)
    for c in (x, y):
        z = z.withColumn(f"z{c}", standard(f"d{c}"))
    lags = [F.lag(f"z{c}", k).over(own()) for k in range(1, most + 1) for c in (x, y)]
    z = z.select("series_id", "t", F.array(*lags).alias("lags"), F.array(f"z{x}", f"z{y}").alias("now")).withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(most)))).where("t >= p")
    z = z.withColumn("v", F.concat(F.array(F.lit(1.0)), F.transform("lags", lambda a, i: F.when(i < 2 * F.col("p"), a)), "now"))
    k = 2 * most + 3

    def run(frames):
        for pdf in frames:
            size = []
            for n, p, g in zip(pdf["n"], pdf["p"], pdf["g"], strict=True):
                at = [*range(1 + 2 * p), k - 2, k - 1]
                m, value = np.array(g).reshape(k, k)[np.ix_(at, at)], None
                if n > 1 + 2 * p:
                    start = m.diagonal().copy()
                    pivots = []
                    for j in range(len(m)):
                        pivots.append(m[j, j] if m[j, j] > 1e-10 * start[j] else 0.0)
                        if not pivots[-1]:
                            break
                        m = m - np.outer(m[:, j], m[j]) / m[j, j]
                    if all(pivots):
                        value = math.log(pivots[-2] * pivots[-1] / n**2) + math.log(n) / n * 2 * (1 + 2 * p)
                size.append(value)
            yield pd.DataFrame({"series_id": pdf["series_id"], "p": pdf["p"], "size": size})

    sized = gram(z, ["series_id", "p"], k).mapInPandas(run, "series_id string, p int, size double").where("size IS NOT NULL AND NOT isnan(size)")
    best = sized.groupBy("series_id").agg(F.min_by("p", F.struct("size", "p")).alias("lag"))
    return obs.select("series_id").distinct().join(best, "series_id", "left")


def stationarity(obs: DataFrame, column: str = "value") -> DataFrame:
    """series_id, statistic, p: level stationarity with a Bartlett kernel and the automatic bandwidth of Hobijn et al. (1998), from partial sums and autocovariances, which are sums over pairs of rows so many places apart."""
    e = numbered(obs, column).withColumn("e", F.col(column) - F.avg(column).over(Window.partitionBy("series_id")))
    e = e.withColumn("partial", F.sum("e").over(own().rowsBetween(Window.unboundedPreceding, 0)))
    size = e.groupBy("series_id").agg(F.count("*").alias("n"), F.sum(F.col("partial") * F.col("partial")).alias("squares"))

    def covariances(most: DataFrame) -> DataFrame:
        """series_id, k, c for k from 0 to each series' own most (series_id, most)."""
        ahead = e.join(most, "series_id").select("series_id", F.explode(F.sequence(F.lit(0), F.col("most"))).alias("k"), F.col("i"), F.col("e").alias("a"))
        pairs = ahead.withColumn("i", F.col("i") + F.col("k")).join(e.select("series_id", "i", "e"), ["series_id", "i"])
        return pairs.groupBy("series_id", "k").agg(F.sum(F.col("a") * F.col("e")).alias("c"))

    cap = covariances(size.select("series_id", F.floor(F.pow("n", F.lit(2 / 9))).cast("int").alias("most"))).join(size, "series_id")
    at = F.when(F.col("k") == 0, F.col("c") / F.col("n")).otherwise(F.col("c") / (F.col("n") / 2))
    s = cap.groupBy("series_id", "n", "squares").agg(F.sum(at).alias("s0"), F.sum(F.col("k") * at).alias("s1"))
    width = F.least(1.1447 * F.pow(F.pow(F.col("s1") / F.col("s0"), F.lit(2)), F.lit(1 / 3)) * F.pow("n", F.lit(1 / 3)), F.col("n") - 1)
    s = s.select("series_id", "n", "squares", F.when(F.col("s0") != 0, F.floor(width)).otherwise(0).cast("int").alias("most"))
    c = covariances(s.select("series_id", "most")).join(s, "series_id")
    weight = F.when(F.col("k") == 0, 1.0).otherwise(2 * (1 - F.col("k") / (F.col("most") + 1)))
    long = c.groupBy("series_id", "n", "squares").agg((F.sum(weight * F.col("c")) / F.first("n")).alias("long"))
    return long.select("series_id", F.when(F.col("long") > 0, F.col("squares") / (F.col("n") * F.col("n")) / F.col("long")).otherwise(float("inf")).alias("statistic")).withColumn("p", between(F.col("statistic"), stats.KPSS_POINTS, stats.KPSS_LEVELS))


def between(x: Column, points: tuple[float, ...], levels: tuple[float, ...]) -> Column:
    """The level at x on the line through points; beyond them the outermost."""
    out = F.when(x <= points[0], float(levels[0]))
    for a, b, u, v in zip(points, points[1:], levels, levels[1:], strict=False):
        out = out.when(x <= b, u + (x - a) / (b - a) * (v - u))
    return out.otherwise(float(levels[-1]))
