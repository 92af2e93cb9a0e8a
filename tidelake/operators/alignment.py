"""Frequencies: collapse by each series' own rule, inference, alignment on a common spine. Nothing is filled, nothing upsampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COARSENESS = {"D": 0, "W": 1, "M": 2, "Q": 3}


class UpsampleRefused(ValueError):
    """A finer frequency than the series has was asked for."""


class JoinRefused(ValueError):
    """A series is asked for twice, or an output key is taken."""


def bucket(period: str, target: str) -> Column:
    """The label of a period at the target frequency: first day of month or quarter, the Sunday that ends the week."""
    c = F.col(period).cast("date")
    return {"D": c, "W": F.next_day(F.date_sub(c, 1), "SUN"), "M": F.trunc(c, "month"), "Q": F.trunc(c, "quarter")}[target]


def refuse_upsampling(native: str, target: str) -> None:
    if COARSENESS[native] > COARSENESS[target]:
        raise UpsampleRefused(f"a series of frequency {native} can't be shown at {target}")


def collapse(obs: DataFrame, target: str, rule: str = "aggregation_rule", native: str | None = None) -> DataFrame:
    """series_id, period, value at the target frequency; obs has a column that names each series' rule: sum, mean, else last. A bucket without a value is null."""
    if native:
        refuse_upsampling(native, target)
    value = F.when(F.first(rule) == "sum", F.sum("value")).when(F.first(rule) == "mean", F.avg("value")).otherwise(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("period"))))
    return obs.groupBy("series_id", bucket("period", target).alias("bucket")).agg(value.alias("value")).withColumnRenamed("bucket", "period")


def gaps(obs: DataFrame) -> DataFrame:
    own = Window.partitionBy("series_id").orderBy("period")
    return obs.select("series_id", "period").distinct().withColumn("gap", F.date_diff("period", F.lag("period").over(own)))


def infer_frequency(obs: DataFrame) -> DataFrame:
    """series_id, median_gap (the upper median of the distinct gaps), frequency: up to 3 days D, 10 W, 45 M, else Q; M for fewer than two periods."""
    found = gaps(obs).groupBy("series_id").agg(F.array_sort(F.collect_set("gap")).alias("g"))
    mid = F.get("g", (F.size("g") / 2).cast("int"))
    freq = F.when(mid.isNull(), "M").when(mid <= 3, "D").when(mid <= 10, "W").when(mid <= 45, "M").otherwise("Q")
    return found.select("series_id", mid.alias("median_gap"), freq.alias("frequency"))


def observed_frequency(obs: DataFrame) -> DataFrame:
    """series_id, frequency by the upper median of all gaps: monthly (25 to 35 days), weekly (6 to 8), daily (1 to 5) or unknown."""
    found = gaps(obs).groupBy("series_id").agg(F.array_sort(F.collect_list("gap")).alias("g"))
    mid = F.get("g", (F.size("g") / 2).cast("int"))
    return found.select("series_id", F.when(mid.between(25, 35), "monthly").when(mid.between(6, 8), "weekly").when(mid.between(1, 5), "daily").otherwise("unknown").alias("frequency"))


def contiguous(obs: DataFrame, freq: Column | str = "M") -> DataFrame:
    """series_id, contiguous: whether a series misses no period between its ends, by its frequency: M one month, W seven days, D one to three days (a weekend), Q three months. Of another frequency nothing is contiguous beyond one observation."""
    own = Window.partitionBy("series_id").orderBy("period")
    last = F.lag("period").over(own)
    days, freq = F.date_diff("period", last), F.lit(freq) if isinstance(freq, str) else freq
    step = F.when(freq == "M", F.months_between("period", last) == 1).when(freq == "W", days == 7).when(freq == "D", days.between(1, 3)).when(freq == "Q", F.months_between("period", last) == 3).otherwise(False)
    return obs.withColumn("step", F.when(last.isNotNull(), step)).groupBy("series_id").agg(F.coalesce(F.bool_and("step"), F.lit(True)).alias("contiguous"))


def spine_join(spine: DataFrame, obs: DataFrame, key: str, on: list[str] = ["period"]) -> DataFrame:  # noqa: B006  never changed
    """The spine with one more column; rows of the spine are neither added nor lost."""
    return spine.join(obs.select(*on, F.col("value").alias(key)), on, "left")


def join_series(spine: DataFrame, obs: DataFrame, series: dict[str, str]) -> DataFrame:
    """Several series as columns on an unchanged spine, by one aggregation and one join. series: output key to series id."""
    if len(set(series.values())) != len(series):
        raise JoinRefused("a series is asked for twice")
    if set(series) & set(spine.columns):
        raise JoinRefused("an output key is taken")
    wide = obs.where(F.col("series_id").isin(list(series.values()))).groupBy("period").agg(*(F.max(F.when(F.col("series_id") == s, F.col("value"))).alias(k) for k, s in series.items()))
    return spine.join(wide, "period", "left")


def align(obs: DataFrame, target: str, truncate: bool = True) -> DataFrame:
    """series_id, period, value of all series at one frequency up to the earliest of their ends (the last period with a value); forced: whether the series is one that set that end."""
    flat = collapse(obs, target).where("value IS NOT NULL")
    ends = flat.groupBy("series_id").agg(F.max("period").alias("end"))
    common = ends.agg(F.min("end").alias("common_end"))
    ends = ends.crossJoin(F.broadcast(common)).withColumn("forced", F.col("end") == F.col("common_end"))  # one row
    out = flat.join(ends, "series_id")
    return (out.where("period <= common_end") if truncate else out).select("series_id", "period", "value", "forced")
