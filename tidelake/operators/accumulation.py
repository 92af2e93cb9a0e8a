"""How a series accumulates: classification, de-cumulation, closure. Windows over (series_id, period) alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions import text as txt

#: Lines of a balance sheet that are profits of the year so far.
INCOME_LINES = ("dönem karı (zararı)", "dönem net karı (zararı)")
RESET_DROP, MIN_RESET_RATIO, MIN_POINTS = 0.5, 0.6, 13
CLOSURE_TOLERANCE = 0.005


def own():
    return Window.partitionBy("series_id").orderBy("period")


def within_year():
    return Window.partitionBy("series_id", F.year("period")).orderBy("period")


class Ambiguous(ValueError):
    """A series whose accumulation isn't known can't be de-cumulated."""


def decumulate(obs: DataFrame, mode: str = "ytd") -> DataFrame:
    """value becomes the period's own figure, value_reported stays as published. ytd: the first figure of a year is its own, every other is the difference from the one before; inception: the difference from the one before, none for the first; none: as it is.
    Where either figure is null the difference is null; nothing is filled."""
    if mode == "none":
        return obs.withColumn("value_reported", F.col("value"))
    if mode not in ("ytd", "inception"):
        raise Ambiguous(f"a series whose accumulation is {mode} can't be de-cumulated")
    window = within_year() if mode == "ytd" else own()
    step = F.col("value") - F.lag("value").over(window)
    figure = F.when(F.row_number().over(window) == 1, F.col("value")).otherwise(step) if mode == "ytd" else step
    return obs.select("series_id", "period", figure.alias("own"), F.col("value").alias("value_reported")).withColumnRenamed("own", "value")


def classify(obs: DataFrame) -> DataFrame:
    """series_id, n, opportunities, resets, years, monotone_years, monotone, mode (ytd, ambiguous or none), from the pattern of the figures."""
    x = obs.where("value IS NOT NULL").withColumn("year", F.year("period"))
    by_year = Window.partitionBy("series_id", "year").orderBy("period")
    x = x.withColumn("up", F.col("value") >= F.lag("value").over(by_year)).withColumn("up_all", F.col("value") >= F.lag("value").over(own()))
    year = x.groupBy("series_id", "year").agg(
        F.count("*").alias("n"), F.bool_and("up").alias("up"), F.bool_and("up_all").alias("up_all"), F.max(F.when(F.month("period") == 1, F.col("value"))).alias("jan"), F.max(F.when(F.month("period") == 12, F.col("value"))).alias("dec")
    )
    years = Window.partitionBy("series_id").orderBy("year")
    before = F.when(F.lag("year").over(years) == F.col("year") - 1, F.lag("dec").over(years))
    year = year.withColumn("chance", F.col("jan").isNotNull() & (before > 0)).withColumn("reset", F.col("chance") & (F.col("jan") <= RESET_DROP * before))
    out = year.groupBy("series_id").agg(
        F.sum("n").alias("n"), F.count_if("chance").alias("opportunities"), F.count_if("reset").alias("resets"), F.count_if(F.col("n") >= 2).alias("years"), F.count_if((F.col("n") >= 2) & F.col("up")).alias("monotone_years"), F.bool_and("up_all").alias("monotone")
    )
    enough = (F.col("opportunities") > 0) & (F.col("resets") >= MIN_RESET_RATIO * F.col("opportunities"))
    mode = (
        F.when(F.col("n") < MIN_POINTS, "ambiguous")
        .when(enough & (F.col("monotone_years") >= F.greatest(F.lit(1), F.col("years") - 2)), "ytd")
        .when(enough, "ambiguous")
        .when(F.coalesce("monotone", F.lit(True)), "ambiguous")
        .otherwise("none")
    )
    return out.withColumn("mode", mode)


def resolve_by_statement(df: DataFrame) -> DataFrame:
    """Column mode resolved by statement_kind where the pattern left it ambiguous; verified_by says which of them decided. The profit lines of a balance sheet (by label, if there is one) accumulate like those of an income statement."""
    profit = txt.casefold(F.btrim("label")).isin(*INCOME_LINES) if "label" in df.columns else F.lit(False)
    by = F.when((F.col("statement_kind") == "income_statement") | profit, "ytd").when(F.col("statement_kind").isin("balance_sheet", "off_balance_sheet", "ratio"), "none")
    resolved = F.when(F.col("mode") != "ambiguous", F.col("mode")).otherwise(F.coalesce(by, F.col("mode")))
    verified = F.when(F.col("mode") != "ambiguous", "pattern").when(by.isNotNull(), "statement").otherwise("")
    return df.withColumn("resolved", resolved).withColumn("verified_by", verified)


def closure(decumulated: DataFrame, tolerance: float = CLOSURE_TOLERANCE, keys: tuple[str, ...] = ()) -> DataFrame:
    """For each complete year the sum of its own figures against December as published: series_id, year, total, december, closes; keys tell copies of the series apart."""
    by_year = decumulated.groupBy(*keys, "series_id", F.year("period").alias("year")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"), F.max(F.when(F.month("period") == 12, F.col("value_reported"))).alias("december"), F.count("value").alias("n")
    )
    return by_year.where("december IS NOT NULL AND abs(december) > 1 AND n = 12").select(*keys, "series_id", "year", "total", "december", (F.abs(F.col("total") - F.col("december")) <= tolerance * F.abs("december")).alias("closes"))
