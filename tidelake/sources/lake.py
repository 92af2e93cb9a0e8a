"""A lake of series over the driver's tables: observations (series_id, period, value) of four frequencies, and their catalog. build_ functions make them from the facts; all other queries read the store.

Money is summed as DECIMAL, so that the order of rows can't change a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.functions import numeric
from tidelake.operators import gates
from tidelake.operators.accumulation import decumulate
from tidelake.sources import store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month(c: str) -> Column:
    return F.trunc(F.col(c).cast("date"), "month")


def money(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """period, nation, region, segment, priority, o_totalprice. Nation and region are fixed dimensions; customers join by key."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    facts = table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    return facts.select(month("o_orderdate").alias("period"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), "o_totalprice")


def flow_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_facts(spark, sf_dir).groupBy(F.concat_ws(".", F.lit("flow"), "nation", "segment").alias("series_id"), "nation", "segment", "period").agg(money("o_totalprice").alias("value"))


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation, period, v (the orders' value), n (their number): orders are read once, and join their customers before anything is summed, as sums by customer and month are nearly as many as orders. The join is a merge at any size: customers, whose file is small for their number, aren't sent to all tasks."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", month("o_orderdate").alias("period"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("nation"))
    return orders.join(people.hint("merge"), "o_custkey").groupBy("nation", "period").agg(F.sum("price").alias("v"), F.count("*").alias("n"))


def daily_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, flag, status and exact sums of the lines shipped: lineitem is read once."""
    exact = lambda c, kind="decimal(18,2)": F.sum(F.col(c).cast(kind))
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return x.agg(exact("l_discount", "decimal(18,4)").alias("discount"), exact("l_extendedprice").alias("price"), exact("l_quantity").alias("quantity"), F.count("*").alias("n"))


def build_flow(orders: DataFrame) -> DataFrame:
    """Monthly order value by nation."""
    return orders.select(F.concat(F.lit("flow."), "nation").alias("series_id"), "period", F.col("v").cast("double").alias("value"))


def build_ytd(orders: DataFrame) -> DataFrame:
    """The flow as it would be published when it accumulates within the year."""
    year = Window.partitionBy("nation", F.year("period")).orderBy("period")
    return orders.select(F.concat(F.lit("ytd."), "nation").alias("series_id"), "period", F.sum("v").over(year).cast("double").alias("value"))


def build_stock(orders: DataFrame) -> DataFrame:
    """Orders ever placed, at the end of each month, by nation."""
    own = Window.partitionBy("nation").orderBy("period")
    return orders.select(F.concat(F.lit("stock."), "nation").alias("series_id"), "period", F.sum("n").over(own).cast("double").alias("value"))


def build_weekly_rate(lines: DataFrame) -> DataFrame:
    """Mean discount of a week's shipments by return flag, in whole hundredths summed exactly."""
    x = lines.groupBy(F.concat(F.lit("rate."), "flag").alias("series_id"), F.date_trunc("week", "day").cast("date").alias("period"))
    return x.agg((F.sum("discount").cast("double") / F.sum("n")).alias("value"))


def build_price_index(lines: DataFrame) -> DataFrame:
    """One monthly index: the mean price of a unit shipped."""
    x = lines.groupBy(F.trunc("day", "month").alias("period")).agg((F.sum("price").cast("double") / F.sum("quantity").cast("double")).alias("value"))
    return x.select(F.lit("index.price").alias("series_id"), "period", "value")


def build_quarterly_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parts of a quarter's lines, which sums can't tell: a scan of three columns of its own. What is shuffled is a row for a part and 64 quarters, whose bits say in which of them the part was shipped, not one for a part and quarter."""
    day = F.col("l_shipdate").cast("date")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("status"), F.col("l_partkey").alias("part"), (4 * F.year(day) + F.quarter(day) - 1).alias("quarter")).withColumn("era", F.shiftright("quarter", 6))
    shipped = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.coalesce(F.col("quarter"), F.lit(0)) % 64)).alias("shipped")  # no day: a period of its own, null, that the store refuses
    parts = lines.groupBy("status", "era", "part").agg(shipped)
    bit = lambda of, i: F.shiftrightunsigned(of, i).bitwiseAND(F.lit(1))
    known = F.when(F.col("part").isNotNull(), F.col("shipped")).otherwise(0)
    counts = parts.groupBy("status", "era").agg(F.bit_or("shipped").alias("any"), F.array(*(F.sum(bit(known, i)) for i in range(64))).alias("n"))
    x = counts.select("status", "era", "any", F.posexplode("n").alias("at", "n")).where(F.call_function("getbit", "any", F.col("at")) == 1).withColumn("quarter", F.col("era") * 64 + F.col("at"))
    first = F.make_date(F.floor(F.col("quarter") / 4).cast("int"), F.col("quarter") % 4 * 3 + 1, F.lit(1))
    return x.select(F.concat(F.lit("count."), "status").alias("series_id"), first.alias("period"), F.col("n").cast("double").alias("value"))


#: name, measure type, aggregation rule, frequency, accumulation, statement, unit, table of origin, label
FAMILIES = (
    ("flow", "flow", "sum", "M", "none", "income_statement", "bin tl", "orders", "Sipariş tutarı"),
    ("ytd", "flow", "sum", "M", "ytd", "income_statement", "bin tl", "orders", "Birikimli sipariş tutarı"),
    ("stock", "stock", "last", "M", "none", "balance_sheet", "adet", "orders", "Sipariş sayısı stok"),
    ("rate", "rate", "mean", "W", "none", "ratio", "%", "lineitem", "İndirim oranı"),
    ("index", "index", "last", "M", "none", "ratio", "endeks", "lineitem", "Birim fiyat endeksi"),
    ("count", "count", "last", "Q", "ambiguous", "balance_sheet", "", "lineitem", "Satılan ürün adedi"),
)


def families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FAMILIES), "family string, measure_type string, aggregation_rule string, native_freq string, cumulative_mode string, statement_kind string, unit string, source_ref string, label string")


def build_gold(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Writes the store from the facts: orders and lines are each summed once and written small, and all series come from these. What accumulates is de-cumulated on the way in, and the catalog describes what was written."""
    orders, lines = store.cut(monthly_orders(spark, sf_dir), "orders"), store.cut(daily_lines(spark, sf_dir), "lines")
    made = {"flow": build_flow(orders), "ytd": build_ytd(orders), "stock": build_stock(orders), "rate": build_weekly_rate(lines), "index": build_price_index(lines), "count": build_quarterly_count(spark, sf_dir)}
    out = None
    for name, one in made.items():
        own = decumulate(one, "ytd") if name == "ytd" else one.select("series_id", "period", "value", F.col("value").alias("value_reported"))
        one = own.select(F.lit(name).alias("source"), *store.OBSERVATION_COLUMNS)
        out = one if out is None else out.unionByName(one)
    out = store.cut(out, "observations")  # small; ranges are sampled from it without making it again
    store.write_observations(out, root, gates.watched(out))
    store.write_catalog(describe(store.read_observations(spark, root), families(spark)), root)


def describe(obs: DataFrame, kinds: DataFrame) -> DataFrame:
    """A row of the catalog for each series of obs (source and its observations), by what is known of its source."""
    reported = F.col("value_reported")
    seen = obs.groupBy("series_id", "source").agg(
        F.min("period").alias("coverage_start"), F.max("period").alias("coverage_end"), F.count("*").cast("int").alias("observations"), F.count_if(reported.isNotNull() & (reported != 0)).cast("int").alias("nonzero_observations")
    )
    tail = F.substring_index("series_id", ".", -1)
    symbol, scale = numeric.normalise_unit(F.col("unit"))
    none = F.lit(None).cast("string")
    return seen.join(kinds.withColumnRenamed("family", "source"), "source").select(
        "series_id", "source", "source_ref", F.concat_ws(" ", "label", tail).alias("name_tr"), F.col("label").alias("raw_label"), "measure_type", "statement_kind", F.lit("Sektör").alias("sector_scope"), F.lit("Toplam").alias("currency_basis"),
        F.when(F.col("source").isin("flow", "ytd", "stock"), tail).alias("province"), F.col("unit").alias("unit_raw"), symbol.alias("unit_normalized"), scale.alias("scale_factor"), "cumulative_mode", none.alias("cumulative_evidence"),
        F.when(F.col("cumulative_mode") != "ambiguous", "definition").otherwise("").alias("cumulative_verified_by"), "native_freq", "aggregation_rule", "coverage_start", "coverage_end", "observations", "nonzero_observations",
        F.current_timestamp().alias("retrieved_at"), F.sha2(F.concat_ws("|", "source", "source_ref", "series_id", "observations"), 256).alias("source_hash"), F.lit("").alias("notes"),
    )


def gold(spark: SparkSession, sf_dir: str) -> str:
    """Where the session's store of sf_dir is; it is written when first asked for."""
    return store.opened(spark, sf_dir, lambda root: build_gold(spark, sf_dir, root))


def of_source(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """(series_id, period, value as published) of a source's series: one folder of the store."""
    return store.read_observations(spark, gold(spark, sf_dir)).where(F.col("source") == source).select("series_id", "period", F.col("value_reported").alias("value"))


def point(spark: SparkSession, sf_dir: str, series_id: str) -> DataFrame:
    """(period, value) of one series. Its source, which its id begins with, prunes all other folders; the id reaches the scan."""
    return of_source(spark, sf_dir, series_id.partition(".")[0]).where(F.col("series_id") == series_id).select("period", "value")


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_source(spark, sf_dir, "flow")


def ytd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_source(spark, sf_dir, "ytd")


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_source(spark, sf_dir, "stock")


def weekly_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_source(spark, sf_dir, "rate")


def price_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_source(spark, sf_dir, "index")


def quarterly_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_source(spark, sf_dir, "count")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All series in one long table (series_id, period, value as published, family)."""
    return store.read_observations(spark, gold(spark, sf_dir)).select("series_id", "period", F.col("value_reported").alias("value"), F.col("source").alias("family"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each series with its semantics and coverage."""
    x = store.read_catalog(spark, gold(spark, sf_dir))
    usable = (F.col("cumulative_mode") != "ambiguous") & (F.col("measure_type") != "unknown") & (F.col("unit_raw") != "")
    return x.select(
        F.col("source").alias("family"), "series_id", "coverage_start", "coverage_end", F.col("observations").cast("long").alias("observations"), F.col("nonzero_observations").cast("long").alias("nonzero"), "measure_type", "aggregation_rule",
        "native_freq", "cumulative_mode", "statement_kind", F.col("unit_raw").alias("unit"), "province", usable.alias("usable"), "name_tr", "raw_label",
    )


#: The same in DuckDB, as common table expressions to put queries behind.
SQL = """
WITH facts AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, n_name AS nation, r_name AS region, c_mktsegment AS segment, o_orderpriority AS priority, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
flow AS (SELECT 'flow.' || nation AS series_id, period, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM facts GROUP BY ALL),
flow_by_segment AS (SELECT 'flow.' || nation || '.' || segment AS series_id, nation, segment, period, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM facts GROUP BY ALL),
ytd AS (SELECT 'ytd.' || substr(series_id, 6) AS series_id, period, CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY series_id, year(period) ORDER BY period) AS DOUBLE) AS value FROM flow),
stock AS (SELECT series_id, period, CAST(SUM(n) OVER (PARTITION BY series_id ORDER BY period) AS DOUBLE) AS value FROM (SELECT 'stock.' || nation AS series_id, period, count(*) AS n FROM facts GROUP BY ALL)),
rate AS (SELECT 'rate.' || l_returnflag AS series_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS period, CAST(SUM(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS value FROM lineitem GROUP BY ALL),
price AS (SELECT 'index.price' AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS period, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem GROUP BY ALL),
parts AS (SELECT 'count.' || l_linestatus AS series_id, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, CAST(count(DISTINCT l_partkey) AS DOUBLE) AS value FROM lineitem GROUP BY ALL),
observations AS (SELECT *, 'flow' AS family FROM flow UNION ALL SELECT *, 'ytd' FROM ytd UNION ALL SELECT *, 'stock' FROM stock UNION ALL SELECT *, 'rate' FROM rate UNION ALL SELECT *, 'index' FROM price UNION ALL SELECT *, 'count' FROM parts),
families(family, measure_type, aggregation_rule, native_freq, cumulative_mode, statement_kind, unit) AS (VALUES ('flow','flow','sum','M','none','income_statement','bin tl'), ('ytd','flow','sum','M','ytd','income_statement','bin tl'), ('stock','stock','last','M','none','balance_sheet','adet'), ('rate','rate','mean','W','none','ratio','%'), ('index','index','last','M','none','ratio','endeks'), ('count','count','last','Q','ambiguous','balance_sheet','')),
catalog AS (SELECT series_id, f.*, coverage_start, coverage_end, observations, nonzero, CASE WHEN family IN ('flow','ytd','stock') THEN split_part(series_id, '.', 2) END AS province, cumulative_mode <> 'ambiguous' AND measure_type <> 'unknown' AND unit <> '' AS usable
  FROM (SELECT series_id, family, min(period) AS coverage_start, max(period) AS coverage_end, count(*) AS observations, count(*) FILTER (value IS NOT NULL AND value <> 0) AS nonzero FROM observations GROUP BY ALL) JOIN families f USING (family))
"""
