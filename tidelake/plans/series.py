"""Queries over the lake of series: sources, joins, aggregations, windows, selections, gates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.functions import numeric
from tidelake.operators import accumulation as acc
from tidelake.operators import alignment as al
from tidelake.operators import gates
from tidelake.plans.registry import query
from tidelake.sources import bronze, lake, store
from tidelake.sources.lake import SQL


# ---- sources and sinks


_GOLD = SQL + (
    ", f(family, source_ref, label) AS (VALUES " + ", ".join(f"('{x[0]}', '{x[7]}', '{x[8]}')" for x in lake.FAMILIES) + "), "
    "u(k, symbol, scale) AS (VALUES " + ", ".join(f"('{k}', '{x}', {v}::DOUBLE)" for k, (x, v) in numeric.UNITS.items()) + "), "
    "g AS (SELECT c.*, source_ref, label, split_part(series_id, '.', 2) AS tail, coalesce(symbol, '') AS symbol, coalesce(scale, 1.0) AS scale FROM catalog c JOIN f USING (family) LEFT JOIN u ON k = unit) "
    "SELECT series_id, family AS source, source_ref, label || ' ' || tail AS name_tr, label AS raw_label, measure_type, statement_kind, 'Sektör' AS sector_scope, 'Toplam' AS currency_basis, province, unit AS unit_raw, symbol AS unit_normalized, "
    "scale::DOUBLE AS scale_factor, cumulative_mode, NULL::VARCHAR AS cumulative_evidence, CASE WHEN cumulative_mode <> 'ambiguous' THEN 'definition' ELSE '' END AS cumulative_verified_by, native_freq, aggregation_rule, coverage_start, coverage_end, "
    "observations::INT AS observations, nonzero::INT AS nonzero_observations, sha256(concat_ws('|', family, source_ref, series_id, observations)) AS source_hash, '' AS notes FROM g"
)


@query(_GOLD)
def snk_gold(spark: SparkSession, sf: str) -> DataFrame:
    """The whole store written anew from the facts, checked, and its catalog as read back, without the time of writing."""
    root = store.rebuilt(spark, sf, lambda root: lake.build_gold(spark, sf, root))
    return store.read_catalog(spark, root).drop("retrieved_at")


@query(
    SQL + ", own AS (SELECT series_id, period, CASE WHEN row_number() OVER w = 1 THEN value ELSE value - lag(value) OVER w END AS value, value AS value_reported FROM ytd WINDOW w AS (PARTITION BY series_id, year(period) ORDER BY period)), "
    "o AS (SELECT 'ytd' AS source, * FROM own UNION ALL SELECT family, series_id, period, value, value FROM observations WHERE family <> 'ytd') "
    "SELECT source, count(*) AS n, count(DISTINCT series_id) AS series, min(period) AS lo, max(period) AS hi, round(sum(value), 2) AS value, round(sum(value_reported), 2) AS value_reported FROM o GROUP BY 1"
)
def snk_duckdb(spark, sf):
    """A snapshot of the store: overwritten as a whole, a folder for each source and files of ranges of series in place of indexes; what is read back, by source."""
    root = store.path_of(spark, sf, "snapshot")
    now = store.read_observations(spark, lake.gold(spark, sf))
    for _ in range(2):  # the second replaces the first
        store.write_observations(now, root)
    store.write_catalog(store.read_catalog(spark, lake.gold(spark, sf)), root)
    store.check(spark, root)
    total = lambda c: F.round(F.sum(c), 2).alias(c)
    return store.read_observations(spark, root).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("series_id").alias("series"), F.min("period").alias("lo"), F.max("period").alias("hi"), total("value"), total("value_reported"))


@query(SQL + "SELECT period, round(value, 6) AS value FROM flow WHERE series_id = 'flow.NATION_19'")
def src_gold_point(spark, sf):
    return lake.point(spark, sf, "flow.NATION_19").select("period", F.round("value", 6).alias("value"))


@query(SQL + "SELECT series_id, native_freq, CASE WHEN isnan(v) THEN NULL ELSE v END AS mean_value FROM (SELECT series_id, native_freq, observations::DOUBLE / nullif(nonzero, 0) AS v FROM catalog)")
def src_gold_scan(spark, sf):
    v = F.try_divide(F.col("observations").cast("double"), F.col("nonzero"))
    return lake.catalog(spark, sf).select("series_id", "native_freq", F.when(F.isnan(v), None).otherwise(v).alias("mean_value"))


@query(SQL + "SELECT period FROM price WHERE period BETWEEN DATE '1995-06-01' AND DATE '1997-06-30' AND value IS NOT NULL")
def src_period_range(spark, sf):
    return lake.price_index(spark, sf).where("period BETWEEN DATE '1995-06-01' AND DATE '1997-06-30' AND value IS NOT NULL").select("period")


@query("SELECT count(*) > 0 AS ready, count(*) AS n FROM (SELECT o_orderkey FROM orders LIMIT 1)")
def src_bind_probe(spark, sf):
    probe = lake.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return probe.limit(1).agg((F.count("*") > 0).alias("ready"), F.count("*").alias("n"))


@query(
    "WITH r AS (SELECT o_orderpriority AS k, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1), w AS (SELECT k, b, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 999 DAY)) AS s FROM r) SELECT k, CAST(s AS DATE) AS window_start, least(CAST(s + INTERVAL 998 DAY AS DATE), b) AS window_end FROM w"
)
def src_windows(spark, sf):
    """The span of each kind of order in requests of at most 999 days."""
    span = lake.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.min(F.col("o_orderdate").cast("date")).alias("a"), F.max(F.col("o_orderdate").cast("date")).alias("b"))
    x = span.select("k", "b", F.explode(F.expr("sequence(a, b, INTERVAL 999 DAY)")).alias("window_start"))
    return x.select("k", "window_start", F.least(F.date_add("window_start", 998), "b").alias("window_end"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def src_dedupe_window(spark, sf):
    by = Window.partitionBy("user_id", "day").orderBy(F.desc("event_id"))
    x = lake.table(spark, sf, "events").withColumn("day", F.col("ts").cast("date")).withColumn("k", F.row_number().over(by))
    return x.where("k = 1").select("user_id", "day", "event_id", F.round("value", 6).alias("value"))


@query(SQL + "SELECT f.series_id, coalesce(n, 0) AS n, coalesce(missing, 0) AS missing, lo, hi, CASE WHEN coalesce(n, 0) > 0 THEN 'ok' ELSE 'no_data' END AS status FROM (SELECT DISTINCT series_id FROM flow UNION ALL SELECT 'flow.NOWHERE') f LEFT JOIN (SELECT series_id, count(*) AS n, count(*) FILTER (value IS NULL) AS missing, min(period) AS lo, max(period) AS hi FROM flow GROUP BY 1) USING (series_id)")
def snk_silver_parquet(spark, sf):
    """Points are written in the silver layer's types and read back; their coverage is reported against the configured series, of which one has no data."""
    x = lake.flow(spark, sf)
    config = x.select(F.col("series_id").alias("series_code")).distinct().union(spark.createDataFrame([("flow.NOWHERE",)], "series_code string"))
    points = x.select(F.col("series_id").alias("series_code"), "period", "value", F.lit("2024-01-01 00:00:00").alias("retrieved_at"))
    return store.coverage(store.write_silver(points, store.path_of(spark, sf, "points")), config).withColumnRenamed("series_code", "series_id")


_TREE = (
    "tree AS (SELECT 'part.' || p_partkey AS id, 'brand.' || p_brand AS parent, NULL AS unit FROM part UNION ALL SELECT DISTINCT 'brand.' || p_brand, 'type.' || (length(p_brand) * 7 + ascii(right(p_brand, 1))) % 6, CASE WHEN p_brand < 'Brand#2' THEN 'adet' END FROM part "
    "UNION ALL SELECT 'type.' || k, CASE k WHEN 0 THEN NULL WHEN 4 THEN 'type.5' WHEN 5 THEN 'type.4' ELSE 'type.' || (k - 1) END, NULL FROM range(6) t(k))"
)


@query(f"WITH RECURSIVE {_TREE}, up(id, here, depth, unit, seen) AS (SELECT id, id, 0, unit, [id] FROM tree UNION ALL SELECT up.id, t.parent, depth + 1, coalesce(up.unit, p.unit), list_append(seen, t.parent) FROM up JOIN tree t ON t.id = up.here LEFT JOIN tree p ON p.id = t.parent WHERE t.parent IS NOT NULL AND NOT list_contains(seen, t.parent)) SELECT id, here AS root, depth::INT AS depth, unit FROM up QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth DESC) = 1")
def src_hier_index(spark, sf):
    """Parts in brands in types, types in types, of which two point at each other: the topic of each node, and the unit of the nearest that has one."""
    part = lake.table(spark, sf, "part").select("p_partkey", "p_brand")
    none = F.lit(None).cast("string")
    brands = part.select("p_brand").distinct()
    kind = (F.length("p_brand") * 7 + F.ascii(F.right("p_brand", F.lit(1)))) % 6
    k = F.col("id")
    types = spark.range(6).select(F.concat(F.lit("type."), k), F.when(k == 4, "type.5").when(k == 5, "type.4").when(k > 0, F.concat(F.lit("type."), k - 1)), none)
    tree = part.select(F.concat(F.lit("part."), "p_partkey").alias("id"), F.concat(F.lit("brand."), "p_brand").alias("parent"), none.alias("unit"))
    tree = tree.union(brands.select(F.concat(F.lit("brand."), "p_brand"), F.concat(F.lit("type."), kind), F.when(F.col("p_brand") < "Brand#2", "adet"))).union(types)
    return climb(tree)


def climb(tree: DataFrame, most: int = 64) -> DataFrame:
    """(id, root, depth, unit) of tree (id, parent, unit): parents are climbed until there is none or one comes again; unit is the nearest on the way. All nodes climb a step together; more than most steps are an error."""
    links = tree.where("parent IS NOT NULL").select(F.col("id").alias("at"), "parent")
    units = tree.where("unit IS NOT NULL").select(F.col("id").alias("parent"), F.col("unit").alias("above"))
    now = tree.select("id", F.col("id").alias("at"), F.lit(0).alias("depth"), "unit", F.array("id").alias("seen"), F.lit(True).alias("open"))
    for _ in range(most):
        step = now.join(links, "at", "left").join(units, "parent", "left")
        on = F.col("open") & F.col("parent").isNotNull() & ~F.array_contains("seen", F.col("parent"))
        step = step.withColumn("open", F.coalesce(on, F.lit(False)))
        now = step.select(
            "id", F.when(F.col("open"), F.col("parent")).otherwise(F.col("at")).alias("at"), (F.col("depth") + F.col("open").cast("int")).alias("depth"), F.when(F.col("open"), F.coalesce("unit", "above")).otherwise(F.col("unit")).alias("unit"),
            F.when(F.col("open"), F.concat("seen", F.array("parent"))).otherwise(F.col("seen")).alias("seen"), "open",
        )
        now = store.cut(now, "climb")
        if now.where("open").isEmpty():
            return now.select("id", F.col("at").alias("root"), "depth", "unit")
    raise RuntimeError(f"a node is more than {most} steps from its root")


@query(
    "WITH ends AS (SELECT l_partkey, max(CAST(l_shipdate AS DATE)) AS last FROM lineitem GROUP BY 1), far AS (SELECT max(last) AS far FROM ends), c AS (SELECT p_partkey, p_brand, p_type, ['M', 'W', 'Q', 'D'][p_partkey % 4 + 1] AS freq, last, far, p_partkey IN (5, 17, 33) AS pinned, "
    "(contains(lower(p_name), 'a'))::INT + (contains(lower(p_type), 'steel'))::INT + (contains(lower(p_name), 'ring'))::INT + (p_size > 25)::INT AS score, p_size FROM part LEFT JOIN ends ON l_partkey = p_partkey, far), "
    "ok AS (SELECT * FROM c WHERE pinned OR (p_type <> 'PROMO' AND p_size % 9 <> 0 AND last >= far - CASE freq WHEN 'D' THEN 200 WHEN 'W' THEN 300 WHEN 'M' THEN 400 ELSE 900 END)), "
    "used AS (SELECT p_brand, count(*) FILTER (pinned) AS u FROM ok GROUP BY 1), k AS (SELECT ok.*, u, row_number() OVER (PARTITION BY p_brand, pinned ORDER BY score DESC, p_partkey) AS k FROM ok JOIN used USING (p_brand)) "
    "SELECT p_partkey, p_brand, score, pinned FROM (SELECT *, row_number() OVER (ORDER BY pinned DESC, score DESC, p_partkey) AS pos FROM k WHERE pinned OR k <= 8 - u) WHERE pos <= 100"
)
def sel_series_score(spark, sf):
    """Parts that are not archived, have a known unit and are shipped until near the end (by their frequency), scored by terms; pinned ones first, of each brand eight at most, 100 in all."""
    ends = lake.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max(F.col("l_shipdate").cast("date")).alias("last"))
    far = ends.agg(F.max("last").alias("far"))  # one row
    k, has = F.col("p_partkey"), lambda c, w: F.contains(F.lower(c), F.lit(w)).cast("int")
    x = lake.table(spark, sf, "part").join(ends, "p_partkey", "left").crossJoin(F.broadcast(far))
    x = x.withColumn("pinned", k.isin(5, 17, 33)).withColumn("score", has("p_name", "a") + has("p_type", "steel") + has("p_name", "ring") + (F.col("p_size") > 25).cast("int"))
    freq = F.get(F.array(*map(F.lit, "MWQD")), (k % 4).cast("int"))
    grace = F.when(freq == "D", 200).when(freq == "W", 300).when(freq == "M", 400).otherwise(900)
    current = (F.col("p_type") != "PROMO") & (F.col("p_size") % 9 != 0) & (F.date_diff("far", "last") <= grace)
    return capped(x.where(F.col("pinned") | current), "p_brand", "p_partkey", 8, 100).select("p_partkey", "p_brand", "score", "pinned")


def capped(x: DataFrame, group: str, key: str, most: int, room: int) -> DataFrame:
    """Pinned rows, then those with the greatest score, ties to the smaller key: of each group at most most, pinned ones counted, room in all. A greedy choice under a cap by group is each group's best, then the best of these."""
    used = x.groupBy(group).agg(F.count_if("pinned").alias("__used"))
    by = Window.partitionBy(group).orderBy(F.desc("score"), key)
    free = x.where(~F.col("pinned")).withColumn("__k", F.row_number().over(by)).where(F.col("__k") <= most)
    free = free.join(used, group).where(F.col("__k") <= most - F.col("__used")).drop("__k", "__used")
    return x.where("pinned").unionByName(free).orderBy(F.desc("pinned"), F.desc("score"), key).limit(room)


# ---- filters


@query(SQL + "SELECT series_id FROM catalog WHERE family = 'flow' AND measure_type = 'flow' AND province = 'NATION_19'")
def flt_facets_exact(spark, sf):
    return facets_exact(lake.catalog(spark, sf), family="flow", measure_type="flow", province="NATION_19", native_freq=None).select("series_id")


def facets_exact(catalog: DataFrame, **facets) -> DataFrame:
    """Rows that equal every facet that isn't None."""
    for k, v in facets.items():
        if v is not None:
            catalog = catalog.where(F.col(k) == v)
    return catalog


@query(SQL + "SELECT series_id, CASE WHEN cumulative_mode = 'ambiguous' THEN 'ambiguous' WHEN measure_type = 'unknown' THEN 'unknown measure' WHEN unit = '' THEN 'no unit' ELSE '' END AS reason FROM catalog")
def flt_servable(spark, sf):
    reason = F.when(F.col("cumulative_mode") == "ambiguous", "ambiguous").when(F.col("measure_type") == "unknown", "unknown measure").when(F.col("unit") == "", "no unit").otherwise("")
    return lake.catalog(spark, sf).select("series_id", reason.alias("reason"))


@query(SQL + "SELECT series_id FROM catalog WHERE measure_type = 'stock' AND (province IS NOT DISTINCT FROM 'NATION_19' OR NOT EXISTS (SELECT 1 FROM catalog c WHERE c.measure_type = 'stock' AND c.province IS NOT NULL))")
def flt_facets_fallback(spark, sf):
    """A facet that no row of the concept has is skipped; a null province is a value."""
    any_of = F.bool_or(F.col("province").isNotNull()).over(Window.partitionBy("measure_type"))
    x = lake.catalog(spark, sf).where("measure_type = 'stock'").withColumn("known", any_of)
    return x.where(~F.col("known") | F.col("province").eqNullSafe("NATION_19")).select("series_id")


@query(SQL + "SELECT series_id, CASE WHEN unit = 'adet' THEN 'count' WHEN statement_kind = 'ratio' THEN 'ratio' WHEN unit = '%' THEN 'rate' WHEN statement_kind = 'income_statement' THEN 'flow' WHEN statement_kind IN ('balance_sheet', 'off_balance_sheet') THEN 'stock' ELSE 'unknown' END AS measure FROM catalog")
def prj_measure_bddk(spark, sf):
    return lake.catalog(spark, sf).select("series_id", bronze.measure_of(F.col("statement_kind"), F.col("unit")).alias("measure"))


@query(SQL + "SELECT series_id, CASE measure_type WHEN 'flow' THEN 'sum' WHEN 'rate' THEN 'mean' ELSE 'last' END AS rule FROM catalog")
def prj_agg_rule(spark, sf):
    return lake.catalog(spark, sf).select("series_id", F.when(F.col("measure_type") == "flow", "sum").when(F.col("measure_type") == "rate", "mean").otherwise("last").alias("rule"))


# ---- joins


@query(SQL + ", spine AS (SELECT CAST(p AS DATE) AS period FROM range(TIMESTAMP '1994-06-01', TIMESTAMP '2002-01-01', INTERVAL 1 MONTH) t(p)) SELECT period, round(value, 6) AS france FROM spine LEFT JOIN (SELECT * FROM flow WHERE series_id = 'flow.NATION_19') USING (period)")
def jn_spine_left(spark, sf):
    return al.spine_join(months(spark, "1994-06-01", "2001-12-01"), lake.flow(spark, sf).where("series_id = 'flow.NATION_19'"), "france").withColumn("france", F.round("france", 6))


def months(spark, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.expr(f"sequence(DATE '{start}', DATE '{end}', INTERVAL 1 MONTH)")).alias("period"))


@query(SQL + ", spine AS (SELECT CAST(p AS DATE) AS period FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '1999-01-01', INTERVAL 1 MONTH) t(p)) SELECT period, round(a.value, 6) AS france, round(b.value, 6) AS price FROM spine LEFT JOIN (SELECT * FROM flow WHERE series_id = 'flow.NATION_19') a USING (period) LEFT JOIN price b USING (period)")
def jn_multi_atomic(spark, sf):
    obs = lake.flow(spark, sf).unionByName(lake.price_index(spark, sf))
    out = al.join_series(months(spark, "1995-01-01", "1998-12-01"), obs, {"france": "flow.NATION_19", "price": "index.price"})
    return out.select("period", F.round("france", 6).alias("france"), F.round("price", 6).alias("price"))


@query(SQL + ", a AS (SELECT period, value FROM flow WHERE series_id = 'flow.NATION_19'), b AS (SELECT period, value FROM price) SELECT period, round(a.value, 6) AS a, round(b.value, 6) AS b FROM a FULL JOIN b USING (period)")
def jn_align_union_spine(spark, sf):
    a, b = lake.flow(spark, sf).where("series_id = 'flow.NATION_19'"), lake.price_index(spark, sf)
    spine = a.select("period").union(b.select("period")).distinct()
    out = al.spine_join(al.spine_join(spine, a, "a"), b, "b")
    return out.select("period", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query(SQL + "SELECT family, native_freq, count(*) AS n FROM observations JOIN (SELECT series_id, native_freq FROM catalog) USING (series_id) GROUP BY ALL")
def jn_cat_obs(spark, sf):
    return lake.observations(spark, sf).join(lake.families(spark), "family").groupBy("family", "native_freq").agg(F.count("*").alias("n"))


@query(SQL + "SELECT j.series_id, year(j.period)::INT AS year, round(j.value, 6) AS jan, round(d.value, 6) AS dec FROM ytd j JOIN ytd d ON j.series_id = d.series_id AND year(d.period) = year(j.period) - 1 WHERE month(j.period) = 1 AND month(d.period) = 12")
def jn_jan_dec(spark, sf):
    x = lake.ytd(spark, sf)
    j = x.where(F.month("period") == 1).select("series_id", F.year("period").alias("year"), F.round("value", 6).alias("jan"))
    d = x.where(F.month("period") == 12).select("series_id", (F.year("period") + 1).alias("year"), F.round("value", 6).alias("dec"))
    return j.join(d, ["series_id", "year"])


@query(SQL + "SELECT a.period, round(a.value, 6) AS x, round(b.value, 6) AS y FROM flow a JOIN price b USING (period) WHERE a.series_id = 'flow.NATION_19'")
def jn_shared_dates(spark, sf):
    a, b = lake.flow(spark, sf).where("series_id = 'flow.NATION_19'"), lake.price_index(spark, sf)
    return a.select("period", F.round("value", 6).alias("x")).join(b.select("period", F.round("value", 6).alias("y")), "period")


@query(SQL + "SELECT min(period) AS first_period, max(period) AS last_period, round(arg_min(x, period), 6) AS first_x, round(arg_max(y, period), 6) AS last_y FROM (SELECT a.period, a.value AS x, b.value AS y FROM flow a JOIN price b USING (period) WHERE a.series_id = 'flow.NATION_19') WHERE x IS NOT NULL AND y IS NOT NULL")
def jn_common_obs(spark, sf):
    a, b = lake.flow(spark, sf).where("series_id = 'flow.NATION_19'"), lake.price_index(spark, sf)
    x = a.select("period", F.col("value").alias("x")).join(b.select("period", F.col("value").alias("y")), "period").dropna(subset=["x", "y"])
    return x.agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.round(F.min_by("x", "period"), 6).alias("first_x"), F.round(F.max_by("y", "period"), 6).alias("last_y"))


PARTS = SQL + (
    ", parent AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS whole FROM orders GROUP BY 1), "
    "child AS (SELECT period, nation, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM facts GROUP BY ALL), "
    "whole AS (SELECT p.period, whole, CASE WHEN k = (SELECT count(*) FROM nation) THEN parts END AS parts FROM parent p LEFT JOIN (SELECT period, count(*) AS k, CAST(SUM(v) AS DOUBLE) AS parts FROM child GROUP BY 1) USING (period)) "
)


def _parts(spark, sf) -> DataFrame:
    """Each month's orders as they are stored against the sum of the nations', which went through the joins with customers, nations and regions."""
    whole = lake.table(spark, sf, "orders").groupBy(lake.month("o_orderdate").alias("period")).agg(lake.money("o_totalprice").alias("whole"))
    part = lake.order_facts(spark, sf).groupBy("period", F.col("nation").alias("part")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    return gates.whole_and_parts(whole, part, lake.table(spark, sf, "nation"))


@query(PARTS + "SELECT period, round(whole, 2) AS whole, round(parts, 2) AS parts FROM whole")
def jn_parent_children(spark, sf):
    """A whole against the sum of its parts; no sum where a part is missing."""
    return _parts(spark, sf).select("period", F.round("whole", 2).alias("whole"), F.round("parts", 2).alias("parts"))


@query(SQL + ", x AS (SELECT a.series_id, b.value / a.value AS r FROM flow a JOIN ytd b ON substr(a.series_id, 6) = substr(b.series_id, 5) AND a.period = b.period WHERE a.value <> 0) SELECT series_id, pow(10.0, round(log10(median(r)))) AS scale, count(*) AS n FROM x GROUP BY 1")
def jn_two_publishers(spark, sf):
    a = lake.flow(spark, sf).where("value <> 0").select(F.substring("series_id", 6, 99).alias("k"), "series_id", "period", F.col("value").alias("a"))
    b = lake.ytd(spark, sf).select(F.substring("series_id", 5, 99).alias("k"), "period", F.col("value").alias("b"))
    x = a.join(b, ["k", "period"]).groupBy("series_id")
    return x.agg(numeric.power10(F.median(F.col("b") / F.col("a"))).alias("scale"), F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) GROUP BY 1")
def jn_rank_semi(spark, sf):
    big = lake.table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return lake.table(spark, sf, "customer").join(big, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query(SQL + "SELECT CAST(p AS DATE) AS period FROM range(TIMESTAMP '1994-06-01', TIMESTAMP '2002-01-01', INTERVAL 1 MONTH) t(p) WHERE CAST(p AS DATE) NOT IN (SELECT period FROM flow)")
def jn_missing_anti(spark, sf):
    return months(spark, "1994-06-01", "2001-12-01").join(lake.flow(spark, sf).select("period"), "period", "left_anti")


# ---- aggregations


@query(SQL + "SELECT family AS concept, count(*) AS n, array_to_string(list_sort(list_distinct(list(measure_type))), ' ') AS measures, array_to_string(list_sort(list_distinct(list(native_freq))), ' ') AS freqs, bool_or(province IS NOT NULL) AS by_province, sum(nonzero) > 0 AS has_data FROM catalog GROUP BY 1")
def agg_concepts(spark, sf):
    x = lake.catalog(spark, sf).groupBy(F.col("family").alias("concept"))
    s = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " ")
    return x.agg(F.count("*").alias("n"), s("measure_type").alias("measures"), s("native_freq").alias("freqs"), F.bool_or(F.col("province").isNotNull()).alias("by_province"), (F.sum("nonzero") > 0).alias("has_data"))


@query(SQL + "SELECT family, measure_type, cumulative_mode, native_freq, count(*) AS n FROM catalog GROUP BY GROUPING SETS ((family), (measure_type), (cumulative_mode), (native_freq))")
def agg_distribution(spark, sf):
    x, keys = lake.catalog(spark, sf), ["family", "measure_type", "cumulative_mode", "native_freq"]
    return x.groupingSets([[F.col(k)] for k in keys], *keys).agg(F.count("*").alias("n"))


@query(SQL + "SELECT count(*) AS n, count(DISTINCT family) AS families, count(DISTINCT province) AS provinces, count(DISTINCT native_freq) AS freqs FROM catalog WHERE measure_type = 'flow'")
def agg_facet_counts(spark, sf):
    return lake.catalog(spark, sf).where("measure_type = 'flow'").agg(F.count("*").alias("n"), F.countDistinct("family").alias("families"), F.countDistinct("province").alias("provinces"), F.countDistinct("native_freq").alias("freqs"))


DECUM = SQL + ", own AS (SELECT series_id, period, CASE WHEN row_number() OVER w = 1 THEN value ELSE value - lag(value) OVER w END AS value, value AS value_reported FROM ytd WINDOW w AS (PARTITION BY series_id, year(period) ORDER BY period)) "


@query(DECUM + "SELECT series_id, period, round(value, 4) AS value, round(value_reported, 4) AS value_reported FROM own")
def win_decumulate_ytd(spark, sf):
    return acc.decumulate(lake.ytd(spark, sf)).select("series_id", "period", F.round("value", 4).alias("value"), F.round("value_reported", 4).alias("value_reported"))


@query(SQL + "SELECT series_id, period, value - lag(value) OVER w AS value, value AS value_reported FROM stock WINDOW w AS (PARTITION BY series_id ORDER BY period)")
def win_decumulate_inception(spark, sf):
    return acc.decumulate(lake.stock(spark, sf), "inception")


@query(SQL + "SELECT series_id, period, round(value, 4) AS value, round(value, 4) AS value_reported FROM flow")
def win_decumulate_none(spark, sf):
    """What doesn't accumulate passes; what is ambiguous is refused (operators.accumulation.Ambiguous)."""
    return acc.decumulate(lake.flow(spark, sf), "none").select("series_id", "period", F.round("value", 4).alias("value"), F.round("value_reported", 4).alias("value_reported"))


CLOSE = DECUM + ", closed AS (SELECT series_id, year(period)::INT AS year, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, max(CASE WHEN month(period) = 12 THEN value_reported END) AS december, count(value) AS n FROM own GROUP BY ALL HAVING december IS NOT NULL AND abs(december) > 1 AND n = 12) "


@query(CLOSE + "SELECT series_id, year, round(total, 4) AS total, round(december, 4) AS december, abs(total - december) <= 0.005 * abs(december) AS closes FROM closed")
def agg_ytd_closure(spark, sf):
    x = acc.closure(acc.decumulate(lake.ytd(spark, sf)))
    return x.select("series_id", "year", F.round("total", 4).alias("total"), F.round("december", 4).alias("december"), "closes")


@query(SQL + "SELECT series_id, min(value) AS lowest FROM observations WHERE value < 100 GROUP BY 1")
def agg_negative_counts(spark, sf):
    return lake.observations(spark, sf).where("value < 100").groupBy("series_id").agg(F.min("value").alias("lowest"))


RESET = SQL + ", jd AS (SELECT j.series_id, j.value AS jan, d.value AS dec FROM ytd j JOIN ytd d ON j.series_id = d.series_id AND year(d.period) = year(j.period) - 1 WHERE month(j.period) = 1 AND month(d.period) = 12), r AS (SELECT series_id, sum(CASE WHEN dec > 0 AND jan <= dec * 0.5 THEN 1 ELSE 0 END)::BIGINT AS resets, count(*) AS chances FROM jd GROUP BY 1) "


@query(RESET + "SELECT series_id, resets, chances FROM r")
def agg_reset_ratio(spark, sf):
    x = jn_jan_dec(spark, sf).groupBy("series_id")
    return x.agg(F.sum(F.when((F.col("dec") > 0) & (F.col("jan") <= F.col("dec") * 0.5), 1).otherwise(0)).alias("resets"), F.count("*").alias("chances"))


CLASSIFY = SQL + """, mixed AS (SELECT * FROM ytd UNION ALL SELECT * FROM flow UNION ALL SELECT * FROM stock),
steps AS (SELECT *, year(period) AS y, value >= lag(value) OVER (PARTITION BY series_id, year(period) ORDER BY period) AS up, value >= lag(value) OVER (PARTITION BY series_id ORDER BY period) AS up_all FROM mixed WHERE value IS NOT NULL),
years AS (SELECT series_id, y, count(*) AS n, bool_and(up) AS up, bool_and(up_all) AS up_all, max(value) FILTER (month(period) = 1) AS jan, max(value) FILTER (month(period) = 12) AS dec FROM steps GROUP BY ALL),
marks AS (SELECT a.*, a.jan IS NOT NULL AND coalesce(b.dec > 0, FALSE) AS chance, a.jan IS NOT NULL AND coalesce(b.dec > 0 AND a.jan <= 0.5 * b.dec, FALSE) AS reset FROM years a LEFT JOIN years b ON a.series_id = b.series_id AND b.y = a.y - 1),
sums AS (SELECT series_id, sum(n)::BIGINT AS n, count(*) FILTER (chance) AS c, count(*) FILTER (reset) AS r, count(*) FILTER (n >= 2) AS ys, count(*) FILTER (n >= 2 AND up) AS ms, bool_and(up_all) AS mono FROM marks GROUP BY 1)
"""


@query(CLASSIFY + "SELECT series_id, n, c AS opportunities, r AS resets, CASE WHEN n < 13 THEN 'ambiguous' WHEN c > 0 AND r >= 0.6 * c THEN CASE WHEN ms >= greatest(1, ys - 2) THEN 'ytd' ELSE 'ambiguous' END WHEN mono THEN 'ambiguous' ELSE 'none' END AS mode FROM sums")
def win_classify_mode(spark, sf):
    both = lake.ytd(spark, sf).unionByName(lake.flow(spark, sf)).unionByName(lake.stock(spark, sf))
    return acc.classify(both).select("series_id", "n", "opportunities", "resets", "mode")


@query(CLASSIFY + ", m AS (SELECT series_id, CASE WHEN n < 13 THEN 'ambiguous' WHEN c > 0 AND r >= 0.6 * c THEN CASE WHEN ms >= greatest(1, ys - 2) THEN 'ytd' ELSE 'ambiguous' END WHEN mono THEN 'ambiguous' ELSE 'none' END AS mode, CASE WHEN series_id LIKE 'stock%' THEN 'balance_sheet' ELSE 'income_statement' END AS statement_kind, CASE WHEN series_id LIKE '%2' THEN ' Dönem NET Karı (Zararı)' ELSE series_id END AS label FROM sums) SELECT series_id, mode, CASE WHEN mode <> 'ambiguous' THEN mode WHEN statement_kind = 'income_statement' OR lower(trim(label)) = 'dönem net karı (zararı)' THEN 'ytd' ELSE 'none' END AS resolved, CASE WHEN mode <> 'ambiguous' THEN 'pattern' ELSE 'statement' END AS verified_by FROM m")
def prj_statement_mode(spark, sf):
    x = win_classify_mode(spark, sf).withColumn("statement_kind", F.when(F.startswith("series_id", F.lit("stock")), "balance_sheet").otherwise("income_statement"))
    x = x.withColumn("label", F.when(F.endswith("series_id", F.lit("2")), " Dönem NET Karı (Zararı)").otherwise(F.col("series_id")))  # a profit line of the balance sheet
    return acc.resolve_by_statement(x).select("series_id", "mode", "resolved", "verified_by")


@query(SQL + "SELECT series_id, CAST(date_trunc('quarter', period) AS DATE) AS period, round(CASE aggregation_rule WHEN 'sum' THEN sum(value) WHEN 'mean' THEN avg(value) ELSE arg_max(value, period) END, 4) AS value FROM observations JOIN families USING (family) GROUP BY series_id, aggregation_rule, CAST(date_trunc('quarter', period) AS DATE)")
def agg_collapse(spark, sf):
    return al.collapse(lake.observations(spark, sf).join(lake.families(spark), "family"), "Q").select("series_id", "period", F.round("value", 4).alias("value"))


@query("SELECT 'events.' || event_type AS series_id, CAST(CAST(ts AS DATE) + CAST((7 - isodow(ts)) % 7 AS INTEGER) AS DATE) AS period, round(avg(value), 6) AS value FROM events GROUP BY ALL")
def win_collapse(spark, sf):
    x = lake.table(spark, sf, "events").select(F.concat(F.lit("events."), "event_type").alias("series_id"), F.col("ts").cast("date").alias("period"), "value", F.lit("mean").alias("aggregation_rule"))
    return al.collapse(x, "W", native="D").select("series_id", "period", F.round("value", 6).alias("value"))


@query(SQL + ", q AS (SELECT series_id, CAST(date_trunc('quarter', period) AS DATE) AS period, CASE aggregation_rule WHEN 'sum' THEN sum(value) WHEN 'mean' THEN avg(value) ELSE arg_max(value, period) END AS value FROM observations JOIN families USING (family) GROUP BY series_id, aggregation_rule, CAST(date_trunc('quarter', period) AS DATE)), e AS (SELECT series_id, max(period) AS e FROM q WHERE value IS NOT NULL GROUP BY 1) SELECT series_id, period, round(value, 4) AS value, e = (SELECT min(e) FROM e) AS forced FROM q JOIN e USING (series_id) WHERE value IS NOT NULL AND period <= (SELECT min(e) FROM e)")
def win_align(spark, sf):
    x = al.align(lake.observations(spark, sf).join(lake.families(spark), "family"), "Q")
    return x.withColumn("value", F.round("value", 4))


GAPS = SQL + ", g AS (SELECT series_id, date_diff('day', lag(period) OVER (PARTITION BY series_id ORDER BY period), period) AS gap FROM (SELECT DISTINCT series_id, period FROM observations)) "


@query(GAPS + ", s AS (SELECT series_id, list_sort(list_distinct(list(gap) FILTER (gap IS NOT NULL))) AS g FROM g GROUP BY 1) SELECT series_id, g[len(g) // 2 + 1]::INT AS median_gap, CASE WHEN len(g) = 0 THEN 'M' WHEN g[len(g) // 2 + 1] <= 3 THEN 'D' WHEN g[len(g) // 2 + 1] <= 10 THEN 'W' WHEN g[len(g) // 2 + 1] <= 45 THEN 'M' ELSE 'Q' END AS frequency FROM s")
def agg_spine_freq(spark, sf):
    return al.infer_frequency(lake.observations(spark, sf))


@query(GAPS + ", s AS (SELECT series_id, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS g FROM g GROUP BY 1), m AS (SELECT series_id, g[len(g) // 2 + 1] AS m FROM s) SELECT series_id, CASE WHEN m BETWEEN 25 AND 35 THEN 'monthly' WHEN m BETWEEN 6 AND 8 THEN 'weekly' WHEN m BETWEEN 1 AND 5 THEN 'daily' ELSE 'unknown' END AS frequency FROM m")
def agg_obs_freq(spark, sf):
    return al.observed_frequency(lake.observations(spark, sf))


@query(
    SQL + ", d AS (SELECT DISTINCT 'events.' || event_type || k AS series_id, CAST(ts AS DATE) AS period, 'D' AS f FROM events, (VALUES ('', 1), ('.workdays', 6), ('.odd', 2)) v(k, m) WHERE m = 1 OR (m = 6 AND isodow(ts) < 6) OR (m = 2 AND day(ts) NOT IN (11, 12, 13))), "
    "a AS (SELECT series_id, period, 'M' AS f FROM flow UNION ALL SELECT series_id, period, 'W' FROM rate UNION ALL SELECT series_id || '.torn', period, 'W' FROM rate WHERE week(period) <> 9 UNION ALL SELECT series_id, period, 'Q' FROM parts UNION ALL SELECT * FROM d), "
    "s AS (SELECT *, lag(period) OVER (PARTITION BY series_id ORDER BY period) AS p FROM a) "
    "SELECT series_id, coalesce(bool_and(CASE WHEN p IS NULL THEN NULL WHEN f = 'M' THEN p = period - INTERVAL 1 MONTH WHEN f = 'W' THEN period - p = 7 WHEN f = 'D' THEN period - p BETWEEN 1 AND 3 ELSE p = period - INTERVAL 3 MONTH END), TRUE) AS contiguous FROM s GROUP BY 1"
)
def win_contiguous(spark, sf):
    """Series of all frequencies: months, weeks (and a copy that misses some), quarters, days, working days, and days of which some are missing."""
    of = lambda x, f, tail="": x.select(F.concat("series_id", F.lit(tail)).alias("series_id"), "period", F.lit(f).alias("f"))
    rate = lake.weekly_rate(spark, sf)
    day = lake.table(spark, sf, "events").select(F.concat(F.lit("events."), "event_type").alias("series_id"), F.col("ts").cast("date").alias("period")).distinct()
    x = of(lake.flow(spark, sf), "M").union(of(rate, "W")).union(of(rate.where("weekofyear(period) <> 9"), "W", ".torn")).union(of(lake.quarterly_count(spark, sf), "Q"))
    x = x.union(of(day, "D")).union(of(day.where("weekday(period) < 5"), "D", ".workdays")).union(of(day.where("day(period) NOT IN (11, 12, 13)"), "D", ".odd"))
    return al.contiguous(x, F.col("f"))


@query(SQL + "SELECT series_id, count(*) = 60 AS complete FROM flow WHERE period BETWEEN DATE '1996-01-01' AND DATE '2000-12-01' GROUP BY 1")
def win_complete_spine(spark, sf):
    want = F.expr("sequence(DATE '1996-01-01', DATE '2000-12-01', INTERVAL 1 MONTH)")
    x = lake.flow(spark, sf).where("period BETWEEN DATE '1996-01-01' AND DATE '2000-12-01'")
    return x.groupBy("series_id").agg((F.array_sort(F.collect_set("period")) == want).alias("complete"))


@query(SQL + "SELECT series_id, count(*) FILTER (value IS NULL) AS missing FROM observations GROUP BY 1")
def agg_missing(spark, sf):
    return lake.observations(spark, sf).groupBy("series_id").agg(F.count_if(F.col("value").isNull()).alias("missing"))


@query(SQL + "SELECT series_id, count(*) AS n, min(period) AS lo, max(period) AS hi, count(*) FILTER (value <> 0) AS nonzero FROM observations GROUP BY 1")
def agg_coverage(spark, sf):
    return lake.observations(spark, sf).groupBy("series_id").agg(F.count("*").alias("n"), F.min("period").alias("lo"), F.max("period").alias("hi"), F.count_if(F.col("value") != 0).alias("nonzero"))


@query(SQL + ", c(frame, family) AS (VALUES ('both', 'flow'), ('both', 'stock'), ('one', 'flow'), ('empty', 'none'), ('one usable', 'rate'), ('one usable', 'none')), m AS (SELECT frame, c.family, median(abs(value)) FILTER (value <> 0) AS m FROM c LEFT JOIN observations o USING (family) GROUP BY ALL) SELECT frame, CASE WHEN count(m) >= 2 THEN round(max(m) / min(m), 3) END AS ratio, count(m) AS n FROM m GROUP BY 1")
def agg_median_magnitude(spark, sf):
    """How far apart the columns of a frame are in size, by their medians; none with fewer than two columns that have figures."""
    frames = spark.createDataFrame([("both", "flow"), ("both", "stock"), ("one", "flow"), ("empty", "none"), ("one usable", "rate"), ("one usable", "none")], "frame string, family string")
    m = lake.observations(spark, sf).where("value <> 0").groupBy("family").agg(F.median(F.abs("value")).alias("m"))
    own = F.broadcast(frames).join(m, "family", "left").groupBy("frame")
    return own.agg(F.when(F.count("m") >= 2, F.round(F.max("m") / F.min("m"), 3)).alias("ratio"), F.count("m").alias("n"))


@query(SQL + "SELECT series_id, round(median(value), 6) AS median, round(mad(value), 6) AS mad FROM flow GROUP BY 1")
def agg_mad(spark, sf):
    x = lake.flow(spark, sf)
    mid = x.groupBy("series_id").agg(F.median("value").alias("m"))
    return x.join(mid, "series_id").groupBy("series_id").agg(F.round(F.first("m"), 6).alias("median"), F.round(F.median(F.abs(F.col("value") - F.col("m"))), 6).alias("mad"))


_SHORT = SQL + ", o AS (SELECT * FROM flow UNION ALL SELECT 'two.' || series_id, period, value FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period) AS k FROM flow) WHERE k <= 2 UNION ALL SELECT 'flat.' || series_id, period, 7.0 FROM flow) "


def _with_short(spark, sf) -> DataFrame:
    """The flows, with a copy of the first two observations of each, and one without variance."""
    x = lake.flow(spark, sf)
    two = x.withColumn("k", F.row_number().over(acc.own())).where("k <= 2").select(F.concat(F.lit("two."), "series_id"), "period", "value")
    return x.union(two).union(x.select(F.concat(F.lit("flat."), "series_id"), "period", F.lit(7.0)))


@query(_SHORT + ", d AS (SELECT series_id, value, value - lag(value) OVER (PARTITION BY series_id ORDER BY period) AS d FROM o) SELECT series_id, CASE WHEN count(value) < 3 OR var_pop(value) = 0 THEN 1.0 ELSE round(var_pop(value) * 3 * ln(count(*)) / 1e6, 2) END AS level_penalty, CASE WHEN count(d) < 3 OR var_pop(d) = 0 THEN 1.0 ELSE round(var_pop(d) * 3 * ln(count(*)) / 1e6, 2) END AS trend_penalty FROM d GROUP BY 1")
def agg_pvariance(spark, sf):
    """Penalties of a further segment (here in millions): the variance of levels and of steps by three logarithms of the length, but 1 below three observations or without variance."""
    x = _with_short(spark, sf).withColumn("d", F.col("value") - F.lag("value").over(acc.own())).groupBy("series_id")
    floor = lambda c: F.when((F.count(c) < 3) | (F.var_pop(c) == 0), 1.0).otherwise(F.round(F.var_pop(c) * 3 * F.log(F.count("*")) / 1e6, 2))
    return x.agg(floor("value").alias("level_penalty"), floor("d").alias("trend_penalty"))


_CHANGES = {"added": ("labels", "before"), "removed": ("before", "labels")}


@query(
    SQL + ", s AS (SELECT region, period, list_sort(list_distinct(list(nation))) AS labels, count(*) AS n FROM facts WHERE o_totalprice > 250000 GROUP BY ALL), "
    "w AS (SELECT *, lag(labels) OVER (PARTITION BY region ORDER BY period) AS before, n - lag(n) OVER (PARTITION BY region ORDER BY period) AS change FROM s) SELECT region, period, change, "
    + ", ".join(f"CASE WHEN before IS NOT NULL THEN len(list_filter({a}, lambda x: NOT list_contains({b}, x) AND {c} regexp_matches(x, '[05]$')))::INT END AS {k}_{name}" for k, (a, b) in _CHANGES.items() for name, c in (("known", ""), ("new", "NOT")))
    + " FROM w"
)
def agg_schema_drift(spark, sf):
    """From one month of a region to the next: rows, and labels that came and went, those that are acknowledged (names on 0 or 5) apart from new ones."""
    s = lake.order_facts(spark, sf).where("o_totalprice > 250000").groupBy("region", "period").agg(F.array_sort(F.collect_set("nation")).alias("labels"), F.count("*").alias("n"))
    by = Window.partitionBy("region").orderBy("period")
    s = s.withColumn("before", F.lag("labels").over(by)).withColumn("change", F.col("n") - F.lag("n").over(by))
    known = lambda x: x.rlike("[05]$")
    out = []
    for k, (a, b) in _CHANGES.items():
        moved = F.array_except(a, b)
        out += [F.when(F.col("before").isNotNull(), F.size(F.filter(moved, f))).alias(f"{k}_{name}") for name, f in (("known", known), ("new", lambda x: ~known(x)))]
    return s.select("region", "period", "change", *out)


@query("SELECT p_brand, count(DISTINCT p_size % 3) AS units FROM part GROUP BY 1 HAVING count(DISTINCT p_size % 3) > 1")
def agg_unit_change(spark, sf):
    return lake.table(spark, sf, "part").groupBy("p_brand").agg(F.countDistinct(F.col("p_size") % 3).alias("units")).where("units > 1")


# ---- windows


@query(SQL + ", p AS (SELECT period, value, row_number() OVER (ORDER BY period) AS pos, row_number() OVER (ORDER BY period) - row_number() OVER (PARTITION BY value > 1500 ORDER BY period) AS grp FROM price) SELECT min(period) AS start, max(period) AS stop, count(*) AS n FROM p WHERE value > 1500 GROUP BY grp")
def win_segments(spark, sf):
    """Runs of consecutive positions that have a value (here: above a bound)."""
    x = lake.price_index(spark, sf).withColumn("own", F.col("value") > 1500).withColumn("pos", F.row_number().over(acc.own()))
    x = x.withColumn("grp", F.col("pos") - F.row_number().over(Window.partitionBy("series_id", "own").orderBy("period")))
    return x.where("own").groupBy("series_id", "grp").agg(F.min("period").alias("start"), F.max("period").alias("stop"), F.count("*").alias("n")).select("start", "stop", "n")


@query(_SHORT + ", p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY value DESC, period) AS k, max(period) OVER (PARTITION BY series_id) AS last, count(*) OVER (PARTITION BY series_id) AS n FROM o) SELECT p.series_id, p.period AS peak, p.last FROM p JOIN o f ON f.series_id = p.series_id AND f.period = p.last WHERE k = 1 AND n >= 3 AND f.value < p.value")
def win_peak_decline(spark, sf):
    """From its peak to its end, for series that ended below it; fewer than three observations say nothing."""
    x = _with_short(spark, sf).where("value IS NOT NULL").groupBy("series_id").agg(F.min_by("period", F.struct(-F.col("value"), "period")).alias("peak"), F.max("value").alias("top"), F.max("period").alias("last"), F.max_by("value", "period").alias("end"), F.count("*").alias("n"))
    return x.where("n >= 3 AND end < top").select("series_id", "peak", "last")


@query(SQL + "SELECT series_id, round(arg_min(value, period), 4) AS first, round(arg_max(value, period), 4) AS last, round((arg_max(value, period) - arg_min(value, period)) / nullif(abs(arg_min(value, period)), 0) * 100, 4) AS pct FROM flow WHERE value IS NOT NULL GROUP BY 1")
def win_first_last_change(spark, sf):
    first, last = F.min_by("value", "period"), F.max_by("value", "period")
    return lake.flow(spark, sf).where("value IS NOT NULL").groupBy("series_id").agg(F.round(first, 4).alias("first"), F.round(last, 4).alias("last"), F.round(numeric.pct_change(first, last), 4).alias("pct"))


@query(SQL + "SELECT series_id, period, round(value / max(CASE WHEN period = DATE '1996-01-01' THEN value END) OVER (PARTITION BY series_id) * 100, 6) AS value FROM flow")
def win_index_100(spark, sf):
    base = F.max(F.when(F.col("period") == F.lit("1996-01-01").cast("date"), F.col("value"))).over(Window.partitionBy("series_id"))
    return lake.flow(spark, sf).select("series_id", "period", F.round(F.col("value") / base * 100, 6).alias("value"))


DEFLATE = SQL + ", base AS (SELECT value AS b FROM price WHERE period = DATE '1996-01-01') SELECT f.series_id, f.period, round(f.value * b / p.value, 4) AS value FROM flow f CROSS JOIN base LEFT JOIN price p USING (period)"


@query(DEFLATE)
def win_deflate(spark, sf):
    """Nominal values at the prices of a base period."""
    price = lake.price_index(spark, sf).select("period", F.col("value").alias("p"))
    base = price.where("period = DATE '1996-01-01'").agg(F.max("p").alias("b"))  # one row
    x = lake.flow(spark, sf).join(price, "period", "left").crossJoin(F.broadcast(base))
    return x.select("series_id", "period", F.round(F.col("value") * F.col("b") / F.col("p"), 4).alias("value"))


@query(SQL + "SELECT period, (period >= DATE '1997-03-01')::INT AS level, greatest(pos - min(pos) FILTER (period >= DATE '1997-03-01') OVER (), -1)::INT + 1 AS trend FROM (SELECT period, row_number() OVER (ORDER BY period) AS pos FROM price)")
def win_break_dummies(spark, sf):
    x = lake.price_index(spark, sf).withColumn("pos", F.row_number().over(acc.own()))
    after = F.col("period") >= F.lit("1997-03-01").cast("date")
    first = F.min(F.when(after, F.col("pos"))).over(Window.partitionBy("series_id"))
    return x.select("period", after.cast("int").alias("level"), (F.greatest(F.col("pos") - first, F.lit(-1)) + 1).cast("int").alias("trend"))


@query(SQL + "SELECT regime, count(*) AS n, count(*) >= 15 AS large_enough FROM (SELECT sum((period IN (DATE '1996-06-01', DATE '1998-06-01'))::INT) OVER (ORDER BY period)::INT AS regime FROM price) GROUP BY 1")
def win_regime_split(spark, sf):
    mark = F.col("period").isin([date(1996, 6, 1), date(1998, 6, 1)]).cast("int")
    x = lake.price_index(spark, sf).withColumn("regime", F.sum(mark).over(acc.own()).cast("int"))
    return x.groupBy("regime").agg(F.count("*").alias("n")).withColumn("large_enough", F.col("n") >= 15)


# ---- top-k, sets


@query(SQL + "SELECT series_id FROM (SELECT DISTINCT series_id FROM observations) ORDER BY series_id LIMIT 3")
def top_series_ids(spark, sf):
    return lake.observations(spark, sf).select("series_id").distinct().orderBy("series_id").limit(3)


@query(
    "WITH l AS (SELECT l_orderkey AS o_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS parts FROM lineitem GROUP BY 1), g AS (SELECT o_orderkey, round(abs(o_totalprice - parts) / nullif(abs(o_totalprice), 0), 6) AS gap FROM orders JOIN l USING (o_orderkey)) "
    "SELECT o_orderkey, gap FROM g WHERE gap IS NOT NULL ORDER BY gap DESC, o_orderkey LIMIT 10"
)
def top_worst(spark, sf):
    """The ten orders that their lines miss by most, as a share of their total."""
    parts = lake.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(lake.money("l_extendedprice").alias("parts"))
    total = F.col("o_totalprice")
    x = lake.table(spark, sf, "orders").join(parts, "o_orderkey").select("o_orderkey", F.round(F.try_divide(F.abs(total - F.col("parts")), F.abs(total)), 6).alias("gap"))
    return x.where("gap IS NOT NULL").orderBy(F.desc("gap"), "o_orderkey").limit(10)


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 2")
def top_greedy_cap(spark, sf):
    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return lake.table(spark, sf, "orders").withColumn("k", F.row_number().over(by)).where("k <= 2").select("o_custkey", "o_orderkey")


@query(SQL + "SELECT series_id, province FROM catalog ORDER BY province NULLS FIRST, series_id LIMIT 5")
def sort_nulls_first(spark, sf):
    return lake.catalog(spark, sf).orderBy(F.asc_nulls_first("province"), "series_id").limit(5).select("series_id", "province")


@query("SELECT 'nation' AS source, n_name AS name, n_regionkey AS region, NULL::DOUBLE AS balance, NULL::VARCHAR AS segment FROM nation UNION ALL SELECT 'customer', c_name, NULL, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT 'supplier', s_name, NULL, s_acctbal, NULL FROM supplier UNION ALL SELECT 'part', p_name, NULL, NULL, NULL FROM part")
def set_union_sources(spark, sf):
    """Four sources one after the other; what a source doesn't have is null."""
    t = lambda table, **c: lake.table(spark, sf, table).select(F.lit(table).alias("source"), *(F.col(v).alias(k) for k, v in c.items()))
    out = t("nation", name="n_name", region="n_regionkey")
    for one in (t("customer", name="c_name", balance="c_acctbal", segment="c_mktsegment"), t("supplier", name="s_name", balance="s_acctbal"), t("part", name="p_name")):
        out = out.unionByName(one, allowMissingColumns=True)
    return out


@query(SQL + "SELECT period FROM flow UNION SELECT period FROM price")
def set_union_periods(spark, sf):
    return lake.flow(spark, sf).select("period").union(lake.price_index(spark, sf).select("period")).distinct()


@query(SQL + "SELECT period FROM flow INTERSECT SELECT period FROM price")
def set_intersect_dates(spark, sf):
    return lake.flow(spark, sf).select("period").intersect(lake.price_index(spark, sf).select("period"))


@query(SQL + "SELECT period FROM price EXCEPT SELECT period FROM flow")
def set_except(spark, sf):
    return lake.price_index(spark, sf).select("period").subtract(lake.flow(spark, sf).select("period"))


@query("SELECT user_id, array_to_string(list(event_type ORDER BY k), '|') AS kinds FROM (SELECT user_id, event_type, min(event_id) AS k FROM events GROUP BY ALL) GROUP BY 1")
def set_dedupe_ordered(spark, sf):
    """What each user did, each kind once, in the order of its first time."""
    first = lake.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    kinds = F.array_sort(F.collect_list(F.struct("at", "event_type")))  # of a user, the few kinds of events
    return first.groupBy("user_id").agg(F.array_join(F.transform(kinds, lambda x: x["event_type"]), "|").alias("kinds"))


# ---- the flagship


@query(DECUM + ", base AS (SELECT value AS b FROM price WHERE period = DATE '1996-01-01'), real AS (SELECT o.series_id, o.period, o.value * b / p.value AS v FROM own o CROSS JOIN base JOIN price p USING (period) WHERE o.value IS NOT NULL) SELECT series_id, count(*) AS n, round(arg_min(v, period), 3) AS first, round(arg_max(v, period), 3) AS last, round((arg_max(v, period) - arg_min(v, period)) / abs(arg_min(v, period)) * 100, 3) AS pct FROM real GROUP BY 1")
def flagship_real_flow(spark, sf):
    """Published running totals become own figures, real ones at the prices of a base month, and a change from first to last."""
    price = lake.price_index(spark, sf).select("period", F.col("value").alias("p"))
    base = price.where("period = DATE '1996-01-01'").agg(F.max("p").alias("b"))  # one row
    own = acc.decumulate(lake.ytd(spark, sf)).where("value IS NOT NULL").join(price, "period").crossJoin(F.broadcast(base))
    real = own.withColumn("v", F.col("value") * F.col("b") / F.col("p"))
    first, last = F.min_by("v", "period"), F.max_by("v", "period")
    return real.groupBy("series_id").agg(F.count("*").alias("n"), F.round(first, 3).alias("first"), F.round(last, 3).alias("last"), F.round(numeric.pct_change(first, last), 3).alias("pct"))
