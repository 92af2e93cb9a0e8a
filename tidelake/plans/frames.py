"""Queries of the frame operations, each over series of the lake."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tidelake.frames.chart import axes_of
from tidelake.frames.frame import Frame, FrameStore, Lake, active, execute, find, new_frame
from tidelake.plans.registry import query
from tidelake.plans.series import months
from tidelake.sources import lake
from tidelake.sources.lake import SQL

BASE = datetime.date(1996, 1, 1)
SPINE = SQL + ", spine AS (SELECT CAST(p AS DATE) AS period FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '1999-01-01', INTERVAL 1 MONTH) t(p)), s AS (SELECT spine.period, o.value AS orders, p.value AS price FROM spine LEFT JOIN (SELECT * FROM stock WHERE series_id = 'stock.NATION_19') o USING (period) LEFT JOIN price p USING (period))"


def started(spark, sf) -> tuple[Frame, Lake]:
    """Version 2 of a frame: a stock and the price index."""
    own = Lake(lake.catalog(spark, sf), lake.observations(spark, sf))
    frame = new_frame("orders", months(spark, "1995-01-01", "1998-12-01"))
    frame = execute(frame, "add_column", 0, own, series_id="stock.NATION_19", key="orders")
    return execute(frame, "add_column", 1, own, series_id="index.price", key="price"), own


@query(SPINE + ", w AS (SELECT CAST(date_trunc('month', period) AS DATE) AS period, avg(value) AS discount FROM rate WHERE series_id = 'rate.A' GROUP BY 1) SELECT period, orders, round(price, 6) AS price, round(discount, 8) AS discount FROM s LEFT JOIN w USING (period)")
def op_add_column(spark, sf):
    frame, own = started(spark, sf)
    frame = execute(frame, "add_column", 2, own, series_id="rate.A", key="discount")
    return frame.data.select("period", "orders", F.round("price", 6).alias("price"), F.round("discount", 8).alias("discount"))


@query(SPINE + " SELECT period, round(orders * (SELECT price FROM s WHERE period = DATE '1996-01-01') / price, 4) AS real FROM s")
def op_deflate(spark, sf):
    frame = execute(started(spark, sf)[0], "deflate_column", 2, key="orders", deflator="price", base=BASE)
    return frame.data.select("period", F.round(F.col(f"`{frame.columns[-1].key}`"), 4).alias("real"))


@query(SPINE + " SELECT period, round(orders / (SELECT orders FROM s WHERE period = DATE '1996-01-01') * 100, 6) AS indexed FROM s")
def op_index(spark, sf):
    frame = execute(started(spark, sf)[0], "index_column", 2, key="orders", base=BASE)
    return frame.data.select("period", F.round(F.col(f"`{frame.columns[-1].key}`"), 6).alias("indexed"))


@query(SPINE + " SELECT period, orders FROM s")
def op_revert(spark, sf):
    return execute(started(spark, sf)[0], "revert_to", 2, target_version=1).data


_BASED = SPINE + ", b AS (SELECT orders AS base FROM s WHERE period = DATE '1996-01-01'), v1 AS (SELECT 1 AS version, period, 'orders' AS k, orders AS v FROM s), v2 AS (SELECT 2, period, k, v FROM v1 UNION ALL SELECT 2, period, 'price', price FROM s), v3 AS (SELECT 3, period, k, v FROM v2 t(a, period, k, v) UNION ALL SELECT 3, period, 'orders__index_1996-01-01', orders / base * 100 FROM s, b), v4 AS (SELECT 4, period, k, v FROM v2 t(a, period, k, v)), every(version, period, k, v) AS (SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM v3 UNION ALL SELECT * FROM v4) "


def _cells(versions):
    """Version, period, column and value of all cells of some versions."""
    out = None
    for f in versions:
        keys = [m.key for m in f.columns]
        cells = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"`{k}`").cast("double").alias("v")) for k in keys)))
        one = f.data.select(F.lit(f.version).alias("version"), "period", cells.alias("c")).select("version", "period", "c.*")
        out = one if out is None else out.union(one)
    return out


def _executed(spark, sf):
    frame = execute(started(spark, sf)[0], "index_column", 2, key="orders", base=BASE)
    return execute(frame, "revert_to", 3, target_version=2)


@query(_BASED + "SELECT version, k AS key, count(*) AS n, count(v) AS present, round(sum(v), 4) AS total FROM every GROUP BY ALL")
def op_execute(spark, sf):
    """What each version of a frame holds after two series were added, one was indexed, and that was taken back."""
    frame = _executed(spark, sf)
    x = _cells([*frame.earlier[1:], frame]).groupBy("version", F.col("k").alias("key"))
    return x.agg(F.count("*").alias("n"), F.count("v").alias("present"), F.round(F.sum("v"), 4).alias("total"))


@query(_BASED + "SELECT version, period, count(v) AS present FROM every WHERE version <= 3 GROUP BY ALL")
def op_history(spark, sf):
    """Earlier versions are read from a store as they were."""
    store, frame = FrameStore(), _executed(spark, sf)
    for f in (*frame.earlier, frame):
        store.put(f)
    return _cells([store.get("orders", v) for v in (1, 2, 3)]).groupBy("version", "period").agg(F.count("v").alias("present"))


@query(_BASED + "SELECT period, k AS key, round(v, 4) AS value FROM every WHERE version = 4")
def op_frame_store(spark, sf):
    """The newest version of a frame."""
    store, frame = FrameStore(), _executed(spark, sf)
    for f in (*frame.earlier, frame):
        store.put(f)
    return _cells([store.current("orders")]).select("period", F.col("k").alias("key"), F.round("v", 4).alias("value"))


@query(_BASED + ", f(finding_id, supersedes, k) AS (VALUES ('b', 'a', 'orders'), ('b', 'a', 'price'), ('c', NULL, 'price')) SELECT finding_id, supersedes, k AS key, round(arg_min(v, period), 4) AS first, round(arg_max(v, period), 4) AS last FROM f JOIN every USING (k) WHERE version = 2 AND v IS NOT NULL GROUP BY ALL")
def op_finding(spark, sf):
    """The findings that stand, beside the first and last figures of the columns that each is about."""
    frame = find(started(spark, sf)[0], "a", "orders grow", ("orders",))
    frame = find(find(frame, "b", "orders grow as prices do", ("orders", "price"), supersedes="a"), "c", "prices grow", ("price",))
    named = spark.createDataFrame([(f.finding_id, f.supersedes, k) for f in active(frame) for k in f.columns], "finding_id string, supersedes string, k string")
    x = _cells([frame]).where("v IS NOT NULL").groupBy("k").agg(F.round(F.min_by("v", "period"), 4).alias("first"), F.round(F.max_by("v", "period"), 4).alias("last"))
    return named.join(x, "k").select("finding_id", "supersedes", F.col("k").alias("key"), "first", "last")


@query(SPINE + ", m AS (SELECT median(abs(orders)) FILTER (orders <> 0) AS a, median(abs(price)) FILTER (price <> 0) AS b FROM s) SELECT k AS column_key, axis, round(greatest(a, b) / least(a, b), 6) AS magnitude_ratio, greatest(a, b) / least(a, b) >= 100 AS indexing FROM m, (VALUES ('orders', 'left'), ('price', 'right')) t(k, axis)")
def op_chart(spark, sf):
    """The axes of the frame's columns, and how far apart their medians are."""
    return axes_of(started(spark, sf)[0]).withColumn("magnitude_ratio", F.round("magnitude_ratio", 6))
