"""Queries of what the streaming operators do, in their batch form; tests hold the streams against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.plans.registry import query
from tidelake.sources import lake
from tidelake.streaming import ordering, sessions


@query(
    "WITH e AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 6 HOUR, TRUE) AS first FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "s AS (SELECT *, count(*) FILTER (first) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM e) "
    "SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n, list_sort(list(DISTINCT event_type)) AS kinds, round(sum(CAST(value AS DECIMAL(18,6)))::DOUBLE, 6) AS total FROM s GROUP BY user_id, k"
)
def stream_sessions(spark, sf):
    """Sessions of users, parted by pauses of six hours."""
    return sessions.sessions(lake.table(spark, sf, "events")).withColumn("total", F.round("total", 6))


KINDS = {"view": "stage_start", "click": "stage_end", "error": "error", "purchase": "completion"}


def analyses(events: DataFrame) -> DataFrame:
    """Events as those of analyses, one for each user and day, in order of arrival; one in nine has a time two hours back, and hardly any stream is as it should be."""
    at = F.col("ts").cast("timestamp") - F.when(F.col("event_id") % 9 == 4, F.expr("INTERVAL 2 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("event_type")), F.lit("finding"))
    stream = F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd"))
    return events.select(stream.alias("stream"), F.col("event_id").alias("place"), at.alias("at"), kind.alias("kind"), F.when(F.col("event_type").isin("view", "click"), F.concat(F.lit("s"), F.col("event_id") % 3)).alias("stage"))


@query(
    "WITH x AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS stream, event_id AS place, ts - CASE WHEN event_id % 9 = 4 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS tm, CASE event_type WHEN 'view' THEN 'stage_start' WHEN 'click' THEN 'stage_end' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'completion' ELSE 'finding' END AS kind, "
    "CASE WHEN event_type IN ('view', 'click') THEN 's' || event_id % 3 END AS stage FROM events), "
    "t AS (SELECT *, max(tm) OVER w AS occurred_at, max(tm) OVER b AS last, coalesce(bool_or(kind = 'completion') OVER b, FALSE) AS done FROM x WINDOW w AS (PARTITION BY stream ORDER BY place), b AS (PARTITION BY stream ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "u AS (SELECT *, bool_or(coalesce(occurred_at > last + INTERVAL 12 HOUR, FALSE)) OVER (PARTITION BY stream ORDER BY place) AS silent FROM t), v AS (SELECT * FROM u WHERE NOT silent AND NOT done), "
    "g AS (SELECT stream, bool_or(kind = 'error') AS failed, arg_max(CASE WHEN kind = 'stage_start' THEN stage ELSE '' END, place) FILTER (kind IN ('stage_start', 'stage_end')) AS open, max(occurred_at) + INTERVAL 12 HOUR AS tm FROM v GROUP BY 1 HAVING NOT bool_or(kind = 'completion')), "
    "m AS (SELECT stream, 1 AS o, 0 AS place, 'error' AS kind, NULL AS stage, NULL AS outcome, tm FROM g WHERE NOT failed UNION ALL SELECT stream, 1, 1, 'stage_end', open, 'failed', tm FROM g WHERE open <> '' UNION ALL SELECT stream, 1, 2, 'completion', NULL, 'failed', tm FROM g "
    "UNION ALL SELECT stream, 0, place, kind, stage, NULL, occurred_at FROM v) "
    "SELECT stream, (row_number() OVER (PARTITION BY stream ORDER BY o, place) - 1)::INT AS sequence, kind, stage, outcome, tm AS occurred_at FROM m"
)
def stream_ordered(spark, sf):
    """Streams of analyses as a listener gets them: numbered, times never back, each with one completion at its end."""
    return ordering.complete(analyses(lake.table(spark, sf, "events")))
