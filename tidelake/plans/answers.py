"""Queries of what surrounds an answer."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelake.frames.frame import execute
from tidelake.functions import answering
from tidelake.plans.frames import SPINE, started
from tidelake.plans.registry import query
from tidelake.plans.words import literal, rows
from tidelake.sources import documents, lake
from tidelake.sources.lake import SQL

_STEP = lambda kind, **p: '{"kind": "' + kind + '", "parameters": {' + ", ".join(f'"{k}": "{v}"' for k, v in p.items()) + "}}"
_ADD, _INDEX = _STEP("add_column", series_reference="s", column_key="k"), _STEP("index_column", column_key="k", base_date="1996-01-01")
PLANS = [
    (f"[{_ADD}]", None), (f"[{_ADD}, {_INDEX}]", None), ("[]", "empty"), ("no json", "json"), (f"[{_STEP('drop_table', name='x')}]", "kind"), (f"[{_STEP('index_column', column_key='k')}]", "parameters"), (f"[{_STEP('index_column', column_key=' ', base_date='d')}]", "parameters"),
    (f"[{_ADD}, {_STEP('revert_to', target_version=0)}]", None), (f"[{_STEP('revert_to', target_version=99)}]", "target"), (f"[{_STEP('deflate_column', column_key='k', deflator_column_key='k', base_date='d', convention_reference='c')}]", "target"), (f"[{_STEP('add_column', series_reference='s', column_key='k', more='x')}]", "parameters"),
]
_KNOWN = "MAP {" + ", ".join(f"'{k}': [{', '.join(repr(n) for n in sorted(v))}]" for k, v in answering.PARAMETERS.items()) + "}"


@query(
    literal("l", [p for p, _ in PLANS]) + f", p AS (SELECT page_id AS id, s, page_id % 5 AS version FROM pages JOIN l ON l.id = page_id % {len(PLANS)}), "
    "o AS (SELECT id, version, unnest(CASE WHEN json_valid(s) THEN json_extract(s, '$[*]') ELSE [] END) AS j, generate_subscripts(CASE WHEN json_valid(s) THEN json_extract(s, '$[*]') ELSE [] END, 1) - 1 AS i FROM p), "
    "q AS (SELECT id, version, i, json_extract_string(j, '$.kind') AS kind, list_sort(json_keys(j, '$.parameters')) AS names, json_extract_string(j, '$.parameters.*') AS given, json_extract_string(j, '$.parameters.target_version') AS target, json_extract_string(j, '$.parameters.column_key') AS a, json_extract_string(j, '$.parameters.deflator_column_key') AS b FROM o), "
    f"w AS (SELECT id, i, CASE WHEN ({_KNOWN})[kind] IS NULL THEN 'kind' WHEN names <> ({_KNOWN})[kind] OR len(list_filter(given, lambda v: trim(v) = '')) > 0 THEN 'parameters' WHEN kind = 'revert_to' AND NOT coalesce(TRY_CAST(target AS INT) BETWEEN 0 AND version + i - 1, FALSE) THEN 'target' WHEN kind = 'deflate_column' AND a = b THEN 'target' END AS why FROM q), "
    "f AS (SELECT id, arg_min(why, i) AS why FROM w WHERE why IS NOT NULL GROUP BY 1) SELECT p.id, CASE WHEN NOT json_valid(s) THEN 'json' WHEN json_array_length(s) = 0 THEN 'empty' ELSE why END AS refusal FROM p LEFT JOIN f USING (id)"
)
def nl_planner(spark, sf):
    """Plans as a model may emit them, checked before anything runs: a plan for each page, from a version on."""
    x = lake.table(spark, sf, "pages").join(F.broadcast(rows(spark, [p for p, _ in PLANS])), F.col("id") == F.col("page_id") % len(PLANS))  # a handful of plans
    return x.select(F.col("page_id").alias("id"), answering.plan_refusal(F.col("s"), F.col("page_id") % 5).alias("refusal"))


_VOCABULARY = [
    f"[{_STEP('add_column', series_reference='flow', column_key='c')}, {_STEP('index_column', column_key='c', base_date='2001-01-01')}, {_STEP('index_column', column_key='c__index_2001-01-01', base_date='2002-01-01')}]",
    f"[{_STEP('index_column', column_key='c', base_date='2001-01-01')}, {_STEP('add_column', series_reference='flow', column_key='c')}]",
    f"[{_STEP('add_column', series_reference='none', column_key='c')}]",
    f"[{_STEP('add_column', series_reference='stock', column_key='b')}]",
    f"[{_STEP('revert_to', target_version=0)}, {_STEP('deflate_column', column_key='a', deflator_column_key='b', base_date='2001-01-01', convention_reference='x')}]",
    f"[{_STEP('deflate_column', column_key='a', deflator_column_key='b', base_date='2001-01-01', convention_reference='x')}, {_STEP('revert_to', target_version=0)}]",
    f"[{_STEP('add_column', series_reference='flow', column_key='period')}]",
]
#: The columns of a frame's first versions.
_SETS = [["a"], ["a", "b"], ["a", "b", "d"]]


@query(
    literal("l", _VOCABULARY).replace("WITH ", "WITH RECURSIVE ", 1) + f", p AS (SELECT page_id AS id, json_extract(s, '$[*]') AS steps, list_slice({_SETS!r}, 1, page_id % 3 + 1) AS sets FROM pages JOIN l ON l.id = page_id % {len(_VOCABULARY)}), "
    "f(id, i, steps, sets, why) AS (SELECT id, 1, steps, sets, NULL::VARCHAR FROM p UNION ALL SELECT id, i + 1, steps, list_append(sets, CASE WHEN kind = 'revert_to' THEN coalesce(sets[target + 1], sets[len(sets)]) WHEN made IS NULL THEN sets[len(sets)] ELSE list_append(sets[len(sets)], made) END), "
    "CASE WHEN why IS NOT NULL THEN why WHEN kind = 'add_column' AND series NOT IN ('flow', 'stock') THEN 'unknown_series' WHEN kind = 'add_column' AND (key = 'period' OR list_contains(sets[len(sets)], key)) THEN 'taken' "
    "WHEN kind IN ('index_column', 'deflate_column') AND NOT list_contains(sets[len(sets)], key) OR kind = 'deflate_column' AND NOT list_contains(sets[len(sets)], by_) THEN 'unknown_column' END "
    "FROM (SELECT *, CASE kind WHEN 'add_column' THEN key WHEN 'index_column' THEN key || '__index_' || base WHEN 'deflate_column' THEN key || '__deflated_by_' || by_ || '_' || base END AS made FROM (SELECT id, i, steps, sets, why, json_extract_string(steps[i], '$.kind') AS kind, "
    "json_extract_string(steps[i], '$.parameters.column_key') AS key, json_extract_string(steps[i], '$.parameters.deflator_column_key') AS by_, json_extract_string(steps[i], '$.parameters.base_date') AS base, json_extract_string(steps[i], '$.parameters.series_reference') AS series, "
    "TRY_CAST(json_extract_string(steps[i], '$.parameters.target_version') AS INT) AS target FROM f WHERE i <= len(steps)))) "
    "SELECT id, why AS refusal, CASE WHEN why IS NULL THEN array_to_string(sets[len(sets)], ',') END AS columns FROM f WHERE i = len(steps) + 1"
)
def nl_plan_columns(spark, sf):
    """Plans followed through the columns they have at each step, from frames of one to three versions: a plan for each page."""
    x = lake.table(spark, sf, "pages").join(F.broadcast(rows(spark, _VOCABULARY)), F.col("id") == F.col("page_id") % len(_VOCABULARY))  # a handful of plans
    sets = F.slice(F.array(*(F.array(*map(F.lit, s)) for s in _SETS)), F.lit(1), (F.col("page_id") % 3 + 1).cast("int"))
    x = x.select(F.col("page_id").alias("id"), answering.plan_columns(F.col("s"), sets, F.array(F.lit("flow"), F.lit("stock"))).alias("p"))
    return x.select("id", "p.refusal", F.array_join("p.columns", ",").alias("columns"))


_EVIDENCE = (
    "WITH e AS (SELECT s_nationkey AS id, s_suppkey AS finding, s_name || ' holds ' || CASE WHEN s_acctbal < 0 THEN 'a debt' ELSE 'a balance' END AS statement, s_suppkey % 3 <> 0 AS active FROM supplier), "
    "t AS (SELECT id, CASE WHEN id % 5 = 2 AND finding % 7 = 1 THEN statement || '!' ELSE statement END AS statement FROM e WHERE NOT (id % 4 = 1 AND finding % 2 = 1)) "
)


@query(
    _EVIDENCE + "SELECT k.id, coalesce(u, 0) AS unknown, coalesce(c, 0) AS uncited, coalesce(u, 0) = 0 AND coalesce(c, 0) = 0 AS accepted FROM (SELECT DISTINCT id FROM e) k "
    "LEFT JOIN (SELECT id, count(DISTINCT statement) AS u FROM t WHERE (id, statement) NOT IN (SELECT id, statement FROM e) GROUP BY 1) USING (id) LEFT JOIN (SELECT id, count(*) AS c FROM e WHERE active AND (id, statement) NOT IN (SELECT id, statement FROM t) GROUP BY 1) USING (id)"
)
def nl_narrative(spark, sf):
    """A narrative for each nation may only repeat statements of evidence, and must cite all findings that stand."""
    s = lake.table(spark, sf, "supplier")
    said = F.concat("s_name", F.lit(" holds "), F.when(F.col("s_acctbal") < 0, "a debt").otherwise("a balance"))
    evidence = s.select(F.col("s_nationkey").alias("id"), F.col("s_suppkey").alias("finding"), said.alias("statement"), (F.col("s_suppkey") % 3 != 0).alias("active"))
    own = F.when((F.col("id") % 5 == 2) & (F.col("finding") % 7 == 1), F.concat("statement", F.lit("!"))).otherwise(F.col("statement"))
    return answering.narrative_refusal(evidence.where("NOT (id % 4 = 1 AND finding % 2 = 1)").select("id", own.alias("statement")), evidence)


@query(
    SPINE + ", b AS (SELECT price AS p0, orders AS o0 FROM s WHERE period = DATE '1996-01-01') SELECT period, orders, round(price, 6) AS price, round(orders * p0 / price, 4) AS real, round(orders * p0 / price / (o0 * p0 / p0) * 100, 4) AS indexed FROM s, b"
)
def nl_turns(spark, sf):
    """Three turns on one frame: two series side by side, one at the prices of a base month, and that as an index."""
    frame, base = started(spark, sf)[0], datetime.date(1996, 1, 1)
    frame = execute(frame, "deflate_column", 2, key="orders", deflator="price", base=base)
    frame = execute(frame, "index_column", 3, key=frame.columns[-1].key, base=base)
    real, indexed = (F.col(f"`{m.key}`") for m in frame.columns[-2:])
    return frame.data.select("period", "orders", F.round("price", 6).alias("price"), F.round(real, 4).alias("real"), F.round(indexed, 4).alias("indexed"))


@query(SQL + "SELECT series_id, '{\"series\":\"' || series_id || '\",\"unit\":\"' || unit || '\",\"frequency\":\"' || native_freq || '\",\"rule\":\"' || aggregation_rule || '\"}' AS context FROM catalog WHERE usable")
def plan_context(spark, sf):
    """What a planner may refer to: one line of JSON for each series that can be served."""
    c = F.struct(F.col("series_id").alias("series"), "unit", F.col("native_freq").alias("frequency"), F.col("aggregation_rule").alias("rule"))
    return lake.catalog(spark, sf).where("usable").select("series_id", F.to_json(c).alias("context"))


_OBJECTS = ["/Type/Page /Font", "/Type /Page /Encrypt 5 0 R /Font", "/Type /Page " * 51 + "/Font", "/Type /Pages " * 60 + "/Type /Page", "/Type /Page " * 50 + "/Font"]


@query(
    literal("o", _OBJECTS) + r", b AS (SELECT page_id, html, page_id % 3 AS k, coalesce(html, '') || ' ' || s AS said FROM pages JOIN o ON id = page_id // 3 % 5), c AS (SELECT *, len(regexp_extract_all(said, '/Type\s*/Page(?:[^A-Za-z]|$)')) AS n FROM b) "
    r"SELECT page_id, CASE WHEN k = 0 THEN CASE WHEN contains(said, '/Encrypt') THEN 'encrypted' WHEN n > 50 THEN 'page_limit' WHEN NOT contains(said, '/Font') THEN 'no_text_layer' ELSE 'unsupported' END WHEN k = 1 THEN 'unknown' WHEN regexp_matches(lower(substr(html, 1, 15)), '^\s*<(?:!doctype|html)') THEN NULL ELSE 'unknown' END AS refusal FROM c"
)
def doc_pdf(spark, sf):
    """Bodies by their first bytes: a PDF is known and refused, by what its objects tell, as there is no reader of its text here; what isn't known is refused too."""
    n = F.col("page_id")
    few = rows(spark, _OBJECTS)
    x = lake.table(spark, sf, "pages").join(F.broadcast(few), F.col("id") == F.floor(n / 3) % len(_OBJECTS))  # five cases
    html = F.coalesce("html", F.lit(""))
    body = F.when(n % 3 == 0, F.concat(F.lit("%PDF-1.7 "), html, F.lit(" "), "s")).when(n % 3 == 1, F.concat(F.lit("?"), html)).otherwise(html).cast("binary")
    kind = documents.kind_of(F.lit(None).cast("string"), body)
    return x.select("page_id", F.when(kind == "pdf", documents.pdf_refusal(body)).when(kind.isNull(), "unknown").alias("refusal"))


@query(
    "WITH i AS (SELECT l_orderkey AS document, l_linenumber AS page, sha256(concat_ws('|', l_partkey, l_suppkey)) AS digest FROM lineitem), f AS (SELECT digest, min((document, page)) AS f FROM i GROUP BY 1), "
    "c AS (SELECT sha256(concat_ws('|', l_partkey, l_suppkey)) AS digest FROM lineitem WHERE l_orderkey % 4 = 0), n AS (SELECT digest, f[1] AS document, f[2] AS page FROM f WHERE digest NOT IN (SELECT digest FROM c)) "
    "SELECT digest, document, (row_number() OVER (PARTITION BY document ORDER BY page, digest) - 1) // 3 AS batch FROM n"
)
def doc_ocr(spark, sf):
    """Images that no earlier reading has, in batches of three of a document: pages are lines, a page's image is its part and supplier."""
    x = lake.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("page"), F.sha2(F.concat_ws("|", "l_partkey", "l_suppkey"), 256).alias("digest"))
    return answering.batches(x, x.where("document % 4 = 0").select("digest").distinct())


_SEEN = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<noscript\\b.*?</noscript>|<template\\b.*?</template>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, length({_SEEN}) AS shown, coalesce(length({_SEEN}) < 600, TRUE) AS render FROM pages")
def doc_render(spark, sf):
    """Which pages show too little without being rendered; rendering itself takes a browser and is left to the caller."""
    n = F.length(answering.visible(F.col("html")))
    return lake.table(spark, sf, "pages").select("page_id", n.cast("long").alias("shown"), F.coalesce(n < 600, F.lit(True)).alias("render"))


@query(
    SPINE + ", t AS (SELECT period, CASE WHEN month(period) % 5 = 0 THEN NULL ELSE orders END AS v FROM s), g AS (SELECT *, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY period) AS k FROM t) "
    "SELECT dense_rank() OVER (ORDER BY k) AS segment, min(period) AS start, max(period) AS stop, count(*) AS points FROM g WHERE v IS NOT NULL GROUP BY k"
)
def ui_chart_config(spark, sf):
    """The lines a chart draws: a missing figure ends one, and none is drawn across it."""
    frame, _ = started(spark, sf)
    x = frame.data.select("period", F.when(F.month("period") % 5 == 0, None).otherwise(F.col("orders")).alias("v"))
    gaps = F.sum(F.col("v").isNull().cast("int")).over(Window.partitionBy(F.lit(0)).orderBy("period"))  # one frame, a row for each of its periods
    runs = x.withColumn("k", gaps).where("v IS NOT NULL").groupBy("k").agg(F.min("period").alias("start"), F.max("period").alias("stop"), F.count("*").alias("points"))
    return runs.select(F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("k")).cast("long").alias("segment"), "start", "stop", "points")


@query(SPINE + " SELECT period, CASE WHEN orders IS NULL THEN '—' ELSE format('{:,.2f}', orders::DOUBLE) END AS \"orders (adet)\", CASE WHEN price IS NULL THEN '—' ELSE format('{:,.2f}', price) END AS \"price (endeks)\" FROM s")
def ui_table(spark, sf):
    """A frame as a table shows it: units in the heads, dashes for what isn't known."""
    frame, _ = started(spark, sf)
    return frame.data.select("period", *(answering.cell(F.col(f"`{m.key}`").cast("double")).alias(f"{m.key} ({u})") for m, u in zip(frame.columns, ("adet", "endeks"), strict=True)))


@query(
    "WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN [(event_type, props)] WHEN 1 THEN [('message', props || chr(10) || user_id)] WHEN 2 THEN [('b', 'x'), ('message', props)] ELSE [] END AS x FROM events), "
    "u AS (SELECT event_id, unnest(x) AS p, generate_subscripts(x, 1) AS k FROM e) SELECT event_id, k::INT AS k, p[1] AS event, p[2] AS data FROM u"
)
def ui_stream(spark, sf):
    """The events of streamed bodies, one body for each row: named and unnamed ones, data over several lines, remarks, blocks without data, and blocks that aren't finished."""
    e = lake.table(spark, sf, "events")
    k, kind, props = F.col("event_id") % 4, F.col("event_type"), F.col("props")
    body = (
        F.when(k == 0, F.concat(F.lit(": hello\r\n\r\nevent: "), kind, F.lit("\r\ndata: "), props, F.lit("\r\n\r\n")))
        .when(k == 1, F.concat(F.lit("data: "), props, F.lit("\ndata:"), F.col("user_id").cast("string"), F.lit("\n\ndata: unfinished")))
        .when(k == 2, F.concat(F.lit("event: a\nevent: b\ndata: x\n\n\n\nretry: 5\n\ndata: "), props, F.lit("\n\n")))
        .otherwise(F.concat(F.lit("event: x\n\nid: 1\ndata: "), props))
    )
    x = e.select("event_id", F.posexplode(answering.events(body)).alias("k", "e"))
    return x.select("event_id", (F.col("k") + 1).alias("k"), F.col("e.event").alias("event"), F.col("e.data").alias("data"))


@query("SELECT * FROM (SELECT 'catalog' AS component, count(*) > 0 AS ready FROM customer UNION ALL SELECT 'observations', count(*) > 0 FROM orders UNION ALL SELECT 'pages', count(*) > 0 FROM pages UNION ALL SELECT 'all', (SELECT count(*) FROM customer) > 0 AND (SELECT count(*) FROM orders) > 0 AND (SELECT count(*) FROM pages) > 0)")
def api_health(spark, sf):
    """Which components answer, and whether all do (else the service is degraded)."""
    parts = {"catalog": lake.catalog(spark, sf), "observations": lake.observations(spark, sf), "pages": lake.table(spark, sf, "pages")}
    ready = None
    for name, df in parts.items():
        one = df.limit(1).agg((F.count("*") > 0).alias("ready")).select(F.lit(name).alias("component"), "ready")
        ready = one if ready is None else ready.union(one)
    return ready.union(ready.agg(F.bool_and("ready")).select(F.lit("all"), "*"))
