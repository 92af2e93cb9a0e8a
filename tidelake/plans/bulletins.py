"""Queries of the raw bulletins: payloads are made of the driver's tables and written as trees of files once; these are scanned and parsed as published files, and held against the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions import numeric as num
from tidelake.functions import text as txt
from tidelake.operators import gates
from tidelake.plans.registry import query
from tidelake.plans.words import FOLD, LABELS, frame, values
from tidelake.sources import bronze, lake, raw, store
from tidelake.sources.lake import SQL

_SCOPES = ", ".join(f"({k}, '{v}')" for k, v in bronze.SCOPES.items())
SEGMENT_SQL = SQL + f", scopes(code, scope) AS (VALUES {_SCOPES}), seg AS (SELECT f.period, r_regionkey AS rk, segment, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value, count(*) AS n FROM facts f JOIN region ON r_name = region GROUP BY ALL) "


def _segments(spark, sf) -> DataFrame:
    """period, rk, segment, v (decimal), n."""
    keys = lake.table(spark, sf, "region").select(F.col("r_name").alias("region"), F.col("r_regionkey").alias("rk"))
    x = lake.order_facts(spark, sf).join(keys, "region").groupBy("period", "rk", "segment")
    return x.agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"), F.count("*").alias("n"))


def monthly_files(spark, sf) -> DataFrame:
    """One payload for each month and region, as the monthly bulletin publishes it. The last region's payload names another group than was asked for."""
    x = _segments(spark, sf).withColumn("code", F.col("rk") + 10001)
    scope = F.when(F.col("rk") == 4, "Sektör").otherwise(bronze.scope_of(F.col("code").cast("int")))
    cell = F.concat(F.lit('{"cell":["'), scope, F.lit('",7,"'), "segment", F.lit(' *",null,"-",'), "n", F.lit(","), F.col("v").cast("string"), F.lit("]}"))
    files = x.groupBy("period", "code").agg(F.array_join(F.array_sort(F.collect_list(cell)), ",").alias("rows"))  # a row for each of the few segments
    content = F.concat(F.lit('{"Json":{"caption":"Krediler (milyon TL), Dönem:'), F.date_format("period", "yyyy/M"), F.lit('","data":{"rows":['), "rows", F.lit(',{"cell":["",1,"no numbers",null,"x"]},{"cell":[1,2]}]}}}'))
    return files.select(F.concat(F.date_format("period", "yyyy-MM"), F.lit("/t03_taraf"), "code", F.lit(".json")).alias("path"), content.alias("content"))


def monthly_tree(spark, sf) -> str:
    return raw.archived(spark, sf, "monthly", lambda: monthly_files(spark, sf))


@query(SEGMENT_SQL + "SELECT 3 AS table_no, (10001 + rk)::INT AS scope_code, segment AS label, period, round(value, 4) AS value FROM seg WHERE rk <> 4")
def src_monthly_json(spark, sf):
    x = bronze.monthly_points(raw.scan(spark, monthly_tree(spark, sf), "monthly"))
    return x.select("table_no", "scope_code", "label", "period", F.round("value", 4).alias("value"))


@query(SEGMENT_SQL + "SELECT 'monthly.t03.taraf' || code || '.' || lower(translate(segment, 'Iİ', 'ıi')) AS series_id, scope AS sector_scope, 'TRY' AS unit, 1e6::DOUBLE AS scale_factor, 'stock' AS measure_type, 'last' AS aggregation_rule, min(period) AS coverage_start, max(period) AS coverage_end, count(*) AS observations FROM seg JOIN scopes ON code = 10001 + rk WHERE rk <> 4 AND period BETWEEN DATE '1994-01-01' AND DATE '1996-12-31' GROUP BY code, scope, segment")
def src_adapter(spark, sf):
    """A bulletin from the files of some years and one table, the only ones that are opened, to its part of the catalog."""
    files = raw.scan(spark, monthly_tree(spark, sf), "monthly").where("table_no = 3 AND period BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'")
    x = bronze.monthly_catalog(bronze.monthly_points(files))
    return x.select("series_id", "sector_scope", "unit", "scale_factor", "measure_type", "aggregation_rule", "coverage_start", "coverage_end", "observations")


_GUARD = [(10001, "Sektör"), (10001, "Kamu"), (10004, " Kalkınma ve Yatırım "), (10006, ""), (10006, None), (99999, "new group"), (10009, "Mevduat")]


@query(
    f"WITH scopes(code, scope) AS (VALUES {_SCOPES}), g(k, c, stated) AS (VALUES " + ", ".join(f"({i}, {c}, {'NULL' if s is None else repr(s)})" for i, (c, s) in enumerate(_GUARD)) + "), "
    f"x AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c ELSE 10001 + c_custkey % 10 END AS c, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE stated END AS stated FROM customer JOIN g ON k = c_custkey % {len(_GUARD)}) "
    "SELECT id, scope IS NULL OR coalesce(trim(stated), '') = '' OR trim(stated) = scope AS fits FROM x LEFT JOIN scopes ON code = c"
)
def src_scope_guard(spark, sf):
    """Whether the group that a payload names is the one asked for; payloads are customers."""
    few = spark.createDataFrame([(i, *r) for i, r in enumerate(_GUARD)], "k int, c int, stated string")
    n = F.col("c_custkey")
    x = lake.table(spark, sf, "customer").join(F.broadcast(few), F.col("k") == n % len(_GUARD))  # seven cases
    code = F.when(n % 3 == 0, F.col("c")).otherwise((n % 10 + 10001).cast("int"))
    return x.select(n.alias("id"), bronze.scope_matches(code, F.when(n % 5 == 0, F.col("c_mktsegment")).otherwise(F.col("stated"))).alias("fits"))


def quarterly_files(spark, sf) -> DataFrame:
    """A payload for each quarter: provinces are nations, groups are market segments; the third figure's column has no name."""
    x = lake.order_facts(spark, sf).groupBy(F.trunc("period", "quarter").alias("q"), "nation", "segment").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"), F.count("*").alias("n"))
    cell = F.concat(F.lit('{"cell":[1,2,3,"'), "nation", F.lit('","'), "segment", F.lit('",'), "n", F.lit(',"'), "v", F.lit('",'), F.col("v").cast("string"), F.lit("]}"))
    files = x.groupBy("q", "nation").agg(F.array_join(F.array_sort(F.collect_list(cell)), ",").alias("rows"))
    content = F.concat(F.lit('{"Json":{"colNames":["a","b","c","d","e","Yurtiçi Şube Sayısı","text"],"data":{"rows":['), "rows", F.lit("]}}}"))
    return files.select(F.concat_ws("/", "nation", F.date_format("q", "yyyy-M"), F.lit("tablo6.json")).alias("path"), content.alias("content"))


@query(SQL + ", q AS (SELECT nation AS province, segment AS grp, CAST(date_trunc('quarter', period) AS DATE) AS period, count(*)::DOUBLE AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM facts GROUP BY ALL) SELECT 'Yurtiçi Şube Sayısı' AS \"column\", province, grp, period, n AS value FROM q UNION ALL SELECT 'col7', province, grp, period, round(v, 4) FROM q")
def src_quarterly_json(spark, sf):
    root = raw.archived(spark, sf, "quarterly", lambda: quarterly_files(spark, sf))
    return bronze.quarterly_points(raw.scan(spark, root, "quarterly")).select("column", "province", "grp", "period", F.round("value", 4).alias("value"))


def weekly_files(spark, sf) -> DataFrame:
    """A page for each day of events and type: the same figures with none and with four decimals."""
    x = lake.table(spark, sf, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.sum(F.col("value").cast("decimal(18,4)")).alias("v"), F.count("*").alias("n"))
    months = F.array(*map(F.lit, num.MONTHS))
    head = F.concat(F.lit("Sektör / Olaylar ( "), F.dayofmonth("day"), F.lit(" "), F.element_at(months, F.month("day")), F.lit(" "), F.year("day"), F.lit(" Cuma ) (Milyon TL)"))
    spelt = F.translate(F.col("v").cast("string"), ".", ",")
    row = lambda v: F.concat(F.lit("<tr><th>1</th><th>"), head, F.lit("</th><th>TP</th><th>ADET</th></tr><tr><td>1</td><td> Toplam\n  olay (*)</td><td>"), v, F.lit("</td><td>"), F.col("n").cast("string"), F.lit("</td></tr>"))
    page = F.concat(F.lit("<html><table id='other'><tr><td>no</td></tr></table><table id=Tablo>"), row(F.lit("0")), F.lit("</table><table id=TabloExcel>"), row(spelt), F.lit("<tr><td></td><td>Başlık</td><td>-</td><td></td></tr></table></html>"))
    return x.select(F.concat_ws("/", "event_type", F.date_format("day", "yyyyMMdd"), F.lit("tablo289.html")).alias("path"), page.alias("content"))


def weekly_tree(spark, sf) -> str:
    return raw.archived(spark, sf, "weekly", lambda: weekly_files(spark, sf))


@query("WITH e AS (SELECT event_type AS currency, CAST(ts AS DATE) AS period, SUM(CAST(value AS DECIMAL(18,4)))::DOUBLE AS v, count(*)::DOUBLE AS n FROM events GROUP BY ALL) SELECT currency, 289 AS table_id, 'Toplam olay' AS label, 'TP' AS \"column\", period, round(v, 4) AS value FROM e UNION ALL SELECT currency, 289, 'Toplam olay', 'ADET', period, n FROM e")
def src_weekly_html(spark, sf):
    return bronze.weekly_points(raw.scan(spark, weekly_tree(spark, sf), "weekly")).select("currency", "table_id", "label", "column", "period", F.round("value", 4).alias("value"))


@query("SELECT event_type AS series_code, CAST(ts AS DATE) AS period, event_id, round(value, 6) AS value, 'series of ' || event_type AS name, 'D' AS frequency FROM events WHERE event_id % 7 <> 0 AND value IS NOT NULL")
def src_parquet_silver(spark, sf):
    """Every seventh figure is text and so none."""
    raw = lake.table(spark, sf, "events").select(F.col("event_type").alias("series_code"), F.struct(F.col("ts").cast("date").alias("p"), "event_id").alias("period"), F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"))
    x = bronze.silver(raw, config(spark, sf))
    return x.select("series_code", F.col("period.p").alias("period"), F.col("period.event_id").alias("event_id"), F.round("value", 6).alias("value"), "name", "frequency")


def config(spark, sf) -> DataFrame:
    """The configuration of the event series, written as one JSON document and read back through its schema."""
    code = F.col("event_type")
    entry = F.struct(F.concat(F.lit(" "), code).alias("code"), F.concat(F.lit("series of "), code).alias("name"), F.lit("d").alias("frequency"), F.lit("adet").alias("unit"))

    def write(root: str) -> None:
        few = lake.table(spark, sf, "events").select(code).distinct().agg(F.array_sort(F.collect_list(entry)).alias("series"))  # a few types
        doc = F.struct(F.lit("2024-01-01").alias("start_date"), F.lit("2026-12-31").alias("end_date"), F.lit(False).alias("complete"), F.lit("Events by type").alias("scope_note"), F.array(F.lit("none")).alias("known_gaps"), "series")
        few.select(F.to_json(doc, {"pretty": "true"}).alias("value")).coalesce(1).write.text(root)

    return bronze.read_config(spark, store.kept(spark, sf, "config", write))


@query("SELECT DISTINCT event_type AS code, 'series of ' || event_type AS name, 'adet' AS unit, 'D' AS frequency, 'none' AS gaps FROM events")
def src_config(spark, sf):
    return config(spark, sf)


@query("SELECT e.event_type AS code, count(*) AS n, any_value(c.unit) AS unit FROM events e LEFT JOIN (SELECT DISTINCT event_type, 'adet' AS unit FROM events WHERE event_type < 'p') c USING (event_type) GROUP BY 1")
def jn_config_lookup(spark, sf):
    n = lake.table(spark, sf, "events").groupBy(F.col("event_type").alias("code")).agg(F.count("*").alias("n"))
    return n.join(config(spark, sf).where("code < 'p'").select("code", "unit"), "code", "left").select("code", "n", "unit")


@query(SQL + "SELECT series_id, period, round(value, 6) AS value FROM flow WHERE series_id IN ('flow.NATION_1', 'flow.NATION_2') UNION ALL SELECT s, p, NULL FROM (SELECT DISTINCT period AS p FROM flow WHERE series_id IN ('flow.NATION_1', 'flow.NATION_2')), (VALUES ('flow.NATION_1'), ('flow.NATION_2')) t(s) WHERE NOT EXISTS (SELECT 1 FROM flow WHERE series_id = s AND period = p)")
def src_snapshot_json(spark, sf):
    names = ["flow.NATION_1", "flow.NATION_2"]
    x = lake.flow(spark, sf).where(F.col("series_id").isin(names)).withColumn("key", F.translate("series_id", ".", "_"))
    wide = x.groupBy("period").pivot("key", [n.replace(".", "_") for n in names]).agg(F.first("value"))
    return bronze.snapshot(wide).select(F.regexp_replace("series_id", "^flow_", "flow.").alias("series_id"), "period", F.round("value", 6).alias("value"))


@query(SQL + ", l AS (SELECT substr(sha256(series_id), 1, 3) AS b, series_id, concat_ws('|', series_id, observations, nonzero) AS line FROM catalog), h AS (SELECT b, sha256(string_agg(line, chr(10) ORDER BY series_id)) AS h, count(*) AS n FROM l GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY b)) AS digest, sum(n)::BIGINT AS n FROM h")
def snk_snapshot(spark, sf):
    return bronze.fingerprint(lake.catalog(spark, sf))


_NAMED = [("Konut Kredisi (TL, Akım, %)", "Yüzde"), ("Konut Kredisi Faiz Oranı", "%"), ("Ticari Krediler", "Ağırlıklı ortalama"), ("Konsolide Akım", "Bin TL"), ("Akım ve Stok", "Bin TL"), ("Bakım Giderleri", "Bin TL"), ("Fiyat Endeksi", ""), ("Fiyat", "2003=100"), ("Şube", "Adet"), ("Diğer", "")]
_UNITS = ", ".join(f"('{k}', '{s}', {v}::DOUBLE)" for k, (s, v) in num.UNITS.items())


@query("WITH s0(k, name, raw) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_NAMED)) + f"), s AS (SELECT p_partkey AS id, p_name || ' ' || name AS name, raw FROM part JOIN s0 ON k = p_partkey % {len(_NAMED)}), u(k, symbol, scale) AS (VALUES {_UNITS}), x AS (SELECT id, lower(translate(name, 'Iİ', 'ıi')) AS n, lower(translate(trim(raw), 'Iİ', 'ıi')) AS k FROM s) SELECT id, CASE WHEN k = 'adet' THEN 'count' WHEN symbol = 'endeks' THEN 'index' WHEN k = 'ağırlıklı ortalama' THEN 'rate' WHEN symbol = '%' THEN CASE WHEN contains(n, 'faiz') THEN 'rate' ELSE 'ratio' END WHEN contains(n, 'endeks') THEN 'index' WHEN k <> '' THEN CASE WHEN regexp_matches(n, '(^|[^\\p{{L}}])akım([^\\p{{L}}]|$)') AND NOT regexp_matches(n, '(^|[^\\p{{L}}])stok([^\\p{{L}}]|$)') THEN 'flow' ELSE 'stock' END ELSE 'unknown' END AS measure FROM x LEFT JOIN u USING (k)")
def prj_measure_evds(spark, sf):
    """The measure that a series' name and unit tell; names are those of parts before published ones."""
    few = spark.createDataFrame([(i, *r) for i, r in enumerate(_NAMED)], "k int, name string, raw string")
    x = lake.table(spark, sf, "part").join(F.broadcast(few), F.col("k") == F.col("p_partkey") % len(_NAMED))  # ten names
    return x.select(F.col("p_partkey").alias("id"), bronze.measure_by_name(F.concat_ws(" ", "p_name", "name"), F.col("raw")).alias("measure"))


_TITLED = [(11, "Likidite Yeterlilik Oranı", "Likidite (Bin TL)"), (12, "Yeterlilik (YÜZDE)", "Sermaye (milyon TL)"), (1, "Krediler (10+27+28)", "Bilanço (milyon TL), Dönem"), (16, "Şube", "Diğer"), (17, "Rasyo (Fon)", ""), (3, "x", "y")]


_TRAIL = lambda c: f"trim(regexp_extract({c}, '\\(([^()]*)\\)\\s*$', 1))"
_TITLES = "WITH t(k, no, label, caption) AS (VALUES " + ", ".join(f"({i}, {no}, '{a}', '{b}')" for i, (no, a, b) in enumerate(_TITLED)) + f"), u(w, symbol, scale) AS (VALUES {_UNITS}), "


@query(
    _TITLES + f"x AS (SELECT p_partkey AS id, no, CASE WHEN p_size % 3 = 0 THEN p_name || ' ' ELSE '' END || label AS label, caption FROM part JOIN t ON k = p_partkey % {len(_TITLED)}), y AS (SELECT *, {_TRAIL('label')} AS c FROM x), "
    "z AS (SELECT id, no, label, caption, CASE WHEN symbol IS NULL THEN '' ELSE c END AS own FROM y LEFT JOIN u ON w = lower(translate(c, 'Iİ', 'ıi'))) "
    "SELECT id, coalesce(CASE " + " ".join(f"WHEN no = {no} AND label = '{name}' THEN '{unit}'" for (no, name), (unit, _) in bronze.ROW_UNIT.items()) + " END, nullif(own, ''), nullif(trim(nullif(regexp_extract(caption, '^.*\\(([^()]*)\\)', 1), '')), ''), CASE no "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in bronze.MONTHLY_UNIT.items()) + " END, '') AS unit FROM z"
)
def prj_unit_priority(spark, sf):
    """A row's own exception, its label's unit, the caption's, the table's: the first there is, for a title of each part."""
    few = spark.createDataFrame([(i, *r) for i, r in enumerate(_TITLED)], "k int, no int, label string, caption string")
    x = lake.table(spark, sf, "part").join(F.broadcast(few), F.col("k") == F.col("p_partkey") % len(_TITLED))  # six titles
    label = F.concat(F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" "))).otherwise(""), "label")
    return x.select(F.col("p_partkey").alias("id"), bronze.unit_of(F.col("no"), label, F.col("caption")).alias("unit"))


@query(values("l", LABELS) + f", u(k, symbol, scale) AS (VALUES {_UNITS}), p AS (SELECT id, trim(regexp_extract(s, '\\(([^()]*)\\)\\s*$', 1)) AS c FROM l) SELECT id, CASE WHEN symbol IS NULL THEN '' ELSE c END AS unit FROM p LEFT JOIN u ON k = lower(translate(c, 'Iİ', 'ıi'))")
def str_trailing_unit(spark, sf):
    return frame(spark, LABELS, sf).select("id", bronze.trailing_unit(F.col("s")).alias("unit"))


@query("WITH x AS (SELECT p_partkey AS id, ['ytd', 'none', 'ambiguous'][p_size % 3 + 1] AS p, ['ytd', 'none', 'ambiguous'][p_partkey % 3 + 1] AS r FROM part) SELECT id, CASE WHEN r = 'ambiguous' THEN '' WHEN p <> 'ambiguous' THEN 'pattern' ELSE 'statement' END AS verified_by FROM x")
def prj_verifier(spark, sf):
    """Who vouches for how a series accumulates, from what its pattern says and what was resolved."""
    mode = lambda c: F.get(F.array(*map(F.lit, ("ytd", "none", "ambiguous"))), (F.col(c) % 3).cast("int"))
    return lake.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), bronze.verifier(mode("p_size"), mode("p_partkey")).alias("verified_by"))


_RAW = ["SEKTÖR", " Katılım ", "KATILIM", "KALKINMA VE YATIRIM", "yeni grup", "", "MEVDUAT-KAMU"]


@query(values("l", _RAW) + f", scopes(code, scope) AS (VALUES {_SCOPES}) SELECT id, coalesce(scope, trim(s)) AS scope FROM l LEFT JOIN scopes ON lower(translate(scope, 'Iİ', 'ıi')) = lower(translate(trim(s), 'Iİ', 'ıi'))")
def prj_canonical(spark, sf):
    return frame(spark, _RAW, sf).select("id", bronze.canonical(F.col("s"), tuple(bronze.SCOPES.values())).alias("scope"))


@query(values("l", LABELS) + rf"SELECT id, CASE WHEN k = '' THEN 'seri_' || id ELSE k END AS k FROM (SELECT id, trim(substr(regexp_replace({FOLD}, '[^\p{{L}}\p{{M}}\p{{N}}]', '_', 'g'), 1, 40), '_') AS k FROM l)")
def prj_column_key(spark, sf):
    return frame(spark, LABELS, sf).select("id", txt.column_key(F.col("s"), F.col("id")).alias("k"))


@query(SQL + "SELECT segment, count(DISTINCT priority) AS variants, array_to_string(list_sort(list(DISTINCT priority)), '|') AS found FROM facts GROUP BY 1 HAVING count(DISTINCT priority) > 1")
def agg_label_variants(spark, sf):
    """Normal forms that occur in more than one spelling: distinct pairs first, so a group holds spellings and not rows."""
    x = lake.order_facts(spark, sf).select("segment", "priority").distinct().groupBy("segment")
    return x.agg(F.count("*").alias("variants"), F.array_join(F.array_sort(F.collect_list("priority")), "|").alias("found")).where("variants > 1")


_VARIANTS = [(0, ["1", "2"], ["1,0", "2"], ["1,00", "2,0"]), (1, ["1,5", "2"], ["1", "2,5"], ["-", "x"]), (2, ["-"], ["1"], [""])]


_SPELT = "[[p_size || ',' || (p_partkey % 10), '2'], [p_size || ',' || (p_partkey % 100), '2,' || (p_size % 4)], ['-', repeat('7', CAST(p_partkey % 3 AS INT)) || ',' || repeat('5', CAST(p_partkey % 4 AS INT))]]"


@query(
    f"WITH v AS (SELECT p_partkey AS id, unnest({_SPELT}) AS cells, unnest([0, 1, 2]) AS k FROM part), c AS (SELECT id, k, unnest(cells) AS s FROM v), d AS (SELECT id, k, sum(length(regexp_extract(s, ',([0-9]+)$', 1))) AS score FROM c GROUP BY 1, 2) "
    "SELECT id, k AS best FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, k) AS n FROM d) WHERE n = 1"
)
def sort_precision_variant(spark, sf):
    """Of a table's variants the one whose cells are written with the most decimals, the first of equals."""
    cells = F.expr(_SPELT.replace("[", "array(").replace("]", ")"))
    x = lake.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.posexplode(cells).alias("k", "cells"))
    score = F.aggregate("cells", F.lit(0), lambda a, c: a + num.precision_of(c))
    return x.groupBy("id").agg(F.max_by("k", F.struct(score, -F.col("k"))).cast("int").alias("best"))


@query(
    "WITH h AS (SELECT page_id AS path, html, sha256(html) AS digest FROM pages), m AS (SELECT path, digest FROM h WHERE path % 83 <> 2 UNION ALL SELECT path, digest FROM h WHERE path % 89 = 1), "
    "s AS (SELECT path, sha256(CASE WHEN path % 50 = 7 THEN html || ' ' ELSE html END) AS now FROM h WHERE html IS NOT NULL AND path % 70 <> 3), l AS (SELECT path, count(*) AS n, any_value(digest) AS digest FROM m GROUP BY 1), "
    "x AS (SELECT l.path AS listed, s.path AS there, n, digest, now FROM l FULL JOIN s USING (path)) "
    "SELECT 'broken copy' AS data, sum(n)::BIGINT AS listed, count(*) FILTER (listed IS NOT NULL AND now IS NULL) AS absent, count(*) FILTER (listed IS NOT NULL AND now <> digest) AS altered, sum(n - 1)::BIGINT AS twice, count(*) FILTER (listed IS NULL) AS unlisted, "
    "(SELECT count(*) FROM h WHERE path NOT IN (SELECT path FROM l)) AS uncovered, 2::BIGINT AS units FROM x UNION ALL "
    "SELECT 'as stored', count(*), count(*) FILTER (html IS NULL), 0, count(*) - count(DISTINCT path), 0, 0, 1 FROM h"
)
def dq_bronze(spark, sf):
    """What a manifest lists against what is stored and what is expected: absent, altered, repeated and missing files, units that change. Over the pages as stored, and over a copy in which each of these is planted."""
    page = lake.table(spark, sf, "pages").select(F.col("page_id").alias("path"), "html")
    unit = F.lit("TRY")
    stored = page.where("html IS NOT NULL")
    whole = gates.bronze(page.select("path", F.sha2("html", 256).alias("digest")), stored.select("path", F.sha2("html", 256).alias("now"), unit.alias("unit")), page)
    lines = page.select("path", F.sha2("html", 256).alias("digest"))
    lines = lines.where("path % 83 <> 2").union(lines.where("path % 89 = 1"))
    changed = F.sha2(F.when(F.col("path") % 50 == 7, F.concat("html", F.lit(" "))).otherwise(F.col("html")), 256)
    broken = stored.where("path % 70 <> 3").select("path", changed.alias("now"), F.when(F.col("path") % 4 == 0, "USD").otherwise(unit).alias("unit"))
    return whole.select(F.lit("as stored").alias("data"), "*").union(gates.bronze(lines, broken, page).select(F.lit("broken copy"), "*"))


@query(
    "WITH tries AS (SELECT page_id, t, CASE WHEN page_id % 4 = 1 AND t = page_id % 6 THEN 200 ELSE 500 + t END AS status FROM pages, range(6) r(t) WHERE t <= page_id % 6 AND page_id % 7 <> 0), m AS (SELECT page_id, count(*) AS tried, bool_or(status = 200) AS done, arg_max(status, t) AS last FROM tries GROUP BY 1) "
    "SELECT url, p.page_id, coalesce(tried, 0) AS tried, least(60, 2 ** coalesce(tried, 0))::INT AS wait, last FROM pages p LEFT JOIN m USING (page_id) WHERE NOT coalesce(done, FALSE) AND coalesce(tried, 0) < 5 AND url IS NOT NULL"
)
def src_crawlers(spark, sf):
    """Where an interrupted crawl goes on: addresses without a fetched body in the manifest and with tries left, and how long each waits (twice as long after every try, a minute at most)."""
    page = lake.table(spark, sf, "pages").select("page_id", "url")
    n = F.col("page_id")
    tries = page.where(n % 7 != 0).select("page_id", F.explode(F.sequence(F.lit(0), (n % 6).cast("int"))).alias("t")).withColumn("status", F.when((n % 4 == 1) & (F.col("t") == n % 6), 200).otherwise(F.col("t") + 500))
    return bronze.resumed(page.where("url IS NOT NULL"), tries, 5)


_LINES = "WITH l AS (SELECT s_nationkey AS source, s_suppkey AS n, sha256(concat_ws('|', s_suppkey, s_name)) AS h FROM supplier), m AS (SELECT source, n % 11 = 3 AS broken, CASE WHEN n % 11 <> 3 AND n % 7 <> 2 AND source % 10 <> 6 THEN h END AS h, CASE WHEN n % 11 <> 3 AND n % 13 <> 5 THEN DATE '2024-01-01' + (n % 400)::INT END AS day FROM l) "


def manifest_tree(spark, sf) -> str:
    """Lists of fetched files as crawlers append them, a folder for each source: a line for each supplier. Some lines are torn, some have no digest, some an unreadable time, and one source in ten has no digests at all."""
    n = F.col("s_suppkey")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 400).cast("int")), "yyyy-MM-dd")
    sha = F.when((n % 7 != 2) & (F.col("s_nationkey") % 10 != 6), F.sha2(F.concat_ws("|", "s_suppkey", "s_name"), 256))
    whole = F.to_json(F.struct(F.col("s_name").alias("path"), sha.alias("sha256"), F.when(n % 13 == 5, "soon").otherwise(F.concat(day, F.lit("T08:30:00+00:00"))).alias("fetched_at")))
    line = F.when(n % 11 == 3, F.substring(whole, F.lit(1), F.length(whole) - 9)).otherwise(whole)
    lines = lake.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("source"), line.alias("value"))
    return store.kept(spark, sf, "manifest", lambda root: lines.write.partitionBy("source").text(root))


@query(
    _LINES + ", b AS (SELECT source, substr(h, 1, 2) AS k, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM m WHERE h IS NOT NULL GROUP BY ALL), d AS (SELECT source, sha256(string_agg(d, '' ORDER BY k)) AS digest, sum(n)::BIGINT AS files FROM b GROUP BY 1) "
    "SELECT source, digest, max(day) AS newest, coalesce(any_value(files), 0) AS files, count(*) FILTER (broken) AS malformed FROM m LEFT JOIN d USING (source) GROUP BY source, digest"
)
def src_provenance(spark, sf):
    """What the manifests say of each source: a digest of its files that doesn't depend on their order, the newest fetch, how many files have a digest, and how many lines are broken."""
    lines = bronze.manifest(spark, manifest_tree(spark, sf), "source")
    return bronze.provenance(lines).select("source", "digest", F.col("newest").cast("date").alias("newest"), "files", "malformed")


_POP = (
    "WITH n AS (SELECT c_nationkey AS k, count(*) AS people, sum(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE AS money FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS branches FROM supplier GROUP BY 1), "
    "x AS (SELECT k, branches, round(people::DOUBLE / branches, 3) AS ppb, round(money / people / 1000, 5) AS mph, money FROM n JOIN s USING (k)), y AS (SELECT k, branches, ppb, CASE WHEN k % 10 = 3 THEN mph * 1000 ELSE mph END AS mph, money FROM x) "
)


def published(spark, sf) -> DataFrame:
    """A quarter's table of provinces as published: branches, people of a branch, thousands of a person, each rounded, and the total."""
    n = lake.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("people"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("money"))
    s = lake.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("branches"))
    return n.join(s, "k").select("k", "branches", F.round(F.col("people") / F.col("branches"), 3).alias("people_per_branch"), F.round(F.col("money") / F.col("people") / 1000, 5).alias("money_per_head"), "money")


@query(_POP + "SELECT k, round(money, 2) AS published, round(branches * ppb * mph * 1000, 2) AS rebuilt FROM x")
def jn_population_check(spark, sf):
    """A total rebuilt from the three rounded columns that are published beside it."""
    return gates.rebuilt_units(published(spark, sf)).select("k", F.round("money", 2).alias("published"), F.round("rebuilt", 2).alias("rebuilt"))


_REC = SQL + ", x AS (SELECT a.series_id, b.value / a.value AS r FROM flow a JOIN ytd b ON substr(a.series_id, 6) = substr(b.series_id, 5) AND a.period = b.period WHERE a.value <> 0), m AS (SELECT series_id, pow(10.0, round(log10(median(r)))) AS scale FROM x WHERE r > 0 GROUP BY 1), y AS (SELECT series_id, r / scale AS q FROM x JOIN m USING (series_id)) "


@query(_REC + "SELECT series_id, scale FROM m")
def num_power10(spark, sf):
    a = lake.flow(spark, sf).where("value <> 0").select(F.substring("series_id", 6, 99).alias("k"), "series_id", "period", F.col("value").alias("a"))
    b = lake.ytd(spark, sf).select(F.substring("series_id", 5, 99).alias("k"), "period", F.col("value").alias("b"))
    r = a.join(b, ["k", "period"]).withColumn("r", F.col("b") / F.col("a")).where("r > 0")
    return r.groupBy("series_id").agg(num.power10(F.median("r")).alias("scale"))


@query(SQL + "SELECT series_id, period, round(value * 1000, 2) AS value FROM flow")
def num_scale(spark, sf):
    return lake.flow(spark, sf).select("series_id", "period", F.round(F.col("value") * num.normalise_unit(F.lit("bin tl"))[1], 2).alias("value"))


@query(SQL + "SELECT series_id, round((arg_max(value, period) - arg_min(value, period)) * 100 / abs(nullif(arg_min(value, period), 0)), 6) AS pct FROM flow GROUP BY 1")
def num_pct_change(spark, sf):
    x = lake.flow(spark, sf).groupBy("series_id").agg(F.min_by("value", "period").alias("a"), F.max_by("value", "period").alias("b"))
    return x.select("series_id", F.round(num.pct_change(F.col("a"), F.col("b")), 6).alias("pct"))


_SPELL = [1234567.89, 0.5, -1234.0, 1000000.0, 12.34567, 0.0]


@query(
    "WITH v AS (SELECT p_partkey AS id, CASE WHEN p_partkey < 6 THEN [" + ", ".join(f"{x}::DOUBLE" for x in _SPELL) + "][p_partkey + 1] ELSE (p_retailprice - 950) * p_size * (p_partkey % 7) / 8 END AS x FROM part) "
    "SELECT id, regexp_replace(regexp_replace(replace(replace(replace(format('{:,.4f}', x), ',', '#'), '.', ','), '#', '.'), '(,[0-9]*?)0+$', '\\1'), ',$', '') AS spelt FROM v"
)
def num_tr_format(spark, sf):
    """Figures of all parts, written with a comma and dots."""
    k = F.col("p_partkey")
    x = F.when(k < 6, F.get(F.array(*map(F.lit, _SPELL)), k.cast("int"))).otherwise((F.col("p_retailprice") - 950) * F.col("p_size") * (k % 7) / 8)
    return lake.table(spark, sf, "part").select(k.alias("id"), num.format_tr(x).alias("spelt"))


_CLOSED = SQL + ", g AS (SELECT series_id, period, value AS rep, CASE WHEN row_number() OVER w = 1 THEN value ELSE value - lag(value) OVER w END AS own FROM ytd WINDOW w AS (PARTITION BY series_id, year(period) ORDER BY period)), c AS (SELECT series_id, year(period)::INT AS year, sum(CAST(own AS DECIMAL(18,2)))::DOUBLE AS total, max(CASE WHEN month(period) = 12 THEN rep END) AS december, count(own) AS n FROM g GROUP BY 1, 2) "


@query(_CLOSED + "SELECT series_id, year, abs(total - december) <= 0.01 * abs(december) AS closes FROM c WHERE december IS NOT NULL AND abs(december) > 1 AND n = 12")
def win_closure(spark, sf):
    from tidelake.operators import accumulation as acc

    return acc.closure(acc.decumulate(lake.ytd(spark, sf)), tolerance=0.01).select("series_id", "year", "closes")


@query(SQL + ", p AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_orderstatus AS st, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS whole FROM orders GROUP BY ALL), c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_orderstatus AS st, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS parts FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) SELECT st, count(*) AS n, max(round(abs(whole - coalesce(parts, 0)), 2)) AS worst FROM p LEFT JOIN c USING (period, st) GROUP BY 1")
def agg_partition_sum(spark, sf):
    """The widest gap of a status' months between the orders as stored and those that a customer and a nation are known of."""
    orders = lake.table(spark, sf, "orders").select(lake.month("o_orderdate").alias("period"), F.col("o_orderstatus").alias("st"), "o_totalprice", F.col("o_custkey").alias("c_custkey"))
    known = orders.join(lake.table(spark, sf, "customer"), "c_custkey").join(lake.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    whole, parts = (x.groupBy("period", "st").agg(lake.money("o_totalprice").alias(c)) for x, c in ((orders, "whole"), (known, "parts")))
    gap = F.round(F.abs(F.col("whole") - F.coalesce("parts", F.lit(0.0))), 2)
    return whole.join(parts, ["period", "st"], "left").groupBy("st").agg(F.count("*").alias("n"), F.max(gap).alias("worst"))


@query(SQL + ", s AS (SELECT series_id, period, value, lag(period) OVER (PARTITION BY series_id ORDER BY period) AS before FROM flow) SELECT series_id, count(*) AS n, count(*) > 0 AND coalesce(bool_and(before IS NULL OR period > before), TRUE) AS valid FROM s GROUP BY 1")
def val_spine(spark, sf):
    before = F.lag("period").over(Window.partitionBy("series_id").orderBy("period"))
    x = lake.flow(spark, sf).withColumn("ok", F.coalesce(F.col("period") > before, F.lit(True)))
    return x.groupBy("series_id").agg(F.count("*").alias("n"), F.bool_and("ok").alias("valid"))


@query(SQL + ", j AS (SELECT f.series_id, f.value, p.value AS x FROM flow f LEFT JOIN price p USING (period)) SELECT series_id, count(*) FILTER (x IS NOT NULL AND value IS NOT NULL) AS kept, count(*) FILTER (x IS NULL OR value IS NULL) AS dropped FROM j GROUP BY 1")
def val_drop_missing(spark, sf):
    """Rows of a pair where either side is missing are dropped and counted."""
    x = lake.flow(spark, sf).join(lake.price_index(spark, sf).select("period", F.col("value").alias("x")), "period", "left")
    whole = F.col("x").isNotNull() & F.col("value").isNotNull()
    return x.groupBy("series_id").agg(F.count_if(whole).alias("kept"), F.count_if(~whole).alias("dropped"))
