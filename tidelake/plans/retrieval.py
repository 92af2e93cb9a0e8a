"""Queries from questions to series over a catalog of parts: a label is a part's name, a source its type, a series one part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.functions import retrieval, routing
from tidelake.functions import text as txt
from tidelake.plans.registry import query
from tidelake.plans.words import CUE_SQL, FOLD, LEX_SQL, TOK, frame, literal, rows, values
from tidelake.sources import lake

ASKED = [
    "red widget fiyatı", "small ring bakiyesi mevduat", "blue bolt NATION_3 döviz", "hot gear faiz oranı", "zzz bulunmaz", "widgets ve rings", "gears faizi katılım göster", "red widget ile blue bolt arasında nedensellik var mı",
    "small ring anomali", "blue bolt rejim kırılma", "hot gear adet NATION_7", "", "https://example.org/a", "green gear", "widget sayısı kamu tp", "hava nasıl",
]
_SCOPES = ["Sektör", "Mevduat", "Katılım", "Kamu", "Yabancı"]
_KINDS = ["rate", "stock", "flow", "count"]


def parts(spark, sf) -> DataFrame:
    """A catalog of parts: series_id, source, raw_label, measure_type, sector_scope, province, currency_basis, native_freq, has_data (it was shipped)."""
    shipped = lake.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("has_data", F.lit(True))
    k, at = F.col("p_partkey"), lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n + 1).cast("int"))
    x = lake.table(spark, sf, "part").join(shipped, "p_partkey", "left")
    return x.select(
        F.concat(F.lit("part."), k).alias("series_id"), F.lower("p_type").alias("source"), F.col("p_name").alias("raw_label"), at(_KINDS, F.col("p_size") % 4).alias("measure_type"),
        F.when(k % 11 > 0, at(_SCOPES, k % 5)).alias("sector_scope"), F.when(k % 3 == 0, F.concat(F.lit("NATION_"), k % 25)).alias("province"), F.when(F.col("p_type") != "ECONOMY", at(["TP", "YP", "Toplam"], k % 3)).alias("currency_basis"),
        at(["M", "W", "Q", "D"], k % 4).alias("native_freq"), F.coalesce("has_data", F.lit(False)).alias("has_data"),
    )


def places(spark, sf) -> DataFrame:
    return lake.table(spark, sf, "nation").select(F.col("n_name").alias("province"))


def asked(spark) -> DataFrame:
    return rows(spark, ASKED)


_FACET = lambda cues: "CASE " + " ".join("WHEN " + " AND ".join(f"list_contains(t, '{w}')" for w in cue.split()) + f" THEN '{v}'" for cue, v in cues.items()) + " END"
_BASE = (
    literal("l", ASKED) + ", cat AS (SELECT 'part.' || p_partkey AS series_id, lower(p_type) AS source, p_name AS raw_label, ['rate', 'stock', 'flow', 'count'][p_size % 4 + 1] AS measure_type, "
    "CASE WHEN p_partkey % 11 > 0 THEN ['Sektör', 'Mevduat', 'Katılım', 'Kamu', 'Yabancı'][p_partkey % 5 + 1] END AS sector_scope, CASE WHEN p_partkey % 3 = 0 THEN 'NATION_' || (p_partkey % 25) END AS province, "
    "CASE WHEN p_type <> 'ECONOMY' THEN ['TP', 'YP', 'Toplam'][p_partkey % 3 + 1] END AS currency_basis, ['M', 'W', 'Q', 'D'][p_partkey % 4 + 1] AS native_freq, p_partkey IN (SELECT l_partkey FROM lineitem) AS has_data FROM part), "
    "con AS (SELECT raw_label AS label, source, count(*) AS series_count, bool_or(has_data) AS has_data, list_sort(list(DISTINCT measure_type)) AS kinds FROM cat GROUP BY ALL), "
    f"lt AS (SELECT label || '|' || source AS id, {TOK.replace(FOLD, FOLD.replace('(s)', '(label)'))} AS c FROM con) "
)


def _ranked(base: str, limit: int, intent: bool) -> str:
    """hits: the ranked concepts of l's questions."""
    fit = "len(want) = 0 OR list_has_any(want, kinds)" if intent else "TRUE"
    return (
        base + f", qt AS (SELECT id AS qid, {TOK} AS q FROM l), {LEX_SQL}, {CUE_SQL}, near AS (SELECT qid, con.*, score, coalesce(want, []) AS want FROM scored s JOIN con ON s.id = label || '|' || source LEFT JOIN wants USING (qid) WHERE score >= 0.35), "
        f"fit AS (SELECT *, {fit} AS fits FROM near), ok AS (SELECT *, bool_or(fits) OVER (PARTITION BY qid) AS intent_satisfied FROM fit), "
        f"hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY has_data DESC, round(score, 9) DESC, series_count, label, source) AS rank FROM ok WHERE fits OR NOT intent_satisfied) WHERE rank <= {limit}) "
    )


@query(_ranked(_BASE, 5, False) + "SELECT qid AS id, label, source, rank::INT AS rank, round(score, 6) AS score FROM hits")
def top_search(spark, sf):
    known = retrieval.concepts(parts(spark, sf))
    return retrieval.ranked(retrieval.scores(asked(spark), known), 5).select("id", "label", "source", "rank", F.round("score", 6).alias("score"))


@query(_ranked(_BASE, 10, True) + "SELECT qid AS id, label, source, rank::INT AS rank, intent_satisfied FROM hits")
def nl_resolve(spark, sf):
    return retrieval.resolve(asked(spark), retrieval.concepts(parts(spark, sf)), 10).select("id", "label", "source", "rank", "intent_satisfied")


def _resolved(base: str) -> str:
    """picked: the series of l's questions."""
    out = _ranked(base, retrieval.DEPTH, True)
    out += f", k AS (SELECT id, {TOK} AS t FROM l), named AS (SELECT id, coalesce({_FACET(routing.SCOPE_CUES)}, 'Sektör') AS sc, ({_FACET(routing.SCOPE_CUES)}) IS NOT NULL AS ssc, coalesce({_FACET(routing.CURRENCY_CUES)}, 'Toplam') AS cu, ({_FACET(routing.CURRENCY_CUES)}) IS NOT NULL AS scu, (SELECT min(n_name) FROM nation WHERE list_has_all(t, {TOK.replace(FOLD, FOLD.replace('(s)', '(n_name)'))})) AS pr FROM k)"
    out += ", r0 AS (SELECT qid, rank, intent_satisfied, h.label, h.source, series_id, sector_scope, province, currency_basis, native_freq, sc, ssc, cu, scu, pr FROM hits h JOIN cat ON raw_label = h.label AND cat.source = h.source JOIN named ON named.id = qid)"
    for i, (facet, want, stated) in enumerate((("sector_scope", "sc", "ssc"), ("province", "pr", "pr IS NOT NULL"), ("currency_basis", "cu", "scu")), 1):
        out += f", r{i} AS (SELECT * EXCLUDE (a) FROM (SELECT *, bool_or({facet} IS NOT NULL) OVER (PARTITION BY qid, rank) AS a FROM r{i - 1}) WHERE CASE WHEN a THEN {facet} IS NOT DISTINCT FROM {want} ELSE NOT ({stated}) END)"
    out += ", best AS (SELECT * FROM r3 QUALIFY rank = min(rank) OVER (PARTITION BY qid)), picked AS (SELECT *, TRUE AS narrowed FROM best UNION ALL SELECT *, FALSE FROM r0 WHERE rank = 1 AND qid NOT IN (SELECT qid FROM best)) "
    return out


@query(_resolved(_BASE) + "SELECT qid AS id, label, source, rank::INT AS rank, intent_satisfied, narrowed, series_id FROM picked")
def nl_resolve_series(spark, sf):
    return retrieval.resolve_series(asked(spark), parts(spark, sf), places(spark, sf))


def shipments(spark, sf) -> DataFrame:
    """Monthly money of each part."""
    x = lake.table(spark, sf, "lineitem").groupBy(F.concat(F.lit("part."), "l_partkey").alias("series_id"), lake.month("l_shipdate").alias("period"))
    return x.agg(lake.money("l_extendedprice").alias("value"))


_ANALYZED = (
    _resolved(_BASE) + ", few AS (SELECT * FROM (SELECT qid, label, series_id, narrowed, intent_satisfied, row_number() OVER (PARTITION BY qid ORDER BY series_id) AS k FROM picked) WHERE k <= 3), "
    "obs AS (SELECT 'part.' || l_partkey AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS period, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem GROUP BY ALL), "
    "found AS (SELECT qid, label, series_id, narrowed, intent_satisfied, count(*) AS n, arg_min(value, period) AS first, arg_max(value, period) AS last, max(value) AS peak FROM few JOIN obs USING (series_id) WHERE period BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' GROUP BY ALL), "
    "pct AS (SELECT *, (last - first) * 100 / abs(nullif(first, 0)) AS pct FROM found) "
)


@query(_ANALYZED + "SELECT qid AS id, label, series_id, n, round(first, 2) AS first, round(last, 2) AS last, round(peak, 2) AS peak, round(pct, 4) AS pct FROM pct")
def nl_analyze(spark, sf):
    """From questions to findings: at most three series each, over a fixed window."""
    x = retrieval.analyze(retrieval.resolve_series(asked(spark), parts(spark, sf), places(spark, sf)), shipments(spark, sf), "1995-01-01", "2001-12-31")
    return x.select("id", "label", "series_id", "n", F.round("first", 2).alias("first"), F.round("last", 2).alias("last"), F.round("peak", 2).alias("peak"), F.round("pct", 4).alias("pct"))


@query(
    _ANALYZED + "SELECT qid AS id, string_agg(series_id || ': ' || format('{:,.2f}', first) || ' -> ' || format('{:,.2f}', last) || ' (' || format('{:,.1f}', pct) || '%)', chr(10) ORDER BY series_id || ': ' || format('{:,.2f}', first)) || CASE WHEN narrowed THEN '' ELSE chr(10) || 'No measure has the breakdown asked for; none was applied.' END "
    "|| CASE WHEN intent_satisfied THEN '' ELSE chr(10) || 'The measure asked for isn''t published; the nearest is shown.' END AS text FROM pct GROUP BY qid, narrowed, intent_satisfied"
)
def txt_answer(spark, sf):
    return retrieval.answer(retrieval.analyze(retrieval.resolve_series(asked(spark), parts(spark, sf), places(spark, sf)), shipments(spark, sf), "1995-01-01", "2001-12-31"))


_TOOL = "CASE WHEN regexp_matches(lower(s), 'https?://\\S') THEN 'url_agent' " + " ".join("WHEN " + " OR ".join("contains(lower(s), '" + c.replace("'", "''") + "')" for c in cues) + f" THEN '{tool}'" for tool, cues in routing.TOOL_CUES.items()) + " END"
_SPLIT = _BASE.replace("WITH l(id, s)", "WITH asked(id, s)").replace(
    ", cat AS", rf", routed AS (SELECT id, s, {_TOOL} AS tool FROM asked), pieces AS (SELECT id, unnest(x) AS s, generate_subscripts(x, 1) - 1 AS part FROM (SELECT id, CASE WHEN tool = 'causality' THEN string_split_regex(s, '(?i)\s+(?:ile|ve|arasında|karşı)\s+') ELSE [s] END AS x FROM routed)), l AS (SELECT id * 100 + part AS id, trim(s, ' ?.,') AS s FROM pieces WHERE trim(s, ' ?.,') <> ''), cat AS", 1
)
_OF = lambda table, tool: f"CASE WHEN tool = '{tool}' THEN coalesce(CASE freq " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" END, {table['M']}) END"


@query(
    _resolved(_SPLIT) + ", one AS (SELECT qid, min(series_id) AS series_id FROM picked GROUP BY 1), of AS (SELECT qid // 100 AS id, o.series_id, min(qid) AS at, any_value(native_freq) AS freq FROM one o JOIN cat USING (series_id) GROUP BY 1, 2), "
    "two AS (SELECT id, list(series_id ORDER BY of.at, series_id)[1:2] AS s, list(freq ORDER BY of.at, series_id)[1] AS freq FROM of GROUP BY 1), "
    "y AS (SELECT r.id, tool, CASE WHEN tool IN ('anomaly', 'change_detection', 'lakehouse') THEN 1 WHEN tool = 'causality' THEN 2 ELSE 0 END AS needs, coalesce(two.s, []) AS s, freq FROM routed r LEFT JOIN two USING (id)) "
    f"SELECT id, tool, array_to_string(s[1:needs], ' ') AS series, {_OF(retrieval.CYCLE, 'anomaly')} AS period, {_OF(retrieval.SHORTEST, 'change_detection')} AS shortest, CASE WHEN tool IS NULL THEN 'no tool' WHEN len(s[1:needs]) < needs THEN 'too few series' ELSE '' END AS refusal FROM y"
)
def nl_dispatch(spark, sf):
    return retrieval.dispatch(asked(spark), parts(spark, sf), places(spark, sf)).withColumn("series", F.array_join("series", " "))


_FLT = _BASE.replace(", cat AS", ", cat_ AS", 1).replace(", con AS", ", cat AS (SELECT * FROM cat_ WHERE measure_type = 'stock' AND province IS NULL), con AS", 1).replace("(3, 'hot gear faiz oranı')", "(3, 'hot gear faiz oranı')")


@query(_ranked(_FLT, 30, False) + "SELECT id, series_id, score FROM (SELECT h.qid AS id, series_id, round(score, 6) AS score, row_number() OVER (PARTITION BY h.qid ORDER BY round(score, 9) DESC, series_id) AS k FROM hits h JOIN cat ON raw_label = label AND cat.source = h.source) WHERE k <= 10")
def flt_discover(spark, sf):
    """Series by exact facets, then ranked by the words of each question, at most ten of each."""
    from pyspark.sql import Window

    rows_ = parts(spark, sf).where("measure_type = 'stock' AND province IS NULL")
    hits = retrieval.ranked(retrieval.scores(asked(spark), retrieval.concepts(rows_))).select("id", F.col("label").alias("raw_label"), "source", "score")
    by = Window.partitionBy("id").orderBy(F.desc(F.round("score", 9)), "series_id")
    return hits.join(rows_, ["raw_label", "source"]).withColumn("k", F.row_number().over(by)).where("k <= 10").select("id", "series_id", F.round("score", 6).alias("score"))


#: The three published turns, each known by one phrase of every group, without marks on letters; the first that fits counts.
TURNS = (
    (3, (("konut fiyat endeksi", "fiyat endeksini", "kfe"), ("ekle", "sutun", "nedeni", "olabilir"))),
    (2, (("kredi",), ("enflasyondan arindir", "reel", "sabit fiyat", "deflat"))),
    (1, (("konut",), ("kredi",), ("faiz",))),
)
PUBLISHED = ["Konut kredileri ve faizleri", "Kredileri ENFLASYONDAN  arındır", "Konut fiyat endeksini sütun olarak ekle", "kfe", "reel kredi"]


@query(values("l", ASKED + PUBLISHED) + rf", f AS (SELECT id, trim(regexp_replace(translate({FOLD}, '{txt.FOLD_FROM}', '{txt.FOLD_TO}'), '\s+', ' ', 'g')) AS s FROM l) SELECT id, CASE " + " ".join("WHEN " + " AND ".join("(" + " OR ".join(f"contains(s, '{c}')" for c in some) + ")" for some in groups) + f" THEN {k}" for k, groups in TURNS) + " END AS turn FROM f")
def nl_turn_classifier(spark, sf):
    """Which published turn a question is, for questions of all parts."""
    folded, out = txt.collapse_space(txt.fold_ascii(F.col("s"))), None
    for k, groups in TURNS:
        here = F.lit(True)
        for some in groups:
            here = here & F.array_contains(F.transform(F.array(*map(F.lit, some)), lambda c: F.contains(folded, c)), True)
        out = F.when(here, k) if out is None else out.when(here, k)
    return frame(spark, ASKED + PUBLISHED, sf).select("id", out.alias("turn"))
