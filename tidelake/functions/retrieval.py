"""From a question to series: concepts ranked by words, filtered by what the question says of the measure, narrowed by the facets it names. All over tables of questions and series; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions import routing
from tidelake.functions import text as txt

MIN_SCORE, DEPTH = 0.35, 30
#: Observations of a seasonal cycle, and the shortest run that counts as a regime, by frequency.
CYCLE = {"D": 7, "W": 52, "M": 12, "Q": 4}
SHORTEST = {"D": 14, "W": 8, "M": 6, "Q": 3}
FACETS = ("sector_scope", "province", "currency_basis")


class LimitRefused(ValueError):
    """More results were asked for than are given at once, or none."""


def concepts(series: DataFrame) -> DataFrame:
    """(label, source, series_count, has_data, measure_types, words) of the measures behind a catalog (raw_label, source, measure_type, has_data)."""
    x = series.groupBy(F.col("raw_label").alias("label"), "source").agg(F.count("*").alias("series_count"), F.bool_or("has_data").alias("has_data"), F.array_sort(F.collect_set("measure_type")).alias("measure_types"))
    return x.withColumn("words", txt.tokenize(txt.strip_formulas(F.col("label")))).where(F.size("words") > 0)


def _stems(words: str) -> Column:
    """What two tokens have in common if they count for each other: the token, if it is short, else its first letters."""
    return F.explode(F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, txt.MIN_STEM))))


def lexical_scores(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """(qid, id, score) of the questions (qid, q: tokens) and labels (id, c: tokens) that share a stem; all other pairs score 0. Each kind of token array is scored once, however many labels have it."""
    kinds = labels.groupBy("c").agg(F.min("id").alias("kind"))
    near = questions.select("qid", _stems("q").alias("stem")).join(kinds.select("kind", _stems("c").alias("stem")), "stem").select("qid", "kind").distinct()
    scored = near.join(questions, "qid").join(kinds, "kind").select("qid", "c", txt.lexical_score(F.col("q"), F.col("c")).alias("score")).where("score > 0")
    return scored.join(labels, "c").select("qid", "id", "score")


def scores(questions: DataFrame, known: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(id, asked, and the columns of known, score) of the concepts near a question. Pairs come from an inverted index of stems, so none is made that shares nothing."""
    asked = questions.select("id", txt.tokenize(F.col("s")).alias("asked")).where(F.size("asked") > 0)
    near = asked.select("id", _stems("asked").alias("stem")).join(known.select("label", "source", _stems("words").alias("stem")), "stem").select("id", "label", "source").distinct()
    x = near.join(asked, "id").join(known, ["label", "source"])
    return x.withColumn("score", txt.lexical_score(F.col("asked"), F.col("words"))).where(F.col("score") >= min_score)


def ranked(scored: DataFrame, limit: int = DEPTH) -> DataFrame:
    """The best concepts of each question with their rank from 1: those with data first, then by score, then those with fewer series, then by label and source."""
    if not 1 <= limit <= 100:
        raise LimitRefused(f"{limit} results; 1 to 100 are given")
    by = Window.partitionBy("id").orderBy(F.desc("has_data"), F.desc(F.round("score", 9)), "series_count", "label", "source")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def resolve(questions: DataFrame, known: DataFrame, limit: int = DEPTH) -> DataFrame:
    """ranked() with the measure a question asks for as a filter. Where no concept of that measure is near, all are taken and intent_satisfied is false."""
    x = scores(questions, known).withColumn("intent", txt.intent(F.col("asked")))
    x = x.withColumn("fits", (F.size("intent") == 0) | F.arrays_overlap("intent", "measure_types"))
    x = x.withColumn("intent_satisfied", F.bool_or("fits").over(Window.partitionBy("id"))).where(F.col("fits") | ~F.col("intent_satisfied"))
    return ranked(x, limit)


def narrowed(rows: DataFrame, wanted: dict[str, Column], stated: dict[str, Column], by: list[str]) -> DataFrame:
    """rows of each group narrowed by facet after facet. A facet that no row of the group has is passed over, unless the question states it: then nothing is left. A null province is nationwide, a value like others."""
    for facet in FACETS:
        own = F.nullif(F.col(facet), F.lit(""))
        rows = rows.withColumn("__any", F.bool_or(own.isNotNull()).over(Window.partitionBy(*by)))
        rows = rows.where(F.when(F.col("__any"), own.eqNullSafe(wanted[facet])).otherwise(~stated[facet])).drop("__any")
    return rows


def resolve_series(questions: DataFrame, series: DataFrame, places: DataFrame) -> DataFrame:
    """(id, label, source, rank, intent_satisfied, narrowed, series_id): for each question the series of the best concept that has the facets asked for; where none has, all series of the best, and narrowed is false."""
    hits = resolve(questions, concepts(series)).select("id", "label", "source", "rank", "intent_satisfied")
    named = routing.provinces(questions, places).select("id", F.col("province").alias("__province"), routing.scope(F.col("s")).alias("__scope"), routing.currency(F.col("s")).alias("__currency"))
    rows = hits.join(series.withColumnRenamed("raw_label", "label"), ["label", "source"]).join(named, "id")
    wanted = {"sector_scope": F.col("__scope.value"), "province": F.col("__province"), "currency_basis": F.col("__currency.value")}
    stated = {"sector_scope": F.col("__scope.stated"), "province": F.col("__province").isNotNull(), "currency_basis": F.col("__currency.stated")}
    some = narrowed(rows, wanted, stated, ["id", "rank"]).withColumn("narrowed", F.lit(True))
    least = F.min("rank").over(Window.partitionBy("id"))
    chosen = some.withColumn("__least", least).where("rank = __least").drop("__least")
    rest = rows.where("rank = 1").join(chosen.select("id").distinct(), "id", "left_anti").withColumn("narrowed", F.lit(False))
    return chosen.unionByName(rest).select("id", "label", "source", "rank", "intent_satisfied", "narrowed", "series_id")


def dispatch(questions: DataFrame, series: DataFrame, places: DataFrame) -> DataFrame:
    """(id, tool, series, period, shortest, refusal): the tool of each question, the one or two series it works on, and its parameters by the first series' frequency. A question that names two things is resolved part by part."""
    x = questions.select("id", "s", routing.tool(F.col("s")).alias("tool"))
    parts = x.select("id", F.posexplode(F.when(F.col("tool") == "causality", txt.split_pair(F.col("s"))).otherwise(F.array("s"))).alias("part", "s"))
    parts = parts.select((F.col("id") * 100 + F.col("part")).alias("id"), F.btrim("s", F.lit(" ?.,")).alias("s")).where("s <> ''")
    found = resolve_series(parts, series, places).groupBy("id").agg(F.min("series_id").alias("series_id"))
    found = found.join(series.select("series_id", "native_freq"), "series_id")
    of = found.groupBy(F.floor(F.col("id") / 100).alias("id"), "series_id").agg(F.min("id").alias("at"), F.first("native_freq").alias("freq"))
    of = of.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "series_id", "freq"))), 1, 2).alias("x"))
    needs = F.when(F.col("tool").isin("anomaly", "change_detection", "lakehouse"), 1).when(F.col("tool") == "causality", 2).otherwise(0)
    x = x.join(of, "id", "left").withColumn("needs", needs).withColumn("series", F.slice(F.coalesce(F.transform("x", lambda s: s["series_id"]), F.array().cast("array<string>")), F.lit(1), F.col("needs")))
    freq = F.get("x", 0)["freq"]
    pick = lambda table, tool: F.when(F.col("tool") == tool, F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), freq), F.lit(table["M"])))
    refusal = F.when(F.col("tool").isNull(), "no tool").when(F.size("series") < F.col("needs"), "too few series").otherwise("")
    return x.select("id", "tool", "series", pick(CYCLE, "anomaly").alias("period"), pick(SHORTEST, "change_detection").alias("shortest"), refusal.alias("refusal"))


def analyze(resolved: DataFrame, observations: DataFrame, start: str, end: str, most: int = 3) -> DataFrame:
    """(id, label, series_id, n, first, last, pct, peak) of up to most series of each question over a window of observations (series_id, period, value)."""
    by = Window.partitionBy("id").orderBy("series_id")
    few = resolved.withColumn("__k", F.row_number().over(by)).where(F.col("__k") <= most).select("id", "label", "series_id", "narrowed", "intent_satisfied")
    x = observations.where(F.col("period").between(start, end) & F.col("value").isNotNull()).join(few, "series_id").groupBy("id", "label", "series_id", "narrowed", "intent_satisfied")
    x = x.agg(F.count("*").alias("n"), F.min_by("value", "period").alias("first"), F.max_by("value", "period").alias("last"), F.max("value").alias("peak"))
    return x.withColumn("pct", F.try_divide((F.col("last") - F.col("first")) * 100, F.abs("first")))


def answer(found: DataFrame) -> DataFrame:
    """(id, text): what was found for each question, a line for each series, then what had to be given up. Figures are those of the findings."""
    line = F.concat("series_id", F.lit(": "), F.format_number("first", 2), F.lit(" -> "), F.format_number("last", 2), F.lit(" ("), F.format_number("pct", 1), F.lit("%)"))
    given_up = F.concat(F.when(F.col("narrowed"), "").otherwise("\nNo measure has the breakdown asked for; none was applied."), F.when(F.col("intent_satisfied"), "").otherwise("\nThe measure asked for isn't published; the nearest is shown."))
    x = found.groupBy("id", given_up.alias("tail")).agg(F.array_sort(F.collect_list(F.coalesce(line, F.concat("series_id", F.lit(": no change known"))))).alias("lines"))  # three series at most
    return x.select("id", F.concat(F.array_join("lines", "\n"), "tail").alias("text"))
