"""What a question asks for: its tool, and the facets it names. Expressions over a column of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions import text as txt

#: Phrases that name a tool; the first tool with one of its phrases in the question is taken.
TOOL_CUES = {
    "lakehouse": ("göster", "getir", "listele", "sorgula", "grafik", "tabloya", "hangi seri"),
    "anomaly": ("anomali", "aykırı", "olağandışı", "olağan dışı", "sapma", "uç değer", "sıra dışı", "outlier"),
    "change_detection": ("kırılma", "kırılım", "rejim", "değişim noktası", "trend değiş", "seviye değiş", "yapısal değişim", "break"),
    "causality": ("nedensellik", "neden oldu", "yol açtı", "etkiliyor mu", "etkiledi mi", "sebep oldu", "granger", "neden sonuç", "neden-sonuç"),
    "web_search": ("internette ara", "internetten bul", "web'de ara", "webde ara", "güncel haber"),
}
#: Words that name a bank group, and a currency. The first that a question has counts; mevduat stands last because it is a part of the names of other groups.
SCOPE_CUES = {
    "sektör": "Sektör", "katılım": "Katılım", "kalkınma": "Kalkınma ve Yatırım", "yatırım": "Kalkınma ve Yatırım",
    "kamu": "Kamu", "yabancı": "Yabancı", "özel": "Yerli Özel", "yerli": "Yerli Özel", "mevduat": "Mevduat",
}
CURRENCY_CUES = {"tp": "TP", "yp": "YP", "türk": "TP", "döviz": "YP", "yabancı para": "YP"}
DEFAULT_SCOPE, DEFAULT_CURRENCY = "Sektör", "Toplam"


def tool(question: Column) -> Column:
    """An address settles it; else the first tool with a phrase in the question; null if none has."""
    lower = F.lower(question)
    out = F.when(lower.rlike(r"https?://\S"), "url_agent")
    for name, cues in TOOL_CUES.items():
        out = out.when(F.greatest(*(F.contains(lower, F.lit(c)) for c in cues)), name)
    return out


def subset(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def _facet(question: Column, cues: dict[str, str], default: str) -> Column:
    words, out = txt.tokenize(question), None
    for cue, value in cues.items():
        here = subset(F.array(*map(F.lit, cue.split())), words)
        out = F.when(here, value) if out is None else out.when(here, value)
    return F.struct(F.coalesce(out, F.lit(default)).alias("value"), out.isNotNull().alias("stated"))


def scope(question: Column) -> Column:
    """(value, stated): the bank group that is named, or the default."""
    return _facet(question, SCOPE_CUES, DEFAULT_SCOPE)


def currency(question: Column) -> Column:
    return _facet(question, CURRENCY_CUES, DEFAULT_CURRENCY)


def provinces(questions: DataFrame, known: DataFrame) -> DataFrame:
    """questions (id, s) with the province each names, the least of several, or null. A province's words are looked up by its first, so that no pairs are made but those that share it."""
    words = questions.select("id", txt.tokenize(F.col("s")).alias("words"))
    named = known.select("province", txt.tokenize(F.col("province")).alias("parts")).where(F.size("parts") > 0)
    hits = words.select("id", "words", F.explode(F.array_distinct("words")).alias("w")).join(named, F.col("w") == F.get("parts", 0))
    found = hits.where(subset(F.col("parts"), F.col("words"))).groupBy("id").agg(F.min("province").alias("province"))
    return questions.join(found, "id", "left")


def embedding_text(name: Column, measure: Column, unit: Column, scope: Column, province: Column, frequency: Column, notes: Column) -> Column:
    """The semantics of a series beside its name; empty parts are left out."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(
        " | ", filled(name), F.concat(F.lit("ölçüm: "), F.coalesce(measure, F.lit(""))), F.concat(F.lit("birim: "), F.coalesce(unit, F.lit(""))), F.concat(F.lit("kapsam: "), filled(scope)),
        F.coalesce(F.concat(F.lit("il: "), filled(province)), F.lit("Türkiye geneli")), F.concat(F.lit("frekans: "), F.coalesce(frequency, F.lit(""))), filled(notes),
    )


def follow(start: DataFrame, links: DataFrame, hops: int = 2) -> DataFrame:
    """(start, page, hop): from each start the best unseen link of each page on, for at most so many hops. Links are (page, target, score, position); the first of equals wins.

    The best that is unseen is among the best few: a walk of so many hops has seen at most hops + 1 pages, so only that many links of a page are kept."""
    ranked = links.where("score > 0").groupBy("page", "target").agg(F.min(F.struct((-F.col("score")).alias("s"), "position")).alias("key"))
    few = ranked.withColumn("k", F.row_number().over(Window.partitionBy("page").orderBy("key", "target"))).where(F.col("k") <= hops + 2)
    best = few.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("k", "target"))).alias("best"))
    here = start.select(F.col("page").alias("start"), "page", F.array("page").alias("seen"))
    out = here.select("start", "page", F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        step = here.join(best, "page").withColumn("next", F.get(F.filter("best", lambda b: ~F.array_contains("seen", b["target"])), 0)["target"]).where("next IS NOT NULL")
        here = step.select("start", F.col("next").alias("page"), F.concat("seen", F.array("next")).alias("seen"))
        out = out.union(here.select("start", "page", F.lit(hop).alias("hop")))
    return out


_LATIN = bytes(range(128, 256)).decode("latin-1")
_TURKISH = bytes(range(128, 256)).decode("cp1254", "replace")


def decode(content: Column) -> Column:
    """UTF-8, or the Turkish code page where it isn't."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.translate(F.decode(content, "ISO-8859-1"), _LATIN, _TURKISH))
