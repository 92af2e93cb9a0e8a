"""Gates: what must hold of the data, each over DataFrames that may break it. A gate that compared nothing fails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions import text as txt
from tidelake.functions.numeric import power10

PARTITION_SHARE, PARTITION_UNITS, UNITS_SHARE = 0.005, 2.0, 0.005
AGREE, STEADY = 0.02, 0.01
#: The share of a catalog's series whose two verdicts on accumulation are known to differ: 129 of 47,015.
DISAGREE_SHARE = 129 / 47015
#: The copies that a gate looks at.
STORED, PLANTED = "as stored", "planted breach"


def gate(name: str, checked: DataFrame, breach) -> DataFrame:
    """gate, checked, breaches, status."""
    out = checked.agg(F.count("*").alias("checked"), F.count_if(breach).alias("breaches"))
    return out.select(F.lit(name).alias("gate"), "checked", "breaches", F.when((F.col("checked") == 0) | (F.col("breaches") > 0), "fail").otherwise("pass").alias("status"))


def doubled(df: DataFrame, **planted: Column) -> DataFrame:
    """df twice in one pass, by column data: as stored, and with these columns as planted."""
    both = df.withColumn("data", F.explode(F.array(F.lit(STORED), F.lit(PLANTED))))
    return both.withColumns({c: F.when(F.col("data") == PLANTED, e).otherwise(F.col(c)) for c, e in planted.items()}) if planted else both


def suite(rows: DataFrame, names: list[str]) -> DataFrame:
    """gate, data, checked, breaches, status of rows (gate, data, breach): a line for each gate and copy, also where nothing was compared, which fails."""
    n = rows.where("breach IS NOT NULL").groupBy("gate", "data").agg(F.count("*").alias("checked"), F.count_if("breach").alias("breaches"))
    every = rows.sparkSession.createDataFrame([(g, d) for g in names for d in (STORED, PLANTED)], "gate string, data string")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = every.join(n, ["gate", "data"], "left").select("gate", "data", zero("checked").alias("checked"), zero("breaches").alias("breaches"))
    return out.withColumn("status", F.when((F.col("checked") == 0) | (F.col("breaches") > 0), "fail").otherwise("pass"))


def verdicts(name: str, rows: DataFrame) -> DataFrame:
    """The lines of one gate, from rows (data, breach)."""
    return suite(rows.select(F.lit(name).alias("gate"), "data", "breach"), [name])


def watched(obs: DataFrame) -> dict[str, Column]:
    """What is counted while observations are written: rows, and for each gate of single rows the breaches, as they are and as planted."""
    source, value, sid = F.col("source"), F.col("value"), F.col("series_id")
    odd = F.isnan("value") | (F.abs("value") == float("inf"))
    nameless = sid.isNull() | F.col("period").isNull()
    flipped = F.when(F.col("period") == F.lit("1996-01-01").cast("date"), -value).otherwise(value)
    return {
        "rows": F.count(F.lit(1)), "keys": F.count_if(nameless), "keys, planted": F.count_if(nameless | (sid == "index.price")), "signs": F.count_if((source == "count") & (value < 0)), "signs, planted": F.count_if((source == "count") & (flipped < 0)),
        "finite": F.count_if(odd), "finite, planted": F.count_if(odd | (source == "rate")),
    }


def observed(metrics: DataFrame) -> DataFrame:
    """gate, data, checked, breaches, status of the metrics (name, n) that were taken during a write."""
    rows = metrics.where("name = 'rows'").select(F.col("n").alias("checked"))
    of = metrics.where("name <> 'rows'").select(F.concat(F.lit("written: "), F.split_part("name", F.lit(","), F.lit(1))).alias("gate"), F.when(F.endswith("name", F.lit("planted")), PLANTED).otherwise(STORED).alias("data"), F.col("n").alias("breaches"))
    out = of.crossJoin(F.broadcast(rows))  # one row
    return out.select("gate", "data", "checked", "breaches", F.when((F.col("checked") == 0) | (F.col("breaches") > 0), "fail").otherwise("pass").alias("status"))


def reconcile(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, agrees, stable of two publishers' figures a and b: within AGREE of each other at the power of ten of their median ratio, or at a ratio that hardly moves."""
    x = pairs.withColumn("r", F.col("b") / F.col("a"))
    scale = x.where("r > 0").groupBy(*keys).agg(power10(F.median("r")).alias("scale"))
    q = x.join(scale, keys).withColumn("q", F.col("r") / F.col("scale"))
    return q.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(F.abs(F.col("q") - 1)) <= AGREE).alias("agrees"), F.coalesce(F.stddev_samp("q") <= STEADY, F.lit(False)).alias("stable"))


def whole_and_parts(whole: DataFrame, parts: DataFrame, expected: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """whole (period, whole), parts (period, part, v, and keys of copies) as period, keys, whole, parts: the sum, null unless every expected part (one row each) has a value in the period."""
    need = expected.agg(F.count("*").alias("need"))  # one row
    sums = parts.where("v IS NOT NULL").groupBy("period", *keys).agg(F.countDistinct("part").alias("have"), F.sum(F.col("v").cast("decimal(38,2)")).cast("double").alias("parts"))
    x = whole.join(sums, "period", "left").crossJoin(F.broadcast(need))
    return x.select("period", *keys, "whole", F.when(F.col("have") == F.col("need"), F.col("parts")).alias("parts"))


def partition_breach():
    """A gap is a breach if it is large in both ways."""
    gap = F.abs(F.col("whole") - F.col("parts"))
    return (gap > PARTITION_UNITS) & (gap > PARTITION_SHARE * F.abs("whole"))


def rebuilt_units(published: DataFrame) -> DataFrame:
    """published (k, branches, people_per_branch, money_per_head in thousands, money) with the total rebuilt from its three columns, which are rounded as they are published."""
    return published.withColumn("rebuilt", F.col("branches") * F.col("people_per_branch") * F.col("money_per_head") * 1000)


def units_breach():
    return F.abs(F.col("rebuilt") - F.col("money")) > UNITS_SHARE * F.abs("money")


def filled(output: DataFrame, source: DataFrame) -> DataFrame:
    """Cells (series_id, period) of a spine in which an operator's output holds a value though its source has none: checked, missing, filled."""
    have = source.where("value IS NOT NULL").select("series_id", "period", F.lit(True).alias("seen"))
    x = output.join(have, ["series_id", "period"], "left")
    return x.agg(F.count("*").alias("checked"), F.count_if(F.col("value").isNull()).alias("missing"), F.count_if(F.col("value").isNotNull() & F.col("seen").isNull()).alias("filled"))


def payloads(facts: DataFrame, known: Sequence[str] = ()) -> DataFrame:
    """(gate, data, breach) of the facts of raw files (data, period, table_no, part, stated, unit, labels): a caption that names another period than its place does; a table in more units than one; labels that came or went since the file's last period, but for the known; a label in several spellings; a part of a table that a period lacks."""
    before = F.lag("labels").over(Window.partitionBy("data", "table_no", "part").orderBy("period"))
    new = lambda a, b: F.exists(F.array_except(a, b), lambda x: ~x.isin(*known) if known else F.lit(True))
    row = lambda name, df, breach: df.select(F.lit(name).alias("gate"), "data", breach.alias("breach"))
    captions = row("caption", facts, F.when(F.col("stated").isNotNull(), F.col("stated") != F.date_format("period", "yyyy-MM")))
    units = row("unit", facts.groupBy("data", "table_no").agg(F.countDistinct("unit").alias("n")), F.col("n") > 1)
    drift = row("drift", facts.withColumn("before", before).where("before IS NOT NULL"), new("labels", "before") | new("before", "labels"))
    label = facts.select("data", "table_no", F.explode("labels").alias("label")).distinct()
    variants = row("spelling", label.groupBy("data", "table_no", txt.slugify(txt.normalise_label(F.col("label"))).alias("k")).agg(F.count("*").alias("n")), F.col("n") > 1)
    parts = facts.select("data", "table_no", "part").distinct().join(facts.select("data", "period").distinct(), "data")  # every period should have every part
    covered = parts.join(facts.select("data", "table_no", "part", "period", F.lit(True).alias("there")), ["data", "table_no", "part", "period"], "left")
    return captions.unionAll(units).unionAll(drift).unionAll(variants).unionAll(row("coverage", covered, F.col("there").isNull()))


def bronze(manifest: DataFrame, stored: DataFrame, expected: DataFrame) -> DataFrame:
    """manifest (path, digest), stored (path, now: the digest of what lies there, unit), expected (path): listed, absent (listed, not stored), altered, twice (listed again), unlisted (stored, not listed), uncovered (expected, not listed), units (more spellings of the unit than one)."""
    lines = manifest.groupBy("path").agg(F.count("*").alias("n"), F.first("digest").alias("digest"))
    x = lines.withColumn("listed", F.lit(True)).join(stored.select("path", "now"), "path", "full").join(expected.select("path", F.lit(True).alias("wanted")), "path", "full")
    zero = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    listed = F.coalesce("listed", F.lit(False))
    seen = x.agg(
        zero(F.col("n")).alias("listed"), zero(listed & F.col("now").isNull()).alias("absent"), zero(listed & (F.col("now") != F.col("digest"))).alias("altered"), zero(F.col("n") - 1).alias("twice"),
        zero(~listed & F.col("now").isNotNull()).alias("unlisted"), zero(F.coalesce("wanted", F.lit(False)) & ~listed).alias("uncovered"),
    )
    return seen.crossJoin(F.broadcast(stored.agg(F.countDistinct("unit").alias("units"))))  # one row each
