"""Raw bulletins as published, to series: monthly and quarterly JSON, weekly HTML, silver Parquet with its configuration, wide snapshots.

Each parser takes (path, content), so that files and tables are read alike. JSON is parsed with VARIANT cells: whether a cell is a number or text decides whether it is an observation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions import numeric as num
from tidelake.functions import text as txt
from tidelake.sources.documents import Table, _Page, bound_batches

# Bank groups by code, what a table reports, units that no caption states.
SCOPES = {
    10001: "Sektör", 10002: "Mevduat", 10003: "Katılım", 10004: "Kalkınma ve Yatırım", 10005: "Yerli Özel", 10006: "Kamu", 10007: "Yabancı",
    10008: "Mevduat-Yerli Özel", 10009: "Mevduat-Kamu", 10010: "Mevduat-Yabancı",
}
CURRENCIES = ("TP", "YP", "Toplam")
MONTHLY_STATEMENT = {2: "income_statement", 14: "off_balance_sheet", 15: "ratio", 16: "ratio", 17: "ratio"} | dict.fromkeys([1, *range(3, 14)], "balance_sheet")
QUARTERLY_STATEMENT = {5: "ratio", 6: "ratio"} | dict.fromkeys([1, 2, 3, 4, 7], "balance_sheet")
WEEKLY_OFF_BALANCE = 294
MONTHLY_UNIT = {16: "Adet", 17: "%"}
QUARTERLY_UNIT = {5: "%", 6: ""} | dict.fromkeys([1, 2, 3, 4, 7], "Bin TL")
ROW_UNIT = {(11, "Likidite Yeterlilik Oranı"): ("%", "ratio")}
COLUMN_UNIT = {
    "Yurtiçi Şube Sayısı": ("Adet", "count"), "Şubeye Düşen Nüfus": ("Kişi", "ratio"), "Kişi Başı Nakdi Kredi": ("TL", "ratio"),
    "Kişi Başı Takipteki Alacak": ("TL", "ratio"), "Kişi Başı Tasarruf Mevduatı": ("TL", "ratio"), "Kişi Başı Toplam Mevduat": ("TL", "ratio"),
}
COUNT_UNITS = ("adet",)
PRECISION_IDS = ("TabloExcel2", "TabloExcel", "Tablo")
FREQUENCIES = ("D", "W", "M", "Q")

LABEL, FIRST_VALUE, QUARTERLY_FIRST = 2, 4, 5
PAYLOAD = "Json struct<caption: string, colNames: array<string>, data: struct<rows: array<struct<cell: array<variant>>>>>"
NUMBERS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*|BOOLEAN)$"


def choose(key: Column, table: dict) -> Column:
    """What a small fixed table says for a key, else null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def is_number(cell: Column) -> Column:
    return F.coalesce(F.schema_of_variant(cell).rlike(NUMBERS), F.lit(False))


def as_number(cell: Column) -> Column:
    return F.coalesce(F.try_variant_get(cell, "$", "double"), F.try_variant_get(cell, "$", "boolean").cast("double"))


def as_text(cell: Column) -> Column:
    return F.try_variant_get(cell, "$", "string")


def scope_of(code: Column) -> Column:
    return F.coalesce(choose(code, SCOPES), code.cast("string"))


def scope_matches(code: Column, stated: Column) -> Column:
    """Whether a payload may count for the group that was asked for: it names that group, none, or the code isn't known."""
    want = choose(code, SCOPES)
    return want.isNull() | (F.coalesce(F.btrim(stated), F.lit("")) == "") | (F.btrim(stated) == want)


def canonical(raw: Column, known: tuple[str, ...]) -> Column:
    """One spelling for a scope or a currency; what isn't known passes unchanged."""
    key = txt.casefold(F.btrim(raw))
    out = F.lit(None).cast("string")
    for name in known:
        out = F.when(key == txt.casefold(F.lit(name)), name).otherwise(out)
    return F.coalesce(out, F.btrim(raw))


def trailing_unit(label: Column) -> Column:
    """What a label's last parenthesis says, if it is a unit that is known; else ''."""
    found = F.btrim(F.regexp_extract(label, r"\(([^()]*)\)\s*$", 1))
    return F.when(txt.casefold(found).isin(*num.UNITS), found).otherwise("")


def unit_of(table_no: Column, label: Column, caption: Column) -> Column:
    """The row's own exception, else its label's, else the caption's, else the table's."""
    row = F.lit(None).cast("string")
    for (no, name), (unit, _) in ROW_UNIT.items():
        row = F.when((table_no == no) & (label == name), unit).otherwise(row)
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(row, some(trailing_unit(label)), some(F.btrim(txt.caption_unit(caption))), choose(table_no, MONTHLY_UNIT), F.lit(""))


def measure_of(statement: Column, unit: Column) -> Column:
    symbol = num.normalise_unit(unit)[0]
    return (
        F.when(txt.casefold(F.btrim(unit)).isin(*COUNT_UNITS), "count").when(statement == "ratio", "ratio").when(symbol == "%", "rate")
        .when(statement == "income_statement", "flow").when(statement.isin("balance_sheet", "off_balance_sheet"), "stock").otherwise("unknown")
    )


def measure_by_name(name: Column, unit: Column) -> Column:
    """What a central-bank series measures: by its unit, then by whole words of its name."""
    key, symbol, low = txt.casefold(F.btrim(unit)), num.normalise_unit(unit)[0], txt.casefold(name)
    word = lambda w: low.rlike(rf"(?U)\b{w}\b")
    return (
        F.when(key.isin(*COUNT_UNITS), "count").when(symbol == "endeks", "index").when(key == "ağırlıklı ortalama", "rate")
        .when(symbol == "%", F.when(F.contains(low, F.lit("faiz")), "rate").otherwise("ratio"))
        .when(F.contains(low, F.lit("endeks")), "index")
        .when(key != "", F.when(word("akım") & ~word("stok"), "flow").otherwise("stock")).otherwise("unknown")
    )


def default_rule(measure: Column) -> Column:
    return F.when(measure == "flow", "sum").when(measure == "rate", "mean").otherwise("last")


def verifier(pattern: Column, resolved: Column) -> Column:
    return F.when(resolved == "ambiguous", "").when(pattern != "ambiguous", "pattern").otherwise("statement")


def _payloads(files: DataFrame) -> DataFrame:
    return files.withColumn("j", F.from_json("content", PAYLOAD)["Json"])


def _newest(rows: DataFrame, keys: list[str], bits: Column) -> DataFrame:
    """keys, period, value, and first: of a period the last figure counts, of a series the first row's description. Both are plain aggregates."""
    order = F.struct("period", "path", "pos")
    return rows.groupBy(*keys, "period").agg(F.max_by("value", F.struct("path", "pos")).alias("value"), F.min(F.struct(order.alias("at"), bits.alias("bits"))).alias("first"))


def _described(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.min("first")["bits"].alias("bits"), F.min("period").alias("coverage_start"), F.max("period").alias("coverage_end"), F.count("value").alias("observations"), F.count_if(F.col("value") != 0).alias("nonzero")
    )


def monthly_points(files: DataFrame) -> DataFrame:
    """table_no, scope_code, label, period, value, first. Paths end in YYYY-MM/tNN_tarafNNNNN.json. A file whose payload names another group counts for nothing;
    rows of under five cells or without a number don't count; the last number of a row is its figure."""
    part = lambda k: F.regexp_extract("path", r"(\d{4})-(\d{1,2})/t(\d\d)[^/]*_taraf(\d+)\.json$", k).try_cast("int")
    x = _payloads(files).select(
        "path", F.make_date(part(1), part(2), F.lit(1)).alias("period"), part(3).alias("table_no"), part(4).alias("scope_code"), F.col("j.caption").alias("caption"), F.col("j.data.rows").alias("rows"), as_text(F.get(F.get("j.data.rows", F.lit(0))["cell"], F.lit(0))).alias("stated")
    )
    x = x.where(F.col("period").isNotNull() & scope_matches(F.col("scope_code"), F.col("stated")))
    x = x.select("path", "period", "table_no", "scope_code", "caption", F.posexplode("rows").alias("pos", "row")).withColumn("cell", F.col("row.cell")).where(F.size("cell") > FIRST_VALUE)
    last = F.try_element_at(F.filter(F.slice("cell", F.lit(FIRST_VALUE + 1), F.size("cell")), is_number), F.lit(-1))
    raw = F.btrim(as_text(F.get("cell", F.lit(LABEL))))
    x = x.withColumn("value", as_number(last)).where("value IS NOT NULL").withColumn("raw_label", raw)
    x = x.withColumn("label", txt.normalise_label(F.col("raw_label"))).withColumn("unit", unit_of(F.col("table_no"), F.col("raw_label"), F.col("caption")))
    return _newest(x, ["table_no", "scope_code", "label"], F.struct("raw_label", "unit", as_text(F.get("cell", F.lit(1))).alias("row_index")))


def monthly_catalog(points: DataFrame) -> DataFrame:
    """One row for each (table_no, scope_code, label) with what it measures."""
    no, unit = F.col("table_no"), F.col("bits.unit")
    override = F.lit(None).cast("string")
    for (k, name), (_, kind) in ROW_UNIT.items():
        override = F.when((no == k) & (F.col("bits.raw_label") == name), kind).otherwise(override)
    x = _described(points, ["table_no", "scope_code", "label"]).withColumn("statement_kind", choose(no, MONTHLY_STATEMENT))
    symbol, scale = num.normalise_unit(unit)
    x = x.withColumn("measure_type", F.coalesce(override, measure_of(F.col("statement_kind"), unit)))
    name = F.concat(F.format_string("monthly.t%02d.taraf%d.", "table_no", "scope_code"), txt.slugify(txt.normalise_label(F.col("bits.raw_label"))))
    return x.select(
        name.alias("series_id"), "table_no", "scope_code", "label", F.col("bits.raw_label").alias("raw_label"), F.col("bits.row_index").alias("row_index"), "statement_kind", scope_of(F.col("scope_code")).alias("sector_scope"), unit.alias("unit_raw"), symbol.alias("unit"),
        scale.alias("scale_factor"), "measure_type", default_rule(F.col("measure_type")).alias("aggregation_rule"), F.lit("M").alias("native_freq"), "coverage_start", "coverage_end", "observations", "nonzero",
    )


def payload_facts(files: DataFrame) -> DataFrame:
    """period, table_no, part, stated (the period that the caption names, as YYYY-MM, null where none), unit (of the caption), labels (of the rows, sorted, each once) of the files of a monthly tree."""
    x = _payloads(files).select("period", "table_no", "part", F.col("j.caption").alias("caption"), F.filter("j.data.rows", lambda r: F.size(r["cell"]) > LABEL).alias("rows"))
    named = lambda k: F.regexp_extract("caption", r"(\d{4})\s*/\s*(\d{1,2})", k)
    labels = F.array_sort(F.array_distinct(F.transform("rows", lambda r: F.btrim(as_text(F.get(r["cell"], F.lit(LABEL)))))))
    return x.select("period", "table_no", "part", F.when(named(1) != "", F.concat(named(1), F.lit("-"), F.lpad(named(2), 2, "0"))).alias("stated"), F.btrim(txt.caption_unit(F.col("caption"))).alias("unit"), labels.alias("labels"))


def quarterly_points(files: DataFrame) -> DataFrame:
    """table_no, column, province, grp, period, value, first. Paths end in YYYY-Q/tabloN.json, where the second number is the month that the quarter is named by.
    Every numeric cell from the sixth on is an observation; a column without a name is colN."""
    part = lambda k: F.regexp_extract("path", r"(\d{4})-(\d{1,2})/tablo(\d+)\.json$", k).try_cast("int")
    x = _payloads(files).select("path", F.make_date(part(1), part(2), F.lit(1)).alias("period"), part(3).alias("table_no"), F.col("j.colNames").alias("names"), F.posexplode("j.data.rows").alias("row_no", "row"))
    x = x.where("period IS NOT NULL AND size(row.cell) >= 6").withColumn("cell", F.col("row.cell"))
    x = x.select("path", "period", "table_no", "row_no", "names", as_text(F.get("cell", F.lit(3))).alias("province"), as_text(F.get("cell", F.lit(4))).alias("grp"), F.posexplode("cell").alias("ci", "v"))
    x = x.where((F.col("ci") >= QUARTERLY_FIRST) & is_number(F.col("v"))).withColumn("column", F.coalesce(F.get("names", "ci"), F.concat(F.lit("col"), "ci")))
    x = x.withColumn("value", as_number(F.col("v"))).withColumn("pos", F.struct("row_no", "ci"))
    unit = F.coalesce(choose(F.col("column"), {k: u for k, (u, _) in COLUMN_UNIT.items()}), choose(F.col("table_no"), QUARTERLY_UNIT), F.lit(""))
    return _newest(x, ["table_no", "column", "province", "grp"], F.struct(unit.alias("unit")))


def quarterly_catalog(points: DataFrame) -> DataFrame:
    x = _described(points, ["table_no", "column", "province", "grp"]).withColumn("statement_kind", F.coalesce(choose(F.col("table_no"), QUARTERLY_STATEMENT), F.lit("balance_sheet")))
    by_table = F.coalesce(choose(F.col("table_no"), QUARTERLY_UNIT), F.lit(""))
    measure = F.coalesce(choose(F.col("column"), {k: m for k, (_, m) in COLUMN_UNIT.items()}), measure_of(F.col("statement_kind"), by_table))
    symbol, scale = num.normalise_unit(F.col("bits.unit"))
    slug = txt.slugify(txt.normalise_label(F.concat_ws(" ", "column", "province", "grp")))
    return x.select(
        F.substring(F.concat(F.format_string("quarterly.t%02d.", "table_no"), slug), 1, 200).alias("series_id"), "table_no", "column", F.when(txt.casefold(F.col("province")) != "hepsi", F.col("province")).alias("province"), canonical(F.col("grp"), tuple(SCOPES.values())).alias("sector_scope"),
        "statement_kind", F.col("bits.unit").alias("unit_raw"), symbol.alias("unit"), scale.alias("scale_factor"), measure.alias("measure_type"), default_rule(measure).alias("aggregation_rule"), F.lit("Q").alias("native_freq"), "coverage_start", "coverage_end", "observations", "nonzero",
    )


class _Weekly(_Page):
    """Keeps, of the tables with a known id, the rows of cells."""

    def __init__(self):
        super().__init__("")
        self.kept: dict[str, Table] = {}

    def handle_starttag(self, tag, attrs):
        before = len(self.tables)
        super().handle_starttag(tag, attrs)
        if len(self.tables) > before:
            self.kept.setdefault(dict(attrs).get("id") or "", self.tables[-1])


_HEAD_UNIT = re.compile(r"\(([^()]*(?:TL|%)[^()]*)\)\s*$")
_HEAD_DATE = re.compile(r"(\d{1,2})\s+([^\W\d_]+)\s+(\d{4})")
_DECIMALS = re.compile(r",(\d+)\)?$")


def weekly_header(text: str) -> tuple[str, str, int, int, int]:
    """Name, unit, year, month and day (0 where none) of 'Group / Name ( 8 Ocak 2021 Cuma ) (Milyon TL)'."""
    flat, unit, when = " ".join(text.split()), "", (0, 0, 0)
    if found := _HEAD_UNIT.search(flat):
        unit, flat = found[1].strip(), flat[: found.start()].strip()
    if found := _HEAD_DATE.search(flat):
        fold = str.maketrans("çğıöşü", "cgiosu")
        months = [m.translate(fold) for m in num.MONTHS]
        name = found[2].replace("I", "ı").replace("İ", "i").lower().translate(fold)
        if name in months:
            when = (int(found[3]), months.index(name) + 1, int(found[1]))
        flat = flat[: found.start()].rstrip(" (")
    return flat.split("/")[-1].strip(" ()"), unit, *when


def _weekly_rows(html: str | None) -> list[tuple]:
    page = _Weekly()
    try:
        page.feed(html or "")
        page.close()
    except (ValueError, AssertionError):  # broken markup: what was read so far counts
        pass
    tables = [t for i in PRECISION_IDS if i in page.kept and len(t := page.kept[i].cells()) >= 2]
    if not tables:
        return []
    detail = [sum(len(m[1]) for c in t[1] if (m := _DECIMALS.search(c.strip()))) for t in tables]
    head, *body = tables[detail.index(max(detail))]
    name, unit, *when = weekly_header(head[1] if len(head) > 1 else "")
    columns = [h for h in head[2:] if h]
    return [(name, unit, *when, i, " ".join(r[1].split()), column, cell) for i, r in enumerate(body) if len(r) >= 3 and r[1].strip() for column, cell in zip(columns, r[2:], strict=False)]


def weekly_points(files: DataFrame) -> DataFrame:
    """currency, table_id, label, column, period, value, first. Paths end in CURRENCY/PERIOD/tabloN.html; the page's own period counts, pages that state none don't.
    The variant of the table with most decimals in its first row is read. Only the markup is parsed in Python; numbers are parsed as expressions."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = "path table_name unit y m d row_no raw_label column cell".split()
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                if found := _weekly_rows(content):
                    yield pd.DataFrame([(path, *r) for r in found], columns=names)

    bound_batches(files.sparkSession)
    x = files.select("path", "content").mapInPandas(run, "path string, table_name string, unit string, y int, m int, d int, row_no int, raw_label string, column string, cell string")
    part = lambda k: F.regexp_extract("path", r"([^/]+)/[^/]+/tablo(\d+)\.html$", k)
    x = x.select("*", F.when(F.col("y") > 0, F.try_to_date(F.format_string("%04d-%02d-%02d", "y", "m", "d"))).alias("period"), part(1).alias("currency"), part(2).try_cast("int").alias("table_id"), num.parse_tr(F.col("cell")).cast("double").alias("value"))
    x = x.where("period IS NOT NULL AND value IS NOT NULL").withColumn("label", txt.normalise_label(F.col("raw_label"))).withColumn("pos", F.col("row_no"))
    return _newest(x, ["currency", "table_id", "label", "column"], F.struct("raw_label", "unit", "table_name"))


def weekly_catalog(points: DataFrame) -> DataFrame:
    x = _described(points, ["currency", "table_id", "label", "column"])
    statement = F.when(F.col("table_id") == WEEKLY_OFF_BALANCE, "off_balance_sheet").otherwise("balance_sheet")
    measure, (symbol, scale) = measure_of(statement, F.col("bits.unit")), num.normalise_unit(F.col("bits.unit"))
    slug = txt.slugify(txt.normalise_label(F.concat_ws(" ", "label", "column")))
    return x.select(
        F.substring(F.concat_ws(".", F.lit("weekly"), "currency", F.concat(F.lit("t"), "table_id"), slug), 1, 200).alias("series_id"), F.concat_ws(" - ", F.col("bits.table_name"), "label").alias("name"), "table_id", canonical(F.col("column"), CURRENCIES).alias("currency_basis"), statement.alias("statement_kind"),
        F.col("bits.unit").alias("unit_raw"), symbol.alias("unit"), scale.alias("scale_factor"), measure.alias("measure_type"), default_rule(measure).alias("aggregation_rule"), F.lit("W").alias("native_freq"), "coverage_start", "coverage_end", "observations", "nonzero",
    )


class BadConfig(ValueError):
    """A configuration of series that can't be used; args[0] says why."""


def check_config(config: DataFrame) -> DataFrame:
    """The configuration (code, name, unit, frequency, gaps) itself, or BadConfig: codes must be unique, frequencies known, gaps stated. One aggregate decides."""
    code = config.groupBy("code").agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("frequency").isin(*FREQUENCIES), F.lit(False))).alias("odd"), F.count_if(F.col("gaps").isNull()).alias("open"))
    seen = code.agg(F.count_if(F.col("n") > 1).alias("twice"), F.coalesce(F.sum("odd"), F.lit(0)).alias("odd"), F.coalesce(F.sum("open"), F.lit(0)).alias("open"), F.count_if(F.col("code").isNull()).alias("nameless")).first()
    for count, why in ((seen.twice, "codes that occur twice"), (seen.odd, "unknown frequencies"), (seen.open, "entries that state no gaps"), (seen.nameless, "entries without a code")):
        if count:
            raise BadConfig(f"{count} {why}")
    return config


#: A configuration of series: one JSON document.
CONFIG = "start_date date, end_date date, complete boolean, scope_note string, known_gaps array<string>, series array<struct<code: string, name: string, frequency: string, unit: string>>"
CODE = r"[A-Za-z][A-Za-z0-9_.\\-]*"


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """code, name, unit, frequency, gaps of the configuration at path, or BadConfig: a document that isn't of its schema, dates in the wrong order, no scope, a part of a catalog that states no gaps, no series, or entries that can't be used."""
    doc = spark.read.schema(CONFIG).option("multiLine", True).option("mode", "FAILFAST").option("dateFormat", "yyyy-MM-dd").json(path)
    blank = lambda c: F.coalesce(F.btrim(c), F.lit("")) == ""
    gaps = F.filter(F.coalesce("known_gaps", F.array().cast("array<string>")), lambda g: F.coalesce(F.btrim(g), F.lit("")) != "")
    head = doc.select("start_date", "end_date", blank("scope_note").alias("vague"), (~F.coalesce("complete", F.lit(False)) & (F.size(gaps) == 0)).alias("open"), F.coalesce(F.size("series"), F.lit(0)).alias("n"))
    try:
        found = head.take(2)
    except Exception as e:
        if "MALFORMED_RECORD" in str(e):
            raise BadConfig("not a configuration of series") from e
        raise
    if len(found) != 1:
        raise BadConfig("a configuration is one document")
    (h,) = found
    for wrong, why in ((h.start_date is None or h.end_date is None, "no start or end"), (h.start_date and h.end_date and h.end_date < h.start_date, "it ends before it starts"), (h.vague, "no scope is stated"), (h.open, "a part of a catalog must state its gaps"), (h.n <= 0, "no series")):
        if wrong:
            raise BadConfig(why)
    x = doc.select(F.array_join(gaps, "; ").alias("gaps"), F.explode("series").alias("s"))
    clean = lambda c: F.btrim(F.col(f"s.{c}"))
    entries = x.select(clean("code").alias("code"), clean("name").alias("name"), F.coalesce(clean("unit"), F.lit("")).alias("unit"), F.upper(clean("frequency")).alias("frequency"), "gaps")
    odd = entries.agg(F.count_if(~F.coalesce(F.col("code").rlike(f"^{CODE}$"), F.lit(False))).alias("code"), F.count_if(blank("name")).alias("name")).first()
    if odd.code or odd.name:
        raise BadConfig(f"{odd.code} codes and {odd.name} names that can't be used")
    return check_config(entries)


def manifest(spark: SparkSession, path: str, *also: str) -> DataFrame:
    """also (columns of the folders' names), path, sha256, fetched_at, broken: the lines of a manifest of fetched files, JSON lines in a file or folder. A line that isn't JSON has nothing but its text, in broken; a time that can't be read is null."""
    names = "".join(f"{c} int, " for c in also)
    lines = spark.read.schema(names + "path string, sha256 string, fetched_at string, broken string").option("columnNameOfCorruptRecord", "broken").json(path)
    sha = F.nullif(F.btrim("sha256"), F.lit(""))
    return lines.select("*", F.expr("try_to_timestamp(fetched_at)").alias("at")).select(*also, "path", sha.alias("sha256"), F.col("at").alias("fetched_at"), "broken")


def provenance(lines: DataFrame) -> DataFrame:
    """source, digest, newest, files (those with a digest), malformed. Lines (source and those of a manifest) may come in any order: the digest is that of the digests of 256 parts of the sorted digests, so that no task holds all of a large source; it is null where there are none."""
    part = lines.groupBy("source", F.substring("sha256", 1, 2).alias("k")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256).alias("d"), F.count("sha256").alias("n"), F.max("fetched_at").alias("newest"), F.count_if(F.col("broken").isNotNull()).alias("broken")
    )
    parts = F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "d"))))  # 256 at most
    digest = F.when(F.sum("n") > 0, F.sha2(F.array_join(F.transform(parts, lambda x: x["d"]), ""), 256))
    return part.groupBy("source").agg(digest.alias("digest"), F.max("newest").alias("newest"), F.sum("n").alias("files"), F.sum("broken").alias("malformed"))


def silver(raw: DataFrame, config: DataFrame) -> DataFrame:
    """series_code, period, value, with name, unit and frequency of its configuration (null where it has none). Text that isn't a number is no observation."""
    x = raw.select("series_code", "period", F.col("value").try_cast("double").alias("value")).where("value IS NOT NULL AND NOT isnan(value)")
    return x.join(config.select(F.col("code").alias("series_code"), "name", "unit", "frequency"), "series_code", "left")


def snapshot(wide: DataFrame) -> DataFrame:
    """Long observations of a wide table (period, one column for each series)."""
    return wide.unpivot(["period"], [c for c in wide.columns if c != "period"], "series_id", "value")


def fingerprint(catalog: DataFrame) -> DataFrame:
    """One digest of (series_id, observations, nonzero) in order of ids: digests of buckets of ids are combined, so no task holds the whole catalog."""
    line = F.concat_ws("|", "series_id", "observations", "nonzero")
    part = catalog.select(F.substring(F.sha2("series_id", 256), 1, 3).alias("bucket"), F.struct("series_id", line.alias("line")).alias("x"))
    part = part.groupBy("bucket").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda v: v["line"]), "\n"), 256).alias("h"), F.count("*").alias("n"))
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda v: v["h"]), ""), 256).alias("digest"), F.sum("n").alias("n"))


def resumed(wanted: DataFrame, tries: DataFrame, most: int, longest: int = 60) -> DataFrame:
    """wanted (page_id, url) that no try (page_id, t, status) has fetched and that have been tried less than most times: url, page_id, tried, wait (seconds), last (status)."""
    seen = tries.groupBy("page_id").agg(F.count("*").alias("tried"), F.bool_or(F.col("status") == 200).alias("done"), F.max_by("status", "t").alias("last"))
    x = wanted.join(seen, "page_id", "left").withColumn("tried", F.coalesce("tried", F.lit(0)))
    x = x.where(~F.coalesce("done", F.lit(False)) & (F.col("tried") < most))
    return x.select("url", "page_id", "tried", F.least(F.lit(longest), F.pow(F.lit(2.0), "tried")).cast("int").alias("wait"), "last")
