"""Scalar number and date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Cells that say "no value"; units and their scale; months.
NULL_TOKENS = ["", "-", "--", "—", "–", "n/a", "na", ".", "..", "...", "*"]
UNITS = {
    "bin tl": ("TRY", 1e3), "milyon tl": ("TRY", 1e6), "milyar tl": ("TRY", 1e9), "tl": ("TRY", 1.0), "%": ("%", 1.0), "adet": ("adet", 1.0),
    "kişi": ("kişi", 1.0), "gün": ("gün", 1.0), "yüzde": ("%", 1.0), "ağırlıklı ortalama": ("%", 1.0), "türk lirası": ("TRY", 1.0), "abd doları": ("USD", 1.0),
    "bin abd doları": ("USD", 1e3), "milyon abd doları": ("USD", 1e6), "milyar abd doları": ("USD", 1e9), "bin kişi": ("kişi", 1e3), "endeks": ("endeks", 1.0),
    "2003=100": ("endeks", 1.0), "2010=100": ("endeks", 1.0), "2020=100": ("endeks", 1.0), "2021=100": ("endeks", 1.0),
}
MONTHS = "ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık".split()
#: Fixed value, a format: a figure as it is published has a sign or none, digits in groups of three parted by dots or in one group, and decimals after a comma or none.
NUMBER = r"^[-+]?(?:[0-9]{1,3}(?:\.[0-9]{3})*|[0-9]+)(?:,[0-9]+)?$"


def _bare(text: Column) -> Column:
    return F.lower(F.btrim(F.translate(text, " ", " ")))


def _signed(text: Column) -> Column:
    """(x) is -x."""
    bare = _bare(text)
    return F.when(bare.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.btrim(F.substring(bare, F.lit(2), F.length(bare) - 2)))).otherwise(bare)


def looks_numeric(text: Column) -> Column:
    return F.coalesce(_signed(text).rlike(NUMBER), F.lit(False))


def parse_tr(text: Column, strict: bool = False) -> Column:
    """A number in Turkish spelling as DECIMAL(38, 10). Cells without a value are null, never 0; other text is null or, if strict, an error."""
    bad = F.raise_error(F.concat(F.lit("not a Turkish-formatted number: "), text)).cast("decimal(38,10)") if strict else F.lit(None).cast("decimal(38,10)")
    value = F.translate(F.translate(F.regexp_replace(_signed(text), r"^\+", ""), ".", ""), ",", ".").try_cast("decimal(38,10)")
    return F.when(text.isNull() | _bare(text).isin(NULL_TOKENS), F.lit(None).cast("decimal(38,10)")).when(looks_numeric(text), value).otherwise(bad)


def precision_of(text: Column) -> Column:
    return F.length(F.regexp_extract(_signed(text), r",([0-9]+)$", 1))


def normalise_unit(unit: Column) -> tuple[Column, Column]:
    """Symbol and scale of a unit; one that isn't known has neither ('' and 1)."""
    from tidelake.functions.text import casefold

    key = casefold(F.btrim(unit))
    symbols = F.create_map(*(F.lit(x) for k, (s, _) in UNITS.items() for x in (k, s)))
    scales = F.create_map(*(F.lit(x) for k, (_, v) in UNITS.items() for x in (k, v)))
    return F.coalesce(F.try_element_at(symbols, key), F.lit("")), F.coalesce(F.try_element_at(scales, key), F.lit(1.0))


def pct_change(first: Column, last: Column) -> Column:
    return F.try_divide((last - first) * 100, F.abs(first))


def format_tr(value: Column, most: int = 4) -> Column:
    """Grouped by dots, up to four decimals after a comma, no trailing zeros."""
    spelt = F.translate(F.format_number(value, most), ",.", ".,")
    return F.regexp_replace(F.regexp_replace(spelt, r"(,[0-9]*?)0+$", "$1"), ",$", "")


def power10(ratio: Column) -> Column:
    return F.pow(F.lit(10.0), F.round(F.log10(ratio)))


def holm(p: Column, partition: str) -> Column:
    """Holm's step-down adjustment of p-values within a partition."""
    by = Window.partitionBy(partition).orderBy(p)
    rank, n = F.row_number().over(by), F.count("*").over(Window.partitionBy(partition))
    return F.least(F.lit(1.0), F.max((n - rank + 1) * p).over(by.rowsBetween(Window.unboundedPreceding, 0)))


def month_of(name: Column) -> Column:
    from tidelake.functions.text import fold_ascii

    fold = str.maketrans("çğıöşü", "cgiosu")
    months = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m.translate(fold), i)))
    return F.try_element_at(months, fold_ascii(F.btrim(name)))


def label_to_date(label: Column, year: Column) -> Column:
    """'Eylül/05' and a year as a date; null if there is no such day."""
    parts = F.split(label, "/")
    return F.try_to_date(F.concat(year.cast("string"), F.lit("-"), month_of(F.get(parts, 0)).cast("string"), F.lit("-"), F.get(parts, 1).try_cast("int").cast("string")), "yyyy-M-d")


def parse_period(text: Column, unixtime: Column) -> Column:
    """dd-MM-yyyy, yyyy-MM, else epoch seconds as a day in Istanbul."""
    return F.coalesce(F.try_to_date(text, "dd-MM-yyyy"), F.try_to_date(text, "yyyy-MM"), F.to_date(F.from_utc_timestamp(F.timestamp_seconds(unixtime), "Europe/Istanbul")))
