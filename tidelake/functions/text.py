"""Scalar text functions as column expressions. Turkish case rules hold throughout: dotted and dotless i are two letters."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no subject matter, slices that are restrictive, and what a cue says about the measure.
STOPWORDS = (
    "ve ile için göre olan de da bir bu en net toplam nasıl ne nedir kaç hangi kadar mı mi mu mü son yıl yılda yılın yıllarda arası arasında "
    "değişti değişim oldu göster durumu seyri nedeni"
).split()
RESTRICTIVE = "takipteki tasfiye endeksli arşiv reeskont dışı".split()
CUES = {
    "faiz": "rate", "getiri": "rate", "endeks": "index", "oran": "ratio rate", "rasyo": "ratio rate", "pay": "ratio", "sayı": "count", "adet": "count",
    "bakiye": "stock", "stok": "stock", "tutar": "stock flow", "akım": "flow", "kullandırım": "flow", "kullandırılan": "flow",
}
MIN_STEM = 4
PENALTY = 0.65
FOLD_FROM, FOLD_TO = "çğıöşüâîû", "cgiosuaiu"

#: What may trail a label: a list of row numbers, a range of them, a footnote mark.
TRAILERS = r"\s*\(\d+(?:\s*[-+]\s*\d+)+\)|\s*\(\d+\s+den\s+\d+'?[a-zçğıöşü]*\)|\s*\(\*+\)|\s*\*+"


def _composed() -> list[tuple[str, str]]:
    """Letters of the Latin blocks that are spelt as a letter and one mark, with that spelling; marks of letters that have one already come after."""
    found = []
    for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.decomposition(chr(i)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.append((len(unicodedata.normalize("NFD", chr(i))), "".join(chr(int(x, 16)) for x in parts), chr(i)))
    return [(a, b) for _, a, b in sorted(found)]


#: Lines of three characters: a letter, its mark, what they are together.
COMPOSED = "\n".join(a + b for a, b in _composed())


def compose(text: Column) -> Column:
    """Letters that are spelt with combining marks as the one letter they are. Text without marks, nearly all, is left as it is; marks must stand in their canonical order."""
    each = F.split(F.lit(COMPOSED), "\n")
    mended = F.aggregate(each, text, lambda s, x: F.replace(s, F.substring(x, 1, 2), F.substring(x, 3, 1)))
    return F.when(text.rlike(r"\p{M}"), mended).otherwise(text)


def casefold(text: Column) -> Column:
    return F.lower(F.translate(compose(text), "Iİ", "ıi"))


def slugify(text: Column) -> Column:
    return F.btrim(F.regexp_replace(casefold(text), r"[^\p{L}\p{M}\p{N}]+", "_"), F.lit("_"))


def column_key(name: Column, index: Column, most: int = 40) -> Column:
    """A name as a key: what isn't a letter or digit is _; seri_N where nothing is left."""
    key = F.btrim(F.substring(F.regexp_replace(casefold(name), r"[^\p{L}\p{M}\p{N}]", "_"), 1, most), F.lit("_"))
    return F.coalesce(F.nullif(key, F.lit("")), F.concat(F.lit("seri_"), index))


def terms(text: Column) -> Column:
    """Folded words of letters and digits."""
    return F.regexp_extract_all(casefold(text), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1))


def collapse_space(text: Column) -> Column:
    """Words with one space between; null if there are none."""
    return F.nullif(F.btrim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def normalise_label(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.btrim(text), rf"(?:{TRAILERS})+$", ""), r"\s+", " "))


def strip_formulas(text: Column) -> Column:
    """Without parentheses of digits and operators, however deep: inner ones go first, and a pass for each opening one is enough."""
    passes = F.sequence(F.lit(0), F.length(text) - F.length(F.replace(text, F.lit("("), F.lit(""))))
    return F.btrim(F.regexp_replace(F.aggregate(passes, text, lambda s, _: F.regexp_replace(s, r"\(\s*[0-9+\-*/.,\s]*\)", " ")), r"\s+", " "))


def tokenize(text: Column) -> Column:
    """Runs of letters or of digits, folded, without stopwords."""
    found = F.regexp_extract_all(casefold(text), F.lit(r"([\p{L}\p{M}]+|[0-9]+)"), F.lit(1))
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(found, lambda t: ~F.array_contains(stop, t))


def shared_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    return F.aggregate(F.sequence(F.lit(0), n), F.lit(0), lambda best, i: F.when(F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i), F.greatest(best, i)).otherwise(best))


def pair_score(a: Column, b: Column) -> Column:
    """1 for equal tokens, 0 if fewer than four letters are shared, else 0.6 and 0.4 times the share of the longer one."""
    p = shared_prefix(a, b)
    return F.when(a == b, 1.0).when(p < MIN_STEM, 0.0).otherwise(0.6 + 0.4 * p / F.greatest(F.length(a), F.length(b)))


def lexical_score(query: Column, concept: Column) -> Column:
    """The harmonic mean of how well two token arrays cover each other, less for each restriction that wasn't asked for."""

    def cover(xs: Column, ys: Column) -> Column:
        best = F.transform(xs, lambda x: F.coalesce(F.array_max(F.transform(ys, lambda y: pair_score(x, y))), F.lit(0.0)))
        return F.aggregate(best, F.lit(0.0), lambda s, v: s + v) / F.size(xs)

    q, c = cover(query, concept), cover(concept, query)
    extra = F.size(F.array_except(F.array_intersect(concept, F.array(*map(F.lit, RESTRICTIVE))), query))
    score = 2 * q * c / (q + c) * F.pow(F.lit(PENALTY), extra)
    return F.when((F.size(query) == 0) | (F.size(concept) == 0) | (q == 0) | (c == 0), 0.0).otherwise(score)


def intent(tokens: Column) -> Column:
    """The sorted measure types that cues among the tokens ask for; the first cue that fits a token counts for it."""
    out = F.array().cast("array<string>")
    hits = []
    for cue, kinds in CUES.items():
        fits = lambda t, cue=cue: (t == cue) | (F.startswith(t, F.lit(cue)) if len(cue) >= MIN_STEM else F.lit(False))
        hits.append((fits, F.array(*map(F.lit, kinds.split()))))

    def of(t: Column) -> Column:
        c = out
        for fits, kinds in reversed(hits):
            c = F.when(fits(t), kinds).otherwise(c)
        return c

    return F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, of))))


def fold_ascii(text: Column) -> Column:
    return F.translate(casefold(text), FOLD_FROM, FOLD_TO)


def caption_unit(caption: Column) -> Column:
    return F.nullif(F.regexp_extract(caption, r"^.*\(([^()]*)\)", 1), F.lit(""))


def strip_layout(text: Column) -> Column:
    """Without layout marks: what a ref mark holds stays, what a det mark holds goes."""
    text = F.regexp_replace(text, r"(?s)<\|det\|>.*?<\|/det\|>", "")
    text = F.regexp_replace(text, r"(?s)<\|ref\|>(.*?)<\|/ref\|>", "$1")
    return F.btrim(F.regexp_replace(text, r"<\|/?[a-z]+\|>", ""))


def split_pair(text: Column) -> Column:
    return F.split(text, r"(?iu)\s+(?:ile|ve|arasında|karşı)\s+")


def first_url(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"(https?://\S+)", 1), r"[.,;)]+$", ""), F.lit(""))
