"""Operator 1, URL filters by association rules, with DataFrame functions and Spark's FP-growth alone.

Urls are parted into tokens that say where they stand (host, path or query). Labelled pages are transactions of their url's tokens and a token for bad
pages (low quality or toxic). FP-growth mines them; rules "these tokens -> bad" are kept if their support and confidence suffice and no rule with
fewer tokens is as sure. The rules are held in an inverted index under their rarest token; a url that has a rule's rarest token is compared with the rest
of that rule, and a match blocks it. Fixed rules of a host and a path go before: the longest that fits decides.

Tokens that occur in exactly the same labelled pages are mined as one, so that a long path that many urls share doesn't multiply into all its subsets.
Plain FP-growth finds each rule again with any of them in the other's place, as sure; so each stands for all in a rule, and a url needs one of them.

Labels are taken by their id as they are. Where they say nothing about urls (bad pages are as frequent under all tokens), no rule is sure enough and the fixed rules
alone decide; the number of rules is logged.

Defined cases: a null url, or one without "://", has an empty host and path and is allowed. Of repeated labels the worst counts; labels without a quality count for nothing.
Without labels nothing is mined, and urls without a fixed rule are allowed. Repeated rows are judged each. An empty table gives an empty result.
"""

from __future__ import annotations

import logging
import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import Scratch, trusted_labels

log = logging.getLogger(__name__)

#: Fixed rules: a host (with its subdomains) and the beginning of a path; True: allow.
RULES = (("org/", True), ("example.org/es/", False), ("example.org/en/1", False), ("com/fr/", True), ("com/de/", False))
#: Least share and number of labelled pages that have a rule's tokens and are bad; least share of bad ones among those that have its tokens.
SUPPORT, LEAST, CONFIDENCE = 0.002, 8, 0.8
BAD = "=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What stands after the first "://" up to "/", "?", "#" or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What stands after the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(rules: tuple[tuple[str, bool], ...] = RULES) -> Column:
    """The longest rule that fits the columns host and path, else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        own, slash, rest = rule.partition("/")
        fits = ((F.col("host") == own) | F.endswith(F.col("host"), F.lit("." + own))) & F.startswith(F.col("path"), F.lit(slash + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens of a url: host labels, parts of the path, names in the query; digits are written as one 0, so that numbers are alike."""

    def parts(text: Column, tag: str, at: str) -> Column:
        found = F.filter(F.split(F.regexp_replace(F.lower(text), "[0-9]+", "0"), at), lambda x: x != "")
        return F.transform(found, lambda x: F.concat(F.lit(tag), x))

    query = F.regexp_replace(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "=[^&]*", "")
    return F.array_distinct(F.concat(parts(host(url), "h:", r"[^\p{L}0-9-]+"), parts(path(url), "p:", r"[^\p{L}0-9]+"), parts(query, "q:", r"[^\p{L}0-9_]+")))


def mine(pages: DataFrame, labels: DataFrame, tmp: Scratch, page_id: str = "page_id", url: str = "url", support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (items: array of tokens, alike: for each item the tokens that may stand in its place, itself among them, confidence, n: labelled pages that have them) for bad pages."""
    truth = trusted_labels(labels).select(F.col("doc_id").alias("id"), ((F.col("quality") <= 0) | (F.col("toxic") > 0)).alias("bad"))
    # the label column's name can't clash with the pages' own: only id, url and bad are kept
    own = pages.where(F.col(page_id).isNotNull()).select(F.col(page_id).cast("long").alias("id"), F.array_distinct(tokens(F.col(url))).alias("items")).join(truth, "id")
    own = tmp.cut(own, "labelled")
    n = own.count()
    least = max(LEAST, math.ceil(support * n))
    where = own.select("id", "bad", F.explode("items").alias("item"))
    kinds = where.groupBy("item").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("a"), F.sum(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1 << 40))).alias("b")).where(F.col("n") >= least)
    twin = tmp.cut(kinds.groupBy("n", "a", "b").agg(F.min("item").alias("item"), F.sort_array(F.collect_set("item")).alias("alike")), "items")
    baskets = where.join(twin.select("item"), "item").groupBy("id").agg(F.collect_list("item").alias("items"), F.bool_or("bad").alias("bad"))
    baskets = tmp.cut(baskets.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")), "baskets")
    held = baskets.count()
    # half a page less than the bound, so that no rounding of the share moves it
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, held)), minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(F.sort_array("antecedent").alias("items"), "confidence", F.round(F.col("support") / F.col("confidence") * held).cast("long").alias("n"))
    rules = tmp.cut(rules, "mined")
    log.info("%d labelled pages, %d rules of bad pages", n, rules.count())
    # pruned: a rule is dropped if one with fewer of its tokens is as sure
    wide = rules.select(F.col("items").alias("less"), F.col("confidence").alias("sure"), F.explode("items").alias("item"))
    tight = rules.select("items", "confidence", F.explode("items").alias("item"))
    beaten = tight.join(wide, "item").where((F.size("less") < F.size("items")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("less", "items")) == 0)).select("items")
    left = rules.join(beaten.distinct(), "items", "left_anti")
    alike = left.select("items", F.explode("items").alias("item")).join(twin.select("item", "alike"), "item").groupBy("items").agg(F.sort_array(F.collect_list(F.struct("item", "alike"))).alias("x"))
    return tmp.cut(left.join(alike, "items").select("items", F.col("x.alike").alias("alike"), "confidence", "n"), "rules")


def matches(urls: DataFrame, rules: DataFrame, tmp: Scratch) -> DataFrame:
    """(url, mined): the surest rule of each of the urls that has one, written with the url's own tokens, found by the inverted index on each rule's rarest item, under all tokens that may stand for it."""
    known = tmp.cut(urls.select("url", tokens(F.col("url")).alias("tokens")), "tokens")
    group = rules.select("items", "alike", "confidence", F.posexplode("alike").alias("at", "any"))
    item = group.withColumn("item", F.explode("any"))
    seen = known.select(F.explode("tokens").alias("item")).join(item.select("item").distinct(), "item", "left_semi").groupBy("item").count()
    often = item.join(seen, "item", "left").groupBy("items", "alike", "confidence", "at", "any").agg(F.sum(F.coalesce("count", F.lit(0))).alias("often"))
    index = often.groupBy("items", "alike", "confidence").agg(F.min_by("any", F.struct("often", "at")).alias("any")).select("alike", "confidence", F.explode("any").alias("item"))
    # of a url's several tokens for one item the last is named: the greatest of the equally sure rules
    own = F.transform("alike", lambda any_: F.array_max(F.array_intersect(any_, F.col("tokens"))))
    hit = known.select("url", "tokens", F.explode("tokens").alias("item")).join(tmp.cut(index, "index"), "item").withColumn("own", own).where(~F.exists("own", lambda x: x.isNull()))
    return hit.groupBy("url").agg(F.max_by(F.array_join(F.sort_array("own"), " "), F.struct("confidence", F.sort_array("own"))).alias("mined"))


def judge(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[tuple[str, bool], ...] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict and mined, the mined rule that decided where no fixed rule did."""
    tmp = Scratch(pages.sparkSession, "urls")
    page = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    found = matches(page.where("url IS NOT NULL").select("url").distinct(), mine(pages, labels, tmp, page_id, url, support, confidence), tmp)
    out = page.join(tmp.cut(found, "found"), "url", "left").withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).withColumn("rule", fixed_rule(rules))
    allowed = F.col("rule").isin([r for r, allow in rules if allow])
    verdict = F.when(F.col("rule").isNotNull(), F.when(allowed, "allow").otherwise("block")).when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("mined")).alias("mined"))
