"""Cases of which less than the whole was done before."""

import math
import random
import textwrap

import pytest

import corpus_pipeline
from tidelake.llm import licenses, quality_lm, url_filters


def test_pipeline_drops_near_copies_from_80_hundredths(spark):
    base = [f"w{i}" for i in range(104)]
    near = [*base[:30], "x", *base[31:70], "y", *base[71:]]  # 90 of 110 shingles: 0.818
    far = [*base[:20], "p", *base[21:50], "q", *base[51:80], "r", *base[81:]]  # 85 of 115: 0.739
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    left = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in left.collect()) == [1, 3]


def test_every_token_of_a_rule_that_was_mined_as_one_blocks(spark):
    urls = [f"http://bad.net/aa/bb/{i}" for i in range(20)] + [f"http://bad.net/ok/{i}" for i in range(60)]
    labels = spark.createDataFrame([(i, int(i >= 20), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    urls += ["http://new.net/aa/1", "http://new.net/bb/1", "http://new.net/cc/1", "http://new.net/bb/aa/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.verdict, r.mined) for r in url_filters.judge(pages, labels).collect()}
    assert [got[i] for i in range(80, 84)] == [("block", "p:aa"), ("block", "p:bb"), ("allow", None), ("block", "p:bb")]
    assert all(got[i][0] == ("block" if i < 20 else "allow") for i in range(80))


def test_language_model_sees_the_order_of_words(spark):
    rng = random.Random(3)
    ring = ["the", "old", "man", "saw", "his", "red", "cat", "run"]
    said = lambda at: " ".join(ring[(at + j) % 8] for j in range(64))
    texts = [said(rng.randrange(8)) for _ in range(300)]
    mixed = said(0).split()
    rng.shuffle(mixed)
    rows = [*enumerate(texts), (1000, said(0)), (1001, " ".join(mixed)), (1002, " ".join(["cat"] * 64))]
    table = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    for how in ({}, {"broadcast": 0}):
        got = {r.doc_id: r for r in quality_lm.classify(table, labels, **how).collect()}
        assert got[1000].kept and not got[1001].kept and not got[1002].kept
        assert got[1001].perplexity > 1.5 * got[1000].perplexity


def test_sharded_model_judges_each_row(spark):
    good = ["the cat sat on the mat and the dog sat on the cat"] * 100
    rows = [(i, t, "en", i * 10) for i, t in enumerate(good)] + [(7, "#!%XQZ" * 20, "en", 1), (None, "#!%XQZ" * 20, "en", 2), (None, good[0], None, 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, __block int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100) if i != 7], "doc_id long, quality int, toxic int")
    one, two = (sorted((str(tuple(r)) for r in quality_lm.keep(table, labels, **how).collect())) for how in ({}, {"broadcast": 0}))
    assert one == two and len(one) == 101


def test_licences_over_lines_and_amid_sentences(spark):
    mit, gpl = licenses.PARAGRAPHS["MIT paragraph"], licenses.TEMPLATES["GPL-3.0 long"]
    wrapped = "\n".join(" * " + x for x in textwrap.wrap(mit, 72))
    texts = [f"/*\n * Copyright 2020 A\n{wrapped}\n */\nint main", mit, "intro words\n" + "\n".join(textwrap.wrap(gpl, 70)) + "\nmore words", "Copyright 2019 someone else. Released under the MIT License. Have fun with it.", "Released under the MIT License.\nno more", "a permission is a thing\nthat the license is under the"]
    found = licenses.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    got = sorted((r.doc_id, r.line_no, r.license) for r in found)
    assert got == [(0, 3, "MIT paragraph"), (1, 1, "MIT paragraph"), (2, 2, "GPL-3.0 long"), (3, 1, "MIT"), (4, 1, "MIT")]


def plain_kneser_ney(texts, order):
    """The cost (minus logarithm) of the next byte after some others, by the definition: interpolated, three discounts an order, numbers of preceding bytes below the longest order."""
    level = {k: {} for k in range(1, order + 1)}
    for t in texts:
        t = b" " + t + b" "
        for i in range(1, len(t)):
            g = t[max(0, i + 1 - order) : i + 1]
            level[len(g)][g] = level[len(g)].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        before = {g: 1 for g in level[k]}
        for g in level[k + 1]:
            before[g[1:]] = before.get(g[1:], 0) + 1
        level[k] = before
    less = {}
    for k, grams in level.items():
        n = [sum(c == i for c in grams.values()) for i in range(1, 5)]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            d = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05 * i), i) for i in (1, 2, 3)]
        else:
            d = [0.5, 1.0, 1.5]
        less[k] = d

    def p(g):
        if not g:
            return 1 / 256
        k = len(g)
        own = {x: c for x, c in level[k].items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        total, d = sum(own.values()), lambda c: less[k][min(c, 3) - 1]
        seen = own.get(g, 0)
        return (seen - d(seen) if seen else 0) / total + sum(map(d, own.values())) / total * p(g[1:])

    return p


@pytest.mark.parametrize("order", [3, quality_lm.ORDER])
def test_perplexities_and_thresholds_match_a_plain_model(spark, order):
    rng = random.Random(7)
    ring = ["to", "be", "or", "not", "é", "that", "is", "the", "question"]
    rows = [(i, "  ".join(rng.choice(ring) for _ in range(rng.randrange(3, 12))), "xy"[i % 2]) for i in range(260)]
    rows += [(1000, "bet the quest", "x"), (1001, "#! zz", None), (1002, "be", "y"), (1003, " ", "y"), (1004, None, "x"), (None, "not #", "x"), (7, "or or", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(250)], "doc_id long, quality int, toxic int")
    held = {r.doc_id for r in table.selectExpr("doc_id", f"pmod(xxhash64(doc_id), {quality_lm.HELD}) = 0 AS held").where("held").collect()}
    clean = lambda t: b" ".join((t or "").encode().split())
    good = [r for r in rows if r[0] is not None and r[0] < 250 and r[0] % 9]
    p = plain_kneser_ney([clean(t) for i, t, _ in good if i not in held], order)

    def perplexity(t):
        t = b" " + clean(t) + b" "
        return math.exp(sum(-math.log(p(t[max(0, i + 1 - order) : i + 1])) for i in range(1, len(t))) / (len(t) - 1)) if len(t) > 2 else None

    known = [(perplexity(t), lang) for i, t, lang in good if i in held]
    quantile = lambda x: sorted(x)[math.ceil(quality_lm.QUANTILE * len(x)) - 1] * quality_lm.MARGIN
    every = quantile([x for x, _ in known])
    by_lang = {c: quantile(own) if len(own := [x for x, lang in known if lang == c]) >= quality_lm.LEAST_HELD else every for c in "xy"}
    by_id = lambda r: (str(r[0]), r[1], r[2] or 0)
    want = sorted(((i, lang or "", perplexity(t), by_lang.get(lang, every)) for i, t, lang in rows), key=by_id)
    for how in ({}, {"broadcast": 0}):
        scored = quality_lm.classify(table, labels, order=order, **how).collect()
        got = sorted(((r.doc_id, r.lang or "", r.perplexity, r.threshold) for r in scored), key=by_id)
        assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] is None for g in got] == [w[2] is None for w in want]
        assert [x or 0 for g in got for x in g[2:]] == pytest.approx([x or 0 for w in want for x in w[2:]], rel=1e-5)
        assert all(r.kept == (r.perplexity is None or r.perplexity <= r.threshold) for r in scored)
