"""Hard negatives, toxicity and importance resampling against plain versions, with nulls, ties, repeats, empty tables, long texts and clashing columns; and what op7's sketches miss."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidelake.llm import minhash, negatives, resampling, toxicity

# ---- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, name string, key long, e int, score long, dim int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, y, "x", 1, 2, 3, 4) for i, e, y in rows], VECTORS)


def plain_negatives(rows, scale=256):
    good = [(i, np.floor(scale * np.array(e, np.float32).astype(float)), y) for i, e, y in rows if i is not None and y is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    good = [(i, e, (y + 1) % 10 if i % 7 == 0 else y) for i, e, y in good]
    out = Counter()
    for a, q, y in good:
        if a % 100:
            continue
        others = sorted((-int(q @ e), i, label) for i, e, label in good if i != a and len(e) == len(q))
        for s, p, _ in [x for x in others if x[2] == y][:5]:
            near = [(n, i) for n, i, label in others if label != y and 80 * -s <= 100 * -n <= 100 * -s]
            out.update((a, p, k, i, -s, -n) for k, (n, i) in enumerate(near[:5], 1))
    return out


def mined(spark, rows, **how):
    from pyspark.sql import functions as F

    got = negatives.mine(negatives.moved(vectors(spark, rows)), F.col("vec_id") % 100 == 0, **how).collect()
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)


def test_hard_negatives_by_all_pairs(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)], rng.randrange(3)) for i in range(420)]  # many ties
    rows += [(i, [rng.gauss(0, 1) for _ in range(3)], rng.randrange(2)) for i in range(500, 560)] + [(600, [1.0, 1.0, 1.0], 0), (601, [1.0, 1.0, 1.0], 1), (602, [1.0, 1.0, 1.0], 0)]  # another dimension
    rows += [(None, [1.0] * 4, 1), (700, None, 1), (701, [1.0, None, 1.0, 1.0], 1), (702, [float("nan")] * 4, 1), (703, [float("inf")] * 4, 1), (704, [], 1), (705, [1.0] * 4, None), (800, [1.0] * 4, 9)]
    rows += [rows[5]] * 3 + [rows[100]] + [(3, [0.5] * 4, 2)]  # repeats, an anchor among them; another vector of an id
    want = plain_negatives(rows)
    assert len(want) > 60 and mined(spark, rows) == want
    assert mined(spark, rows, pivots=3, group=40, block=8, asks=2, ranges=3) == want  # many groups, blocks and cells


def test_hard_negatives_of_one_hot_vector_and_of_none(spark):
    rows = [(i, [1.0, 0.0], i % 2) for i in range(300)] + [(400, [0.0, 0.0], 0)]
    assert mined(spark, rows, group=64, block=16) == plain_negatives(rows)
    assert mined(spark, []) == Counter() and mined(spark, [(1, [1.0], 1)]) == Counter()


def test_brackets_hold_every_score():
    rng = np.random.default_rng(3)
    x, q = np.floor(256 * rng.standard_normal((400, 8))), np.floor(256 * rng.standard_normal((30, 8)))
    p = negatives.Pivots(x[:64], float((x * x).sum(1).max()), 6)
    low, high = negatives.brackets((q * q).sum(1), p.of_anchors(q), p.of_rows(x), p.of_rows(x), p.most)
    score = q @ x.T
    assert (low <= score).all() and (score <= high).all()
    near = x[:1] * 0.999  # what is close to a pivot is bracketed closely
    low, high = negatives.brackets((near * near).sum(1), p.of_anchors(near), p.of_rows(p.points[:, :-1]), p.of_rows(p.points[:, :-1]), p.most)
    assert (high - low).min() < 0.5 * p.most


# ---- toxicity


def plain_logit(at, bias, w, v):
    return bias + sum(w[i] for i in at) + sum(float(v[i] @ v[j]) for k, i in enumerate(at) for j in at[:k])


def test_logits_are_sums_over_all_pairs():
    rng = np.random.default_rng(2)
    w, v = rng.standard_normal(50), rng.standard_normal((50, 3))
    texts = [np.sort(rng.choice(50, n, False)) for n in (7, 0, 1, 12)]
    got = toxicity.logits(np.concatenate(texts), np.cumsum([len(t) for t in texts]), 0.3, w, v)
    assert got == pytest.approx([plain_logit(t.tolist(), 0.3, w, v) for t in texts], abs=1e-6)


def talk(rng):
    """An insult beside a group's name is toxic; two insults, or two names, aren't. No sum of weights of words tells them apart."""
    kind, a, b = rng.randrange(4), rng.sample(["vile", "filth"], 2), rng.sample(["northmen", "islanders"], 2)
    said = [*([a[0], b[0]] if kind < 2 else a if kind == 2 else b), *(f"n{rng.randrange(200)}" for _ in range(rng.randrange(5, 30)))]
    rng.shuffle(said)
    return " ".join(said), int(kind < 2)


def test_pairs_of_words_are_learned_where_words_alone_tell_nothing(spark):
    rng = random.Random(8)
    rows = [(i, *talk(rng)) for i in range(3000)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t, _ in rows], "doc_id long, text string, lang string, y string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items()) and len(held) > 400
    assert sum(r.predicted == y for r, y in held) > 0.97 * len(held)
    model = toxicity.train(docs, labels)
    model.v[:] = 0
    alone = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert sum(alone[r.doc_id] == y for r, y in held) < 0.7 * len(held)


def test_toxic_words_of_long_and_short_texts_in_shards(spark):
    rng = random.Random(9)
    prose = lambda n: [f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(n)]
    rows = []
    for i in range(2400):
        said = prose(rng.choice([3, 60, 60, 60, 1500 if i % 40 == 0 else 60]))
        if i % 6 == 0:
            said.insert(rng.randrange(len(said)), rng.choice(["scum", "Moron!", "trashface", "trashheap"]))
        rows.append((i, " ".join(said), int(i % 6 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels, shard=900).collect()}
    held = [(got[i], y) for i, _, y in rows if got[i].held_out]
    assert sum(r.predicted == y for r, y in held) >= 0.97 * len(held)


def test_toxicity_of_nothing(spark):
    rows = [(1, None), (2, ""), (None, "scum"), (3, "scum " * 50_000), (3, "x"), (4, "!!")]
    docs = spark.createDataFrame([(*r, 1, 2.0, "h") for r in rows], "doc_id long, text string, y int, score double, held string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, none).collect()
    assert len(got) == 6 and all(r.predicted == 0 and 0 < r.score < 0.5 for r in got) and [r.held_out for r in got if r.doc_id is None] == [False]
    assert toxicity.classify(docs.where("doc_id > 99"), none).count() == 0
    some = spark.createDataFrame([(3, 1, 0), (3, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.classify(docs, some).count() == 6


# ---- resampling


def plain_words(text):
    kept = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
    return (text or "").encode().translate(kept).split()


def plain_resampling(docs, target):
    grams = lambda t: (w := plain_words(t)) + [a + b" " + b for a, b in zip(w, w[1:], strict=False)]
    bucket = lambda f: zlib.crc32(f) % 10_000
    s, t = Counter(), Counter()
    for text, c in [*((x, s) for _, x in docs), *((x, t) for x in target)]:
        c.update(map(bucket, grams(text)))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out = []
    for i, text in docs:
        f = grams(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text))])
    fit = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): k for k, r in enumerate(fit[: 25 * len(fit) // 100], 1)}
    return Counter((*r[:4], drawn.get(id(r))) for r in out)


def resampled(spark, docs, target, **how):
    table = spark.createDataFrame([(*d, 1, "s", 3, 4) for d in docs], "doc_id long, text string, id int, side string, weight int, score int")
    other = spark.createDataFrame([(k, x, 9) for k, x in enumerate(target)], "item_id long, text string, id int")
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in resampling.resample(table, other, **how).collect())


def test_resampling_against_plain_version(spark):
    rng = random.Random(6)
    vocabulary = ["sun", "Été", "naïve", "x1", "MIXED", "don't", "straße", "日本", "a_b", "tab\tin", *(f"w{i}" for i in range(400))]
    prose = lambda n: rng.choice([" ", "\n", ", "]).join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, prose(rng.randrange(1, 60))) for i in range(300)] + [(400, None), (401, ""), (402, "?! ..."), (403, "one"), (None, prose(30)), (404, prose(20_000)), (405, "x" * 100_000)]
    docs += [(500 + i, docs[3][1]) for i in range(40)] + [docs[7]]  # a hot text; a repeated row
    target = [prose(40) for _ in range(20)] + ["sun sun sun", None]
    want = plain_resampling(docs, target)
    assert sum(k[4] is not None for k in want) > 20
    assert resampled(spark, docs, target) == want
    assert resampled(spark, docs, target, block=3000, shard=40, cell=300) == want  # many blocks, shards and cells


def test_resampling_without_target_documents_or_words(spark):
    docs = [(1, "a b c"), (2, None), (3, "word " * 30), (4, "word other " * 30), (5, "z " * 25), (6, "q r " * 40)]
    assert resampled(spark, docs, []) == plain_resampling(docs, [])
    assert resampled(spark, [], ["a b"]) == Counter()
    assert resampled(spark, [(1, None), (2, " ")], [None]) == plain_resampling([(1, None), (2, " ")], [None])


def test_numbers_are_packed_and_unpacked():
    rng = np.random.default_rng(1)
    for v in (np.empty(0, np.int64), np.array([0]), rng.integers(0, 1 << 62, 1000)):
        assert (resampling.unpack(resampling.pack(v)) == v).all() and (resampling.unpack(resampling.pack(np.sort(v), True), True) == np.sort(v)).all()


# ---- what sketches miss


def test_sketches_miss_no_pair_at_the_bound():
    """100,000 pairs of similarity 0.85: prefixes of sketches meet in the order of the values, and estimates allow the bound."""
    rng = np.random.default_rng(5)
    k = minhash.SKETCH
    assert minhash.prefix_length(k) == 25 and [minhash.least_shared(n) for n in (1, 2, 10)] == [1, 1, 1]
    for _ in range(100_000):
        v = rng.integers(-(1 << 63), (1 << 63) - 1, 200)
        a, b = np.sort(v[:185])[:k], np.sort(v[15:])[:k]  # 170 of 200 shared
        assert minhash._estimated(a, b, 85)
        shared = np.intersect1d(a, b)
        rare = rng.permutation(v)  # any order of rarity
        place = {x: i for i, x in enumerate(rare.tolist())}
        first = [set(sorted(s.tolist(), key=place.get)[: minhash.prefix_length(k)]) for s in (a, b)]
        assert len(shared) >= minhash.least_shared(k) and first[0] & first[1]
