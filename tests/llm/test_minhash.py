"""Near-duplicates against a brute force over all pairs."""

import random

import numpy as np
import pytest

from tidelake.llm import minhash
from tidelake.llm.common import IdFilter, Scratch

SCHEMA = "doc_id long, text string, extra string"


def shingles(text):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


def result(spark, rows):
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str)


def corpus(seed, groups, passage=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    common, texts = [word() for _ in range(passage)], []
    for size, length, changes in groups:
        base = [word() for _ in range(length)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(changes + 1)):
                own[rng.randrange(length)] = word()
            texts.append(" ".join(own + common))
    rng.shuffle(texts)
    return [(i, t, None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("passage", [0, 60])
def test_groups_of_near_copies_match_brute_force(spark, passage):
    rows = corpus(1, [(120, 150, 3), (60, 120, 5), (30, 200, 9), *[(3, 100, 2)] * 10, *[(1, 90, 0)] * 60], passage)
    assert result(spark, rows) == brute(rows)


def test_many_texts_that_share_most_of_a_passage(spark):
    rows = corpus(2, [(1, 20, 0)] * 40, 100)
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", None), (3, "A b", None), (4, "a B", None), (5, " \n\t ", None), (6, "a b c d e", None), (7, "a b c d e", None), (None, "a b c d e", None), (7, "a b c d e", None), (8, "é b c d e " * 3000, None), (9, " ", None)]
    assert result(spark, rows) == brute(rows)


def test_ids_that_repeat_with_other_texts(spark):
    """Each text of an id links it."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [[word() for _ in range(120)] for _ in range(40)]
    near = [t[:60] + [word()] + t[61:] for t in texts]
    rows = [(i, " ".join(t), None) for i, t in enumerate(texts)] + [((i + 1) % 40 if i < 9 else 100 + i, " ".join(t), None) for i, t in enumerate(near)]
    rows += [(i, " ".join(texts[0][:60] + t[:60]), None) for i, t in enumerate(texts[20:30])]
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_crowded_list_just_below_the_bound(spark, seed):
    """Changes of a base of which few copies are near enough to any centre, but some to each other."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, texts = [word() for _ in range(100)], []
    for _ in range(40):
        own = list(base)
        for at in rng.sample(range(100), 3):
            own[at] = word()
        texts.append(own)
        again = list(own)
        again[rng.randrange(100)] = word()
        texts += [again] * (rng.random() < 0.5)
    rows = [(i, " ".join(t), None) for i, t in enumerate(texts)]
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("held", [3, 10**6])
def test_components_over_one_or_many_tasks(spark, held):
    rng = np.random.default_rng(8)
    edges = [*zip(range(60), range(1, 61), strict=True), *((int(a) + 100, int(b) + 100) for a, b in rng.integers(0, 90, (60, 2))), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = minhash.connected(spark.createDataFrame(edges, "a long, b long").repartition(6), Scratch(spark, "test"), held=held)
    assert sorted(map(tuple, got.collect())) == sorted((x, find(x)) for x in root)
    with pytest.raises(RuntimeError):
        minhash.connected(spark.createDataFrame(edges, "a long, b long").repartition(6), Scratch(spark, "test"), held=3, rounds=1)


def test_overlaps_over_several_widths():
    rng = np.random.default_rng(9)
    xs, ys = ([np.unique(rng.integers(0, 60, n)) for n in sizes] for sizes in ((0, 5, 40, 60), (30, 0, 60)))
    assert (minhash.overlaps(xs, ys, 7) == [[len(np.intersect1d(x, y)) for y in ys] for x in xs]).all()


def test_filter_never_misses_an_id(spark):
    near = IdFilter(spark.range(0, 3000, 3).selectExpr("id AS x"), "x")
    kept = spark.range(9000).withColumn("at", near.at("id")).mapInArrow(lambda batches: (near.pick(b) for b in batches), "id long, at int")
    got = {r.id for r in kept.collect()}
    assert got >= set(range(0, 3000, 3)) and len(got) < 2500


def test_empty_table(spark):
    assert result(spark, []) == []
