"""The stages of the pipeline against plain versions, with repeated and null ids, empty texts, empty tables and columns of other names."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_minhash import shingles

import corpus_pipeline
from tidelake.llm import mixing, packing, quality_lm, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_ string, __row string, row_no long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with documents and labels: good prose, near copies, junk, texts that share an id, rows without one."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [prose(rng.randrange(30, 120)) for _ in range(240)]
    rows = list(enumerate(texts))
    for i in range(10):
        w = texts[i].split()
        w[len(w) // 2] = "zz"
        rows.append((1000 + i, " ".join(w)))  # near, if long enough
        rows.append((2000 + i, texts[i]))
    rows += [(3000 + i, "".join(rng.choice("#!%XQZ ") for _ in range(400))) for i in range(20)]
    rows += [(5, prose(80)), (5, prose(80)), (5, texts[7]), (None, prose(60)), (None, texts[8]), (None, None), (6, ""), (4000, " \n "), (4001, "short one")]
    rng.shuffle(rows)
    path = str(tmp_path_factory.mktemp("sf"))
    full = [(i, t, "en", "web", len(t or ""), "x", "y", k) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(3000 + i, 0, i % 2) for i in range(15)], "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    return path


def key(rows):
    return Counter((r.doc_id, r.text, r.source, r["__row"], r.row_no) for r in rows)


def table_by_row(spark, rows, labels):
    """labels with the rows' numbers for ids."""
    of = {}
    for r in labels.collect():
        of.setdefault(r.doc_id, []).append(r)
    found = [(r.row_no, x.quality, x.toxic) for r in rows if r.doc_id is not None for x in of.get(r.doc_id, ())]
    return spark.createDataFrame(found, "doc_id long, quality long, toxic long")


def test_mixing_draws_rows_that_share_an_id_or_have_none(spark):
    """300 toxic rows that share an id with a clean one each, 150 without an id and 150 with their own come out in the same share, the fitted one."""
    rng = random.Random(5)
    clean = lambda: " ".join(rng.choice(["sun", "tree", "river", "bread", "stone", "wind", "house", "road"]) for _ in range(40))
    toxic = lambda: " ".join(rng.choice(["sun", "tree", "river", "scum", "trash", "moron", "vile", "filth"]) for _ in range(40))
    rows = [(i, clean(), "clean") for i in range(3000)] + [(i, toxic(), "shared") for i in range(300)] + [(None, toxic(), "none") for _ in range(150)] + [(10_000 + i, toxic(), "own") for i in range(150)] + [(20_000 + i, toxic(), "told") for i in range(60)]
    table = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], "doc_id long, text string, kind string, __copies int, __copy int, __block int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1000, 1200)] + [(20_000 + i, 1, 1) for i in range(60)], "doc_id long, quality int, toxic int")
    rate = {(r.tokens, round(r.p_toxic)): r.rate for r in mixing.mix(table, labels).collect()}
    assert rate[40, 1] < 0.3
    out = mixing.apply_mix(table, labels)
    assert out.columns == table.columns
    got = Counter(r.kind for r in out.collect())
    for kind, n in (("shared", 300), ("none", 150), ("own", 150)):
        want = rate[40, 1] * n
        assert abs(got[kind] - want) <= 4 * want**0.5 + 1, (kind, got[kind], want)
    assert abs(got["clean"] - 3000 * rate[40, 0]) <= 4 * (3000 * 0.25) ** 0.5


def test_stages_against_plain_versions(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "mixing", "packing"]
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        path = f"{tables}/{name}-{random.random()}"
        out.write.parquet(path)
        after = spark.read.parquet(path)
        steps.append((docs.collect(), after.collect()))
        assert name == "packing" or after.columns == columns
        docs = after
    (before, ruled), (_, clean), (_, single), (_, mixed), (_, packed) = steps

    # rules: the base and each rule on its own, all of them
    def passes(text):
        batch = quality_rules.Batch([text])
        return not any(r.rejects(batch, np.array([0]))[0] for r in (*quality_rules.BASE, *quality_rules.RULES))

    assert key(ruled) == key(r for r in before if passes(r.text)) and len(ruled) > 240

    # classifier: the verdicts of the operator, row by row
    table = spark.read.parquet(f"{tables}/labels.parquet")
    again = quality_lm.classify(spark.createDataFrame([tuple(r) for r in ruled], SCHEMA), table).where("kept").collect()
    assert Counter((r.doc_id, r.n_words) for r in again) == Counter((r.doc_id, len(r.text.split())) for r in clean)
    assert not any(r.doc_id is not None and r.doc_id >= 3000 for r in clean)

    # near-duplicates: components by all pairs of rows, one row of each stays, whatever the ids
    sets = [shingles(r.text) for r in clean]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    group = {r.row_no: find(i) for i, r in enumerate(clean)}
    left = Counter(group[r.row_no] for r in single)
    assert set(left) == set(group.values()) and set(left.values()) == {1} and len(single) < len(clean) - 15
    assert sum(r.doc_id == 5 for r in single) >= 3 and sum(r.doc_id is None for r in single) >= 1  # other texts of an id stay

    # mixing: each row as often as its own rate, rounded up or down, says; a rate is that of a text, whatever the row's id
    rates = {r.doc_id: r for r in mixing.mix(spark.createDataFrame([(r.row_no, r.text) for r in single], "doc_id long, text string"), table_by_row(spark, single, table)).collect()}
    out = Counter(r.row_no for r in mixed)
    assert set(key(mixed)) <= set(key(single))
    for r in single:
        assert out[r.row_no] in (int(rates[r.row_no].rate), int(rates[r.row_no].rate) + 1)
    for d in mixing.DOMAINS:  # totals of tokens by domain
        total = sum(r.tokens for r in rates.values())
        got = sum(out[i] * r.tokens * r[f"p_{d}"] for i, r in rates.items())
        assert abs(got - sum(r.rate * r.tokens * r[f"p_{d}"] for r in rates.values())) < 0.1 * total

    # packing: each id of each row lies in one piece, sequences have no holes
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for r in mixed:
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            expected[(r.doc_id, s, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in packed) == expected
    by = {}
    for p in packed:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_over_an_empty_table_and_one_of_empty_texts(spark, tmp_path):
    for k, rows in enumerate(([], [(1, None), (2, ""), (None, " ")])):
        path = str(tmp_path / str(k))
        spark.createDataFrame([(i, t, None, None, 0, None, None, 0) for i, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
        assert corpus_pipeline.run(spark, path).count() == 0


def plain_fill(counts, window):
    """The fewest unused ids of a window opened by the longest length, by trying all multisets."""
    lengths = sorted(counts.elements(), reverse=True)
    best = {0}
    for length in lengths[1:]:
        best |= {s + length for s in best if s + length <= window - lengths[0]}
    return window - lengths[0] - max(best)


def test_each_window_has_the_least_slack_possible():
    rng = random.Random(3)
    for _ in range(200):
        window = rng.randrange(8, 40)
        left = Counter(rng.randrange(1, window + 1) for _ in range(rng.randrange(1, 12)))
        for used, times in packing.fill(dict(left), window):
            for _ in range(times):
                assert max(used) == max(left) and window - sum(k * n for k, n in used.items()) == plain_fill(left, window)
                left = +(left - Counter(used))
        assert not left
