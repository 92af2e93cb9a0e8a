"""The corpus operators against plain versions, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidelake.llm import chat, licenses, mixing, packing, quality_lm, quality_rules, topk, url_filters, warc

DOCS = "doc_id long, text string, lang string, source string, copies string, row_no string"
LONG = "a b c d e f g " * 20_000


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, None, "x", None) for i, t in texts], DOCS)


# ---- quality rules


def plain_base(text):
    for c in "\t\n\x0b\x0c\r":
        pass
    w = [x.decode() for x in (text or "").encode().split()]
    windows = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i : i + 5]), []).append(i)
    hit = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    n = len(w)
    failed = n < 10 or 100 * len(hit) > 20 * n
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed


def test_rules_match_plain_statistics(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab cé # | \n x\ty").strip(" ") or "q" for _ in range(rng.randrange(60))) for _ in range(80)]
    rows = list(enumerate([None, "", " \n\n ", "é" * 12, "a\na\nb", " x y z", LONG, "w " * 30, *texts]))
    got = {r.doc_id: r for r in quality_rules.judge(docs(spark, rows)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_base(t), t
        assert not (r.base_failed and r.kept)
    kept = quality_rules.apply_rules(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept) and kept.columns == docs(spark, rows).columns
    assert quality_rules.judge(docs(spark, [])).count() == 0


def test_order_of_rules_changes_no_verdict():
    batch = ["a b c d e f g h i j k", "# # # # # # # # # # #", "x\n" * 20]
    one, _ = quality_rules.cascade(quality_rules.Batch(batch), quality_rules.RULES)
    two, _ = quality_rules.cascade(quality_rules.Batch(batch), quality_rules.RULES[::-1])
    assert (one == two).all()


# ---- packing


def test_packing_is_an_exact_partition_with_little_padding(spark):
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefé") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(900))) for _ in range(300)]
    rows = list(enumerate([None, "", "  \n x", "a <|endoftext|> b", "中文   x", LONG, *texts]))
    got = packing.pack_documents(docs(spark, rows), path, with_ids=True).toPandas()
    tok, total = Tokenizer.from_file(path), 0
    for i, t in rows:
        ids, at = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in got[got.doc_id == i].sort_values("start").itertuples():
            part = ids[at : at + p.length]
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(part.tobytes()) and list(p.ids) == part.tolist()
            at += p.length
        assert at == len(ids)
        total += at
    padding = 0
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
        padding += 2048 - g.length.sum()
    assert padding < 0.02 * total
    assert packing.pack_documents(docs(spark, []), path).count() == 0


def test_fill_uses_up_the_multiset():
    counts = {7: 3, 5: 4, 3: 10, 2: 1}
    left = dict(counts)
    for used, times in packing.fill(counts, 12):
        assert sum(k * n for k, n in used.items()) <= 12
        for k, n in used.items():
            left[k] -= n * times
    assert not any(left.values())


# ---- top-k


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1500, 8)).astype(np.float32)
    base[100:400] = base[7]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(base)] + [(5000, None, 0), (5020, [1.0, None] * 4, 0), (5040, [float("nan")] * 8, 0), (5060, [], 0), (None, [1.0] * 8, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block int")
    got = {}
    for r in topk.top_k(table, table.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = np.floor(64 * base.astype(float)).astype(int)
    assert set(got) == set(range(0, 1500, 20))
    for i in range(0, 1500, 20):
        want = sorted(((-int(q[i] @ q[j]), j) for j in range(1500) if j != i))[:20]
        assert sorted(got[i]) == [(k, j, -s) for k, (s, j) in enumerate(want, 1)]
    none = table.where("vec_id < 0")
    assert topk.top_k(none, none).count() == 0


def test_top_k_keeps_repeated_rows_as_its_sql_does(spark):
    """Many small groups, repeated ids with equal and other vectors, ties, and fewer candidates than places."""
    rng = np.random.default_rng(4)
    base = np.round(rng.normal(size=(300, 6)), 1)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [rows[3]] * 30 + [rows[20]] * 3 + [(40, rows[7][1]), (41, rows[3][1])] + [(1000 + i, [1.0, float(i)]) for i in range(0, 60, 10)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [list(r) for r in rows])
    sql = topk.SQL.replace("WHERE q.vec_id % 20 = 0 AND", "WHERE len(q.e) = len(c.e) AND q.vec_id % 20 = 0 AND")
    want = sorted(con.execute(sql).fetchall())
    for how in ({}, {"block": 16, "group": 3, "asks": 4}):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(table, table.where("vec_id % 20 = 0"), **how).collect())
        assert got == want


# ---- WARC


def test_round_trip_with_records_inside_payloads(spark):
    rng = random.Random(1)
    inside = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:777>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = []
    for i in range(200):
        body, k = "x" * rng.randrange(3000), rng.random()
        if k < 0.2:
            body += inside + "y" * rng.randrange(50)
        elif k < 0.3:
            body += inside * 5
        elif k < 0.4:
            body = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {rng.randrange(9000)}\r\n\r\n" + body
        elif k < 0.6 and rows:
            body = rng.choice(rows)[2]
        elif k < 0.65:
            body = None
        rows.append((i, f"http://a/{i}\n" if i % 7 else None, body, "z"))
    table = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, "20000")
        got = warc.round_trip(table).collect()
    finally:
        spark.conf.set(key, was)
    first = {}
    for r in sorted(got, key=lambda r: r.page_id):
        raw = (rows[r.page_id][2] or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        known = first.setdefault(digest, r.page_id)
        again = known != r.page_id
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), digest, "revisit" if again else "response", known if again else None)
    assert len(got) == 200 and all(r.intact for r in got)
    assert warc.round_trip(table.where("page_id < 0")).count() == 0


# ---- chat, licences, urls


def test_perspectives(spark):
    rows = [(1, 0, "system", "s", 0), (1, 1, "ann", "hi", 0), (1, 2, "bob", "yo <|im_end|>", 0), (1, 2, "bob", "yo <|im_end|>", 0), (2, 0, None, None, 0), (3, 0, "system", "x", 0), (None, None, "ann", "q", 0)]
    got = {(r.conv_id, r.perspective): r for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "ann")}
    ann = got[1, "ann"]
    assert ann.rendered.startswith("<|im_start|>system\ns<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n")
    assert [ann.rendered[m.start : m.start + m.length] for m in ann["mask"]] == ["hi<|im_end|>\n"]
    assert len(got[1, "bob"]["mask"]) == 2 and got[1, "bob"].n_turns == 4


def test_licences(spark):
    rows = list(enumerate([None, "", "x\nReleased under the MIT License.\ny", "licensed UNDER the apache license version 2 0", "a long story of a license", LONG, "MIT"]))
    got = {(r.doc_id, r.line_no, r.license) for r in licenses.scan(docs(spark, rows)).collect()}
    assert got == {(2, 2, "MIT"), (3, 1, "Apache-2.0")}
    assert licenses.scan(docs(spark, [])).count() == 0


def test_urls(spark):
    urls = [None, "no scheme", "HTTPS://A.ORG/x", "http://example.org/es/1", "http://m.example.org/en/12?q", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/de/", "http://notorg/", "http://a.org", "http://a.org?x/y"]
    urls += [f"http://bad.net/spam/{i}" for i in range(60)] + [f"http://good.net/ok/{i}" for i in range(60)]
    pages = spark.createDataFrame([(i, u, "h", "t") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    labels = spark.createDataFrame([(i, 0 if "spam" in (u or "") else 1, 0) for i, u in enumerate(urls)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_filters.judge(pages, labels).collect()}
    assert len(got) == len(urls) and (got[0].host, got[0].path, got[1].host) == ("", "", "")
    assert [got[i].rule for i in range(2, 11)] == ["org/", "example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None]
    assert got[2].host == "a.org" and got[3].verdict == got[4].verdict == got[7].verdict == "block" and got[6].verdict == "allow"
    assert all((r.verdict == "block") == ("spam" in urls[i]) for i, r in got.items() if i > 10)
    assert {r.verdict for r in url_filters.judge(pages, labels.where("doc_id < 0")).where("rule IS NULL").collect()} == {"allow"}


# ---- language model and mixing


def corpus(seed, n):
    rng = random.Random(seed)
    good = lambda: " ".join(rng.choice(["the", "then", "there", "other", "wether", "and", "hand"]) for _ in range(60))
    bad = lambda: " ".join("".join(rng.choice("#!%XQZ") for _ in range(5)) for _ in range(60))
    return [(i, bad() if i % 5 == 0 else good()) for i in range(n)]


def test_language_model_keeps_clean_and_rejects_junk(spark):
    rows = corpus(4, 400) + [(900, None), (901, "")]
    table = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(300)] + [(None, 1, 0), (1, 1, None)], "doc_id long, quality int, toxic int")
    one = {r.doc_id: r for r in quality_lm.classify(table, labels).collect()}
    two = {r.doc_id: r for r in quality_lm.classify(table, labels, broadcast=0).collect()}
    assert all(one[i].kept == (i % 5 != 0) for i in range(400)) and one[900].kept and one[901].perplexity is None
    assert all(one[i].kept == two[i].kept and (one[i].perplexity is None or abs(one[i].perplexity - two[i].perplexity) < 1e-6 * one[i].perplexity) for i in one)
    assert quality_lm.keep(table, labels).columns == table.columns
    assert quality_lm.classify(table, labels.where("doc_id < 0")).where("NOT kept").count() == 0


def test_kneser_ney_sums_to_one(spark):
    import pyarrow as pa
    import zstandard

    words = ["the", "then", "a", "hat", "that", "heat"] * 3 + ["tea"]
    z = zstandard.ZstdCompressor().compress(" ".join(words).encode())
    from tidelake.llm.common import Scratch

    packed = spark.createDataFrame([(bytearray(z),)], "z binary")
    rows = quality_lm.estimate(quality_lm.count_ngrams(packed), Scratch(spark, "test")).toPandas().sort_values("key")
    model = quality_lm.Model(rows.key.to_numpy(), rows.value.to_numpy())
    for prefix in (b"", b"t", b"th", b"the", b"q"):
        start = model.costs([prefix])[0] if prefix else 0.0
        del start
        total = 0.0
        for b in range(256):
            if b in (9, 10, 11, 12, 13, 32):
                continue
            gram, length, _ = quality_lm.expand([prefix + bytes([b])])
            at = len(prefix)
            one = quality_lm.Model(model.keys, model.values)
            total += np.exp(-_cost(one, int(gram[at]), int(length[at])))
        for b in (9, 10, 11, 12, 13, 32):
            g = int.from_bytes((b" " + prefix + bytes([b]))[-quality_lm.ORDER :], "big")
            total += np.exp(-_cost(model, g, min(len(prefix) + 2, quality_lm.ORDER)))
        assert abs(total - 1) < 1e-3, prefix
    assert pa is not None


def _cost(model, gram, length):
    for k in range(length, 0, -1):
        g = gram & ((1 << 8 * k) - 1)
        seen, value = model.find(np.array([g | k << quality_lm.TAG]))
        if seen[0]:
            return _cost.extra(model, gram, length, k) - value[0]
    return _cost.extra(model, gram, length, 0) + np.log(256)


def _extra(model, gram, length, stop):
    out = 0.0
    for k in range(length, stop, -1):
        g = gram & ((1 << 8 * k) - 1)
        known, weight = model.find(np.array([g >> 8 | k << quality_lm.TAG | 1 << 62]))
        out -= weight[0] if known[0] else 0.0
    return out


_cost.extra = _extra


def test_mixing_meets_its_targets(spark):
    rows = corpus(5, 300) + [(900, None), (901, "")]
    table = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = mixing.mix(table, labels, targets={"clean": 0.9, "low": 0.1, "toxic": 0.0}).toPandas()
    w = got.rate * got.tokens / got.tokens.sum()
    assert abs((w * got.p_clean).sum() - 0.9) < 0.01 and abs((w * got.p_low).sum() - 0.1) < 0.01 and (got.rate >= 0).all() and len(got) == 302
    assert mixing.mix(docs(spark, []), labels).count() == 0
    out = mixing.apply_mix(table, labels)
    assert out.columns == table.columns and out.count() == mixing.mix(table, labels).agg(F.sum("copies")).first()[0]


@pytest.mark.parametrize("target", [[0.6, 0.3, 0.1], [0.98, 0.01, 0.01], [0.2, 0.2, 0.6]])
def test_fit_equals_brute_force(spark, target):
    """Targets that can be met are; the rates are then those nearest to 1, as many plain steps find them. Targets that can't be met are missed by as little as a plain nonnegative least squares misses them."""
    rng = np.random.default_rng(6)
    w = rng.integers(1, 100, 50).astype(float)
    for p in (rng.dirichlet([1, 1, 1], 50), rng.dirichlet([30, 2, 1], 50)):
        table = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(w, p, strict=True)], "tokens long, p array<double>").repartition(3)
        want = np.array(target) * w.sum()
        rate = mixing.rates(p, mixing.fit(table, want))
        plain, step = np.ones(50), 1 / np.linalg.eigvalsh((p * w[:, None]).T @ p)[-1]
        for _ in range(200_000):
            plain = np.maximum(0, plain - step * p @ ((w * plain) @ p - want))
        off = lambda r: np.abs((w * r) @ p - want).max() / w.sum()  # noqa: E731,B023
        assert off(rate) <= off(plain) + 2e-4 and (rate >= 0).all()
        if off(plain) < 1e-6:
            assert (w * (rate - 1) ** 2).sum() <= (w * (plain - 1) ** 2).sum() * 1.01 + 1e-9


# ---- more cases


def plain_urls(urls, labels, least=8, confidence=0.8):
    """Which urls mined rules block: all sets of up to four raw tokens, those with enough support and confidence."""
    import itertools
    import re

    def parts(text, tag, at):
        return [tag + x for x in re.split(at, re.sub("[0-9]+", "0", text.lower())) if x]

    def tokens(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url or "")
        if not m:
            return frozenset()
        query = re.sub("=[^&]*", "", m[3] or "")
        return frozenset(parts(m[1], "h:", "[^a-z0-9-]+") + parts(m[2], "p:", "[^a-z0-9]+") + parts(query, "q:", "[^a-z0-9_]+"))

    known = [(tokens(urls[i]), bad) for i, bad in labels.items()]
    counts = {}
    for own, bad in known:
        for k in range(1, 5):
            for some in itertools.combinations(sorted(own), k):
                n = counts.setdefault(some, [0, 0])
                n[0] += 1
                n[1] += bad
    rules = [set(k) for k, (n, bad) in counts.items() if bad >= least and bad / n >= confidence]
    return [any(r <= tokens(u) for r in rules) for u in urls]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mined_rules_match_a_plain_miner(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["aa", "bb", "cc", "dd", "ee"])
    urls = [f"http://{rng.choice('xyz')}.net/{word()}/{word()}/{rng.randrange(99)}" for _ in range(500)]
    urls += [None, "", "x" * 50_000, "http://x.net/" + "aa/" * 20_000, urls[0], urls[0]]
    bad = {i: int(("aa" in u.split("/") and "x.net" in u) or ("dd/ee" in u) or rng.random() < 0.1) for i, u in enumerate(urls[:300])}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, b in bad.items()] + [(5, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_filters.judge(pages, labels).collect()}
    want = plain_urls(urls, bad)
    assert [got[i] == "block" for i in range(len(urls))] == want and 0 < sum(want) < 400
    assert url_filters.judge(pages.where("page_id < 0"), labels).count() == 0


def test_records_that_repeat_their_id_and_payload(spark):
    """All rows of the smallest id are responses; rows without an id refer to nothing."""
    rows = [(5, "u", "same"), (5, "u", "same"), (9, "u", "same"), (None, "u", "same"), (None, "u", None)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got)) == [(0, "response", 0), (0, "response", 0), (5, "response", 0), (5, "response", 0), (9, "revisit", 5)]


def test_long_conversations_in_parts_and_none(spark):
    rows = [(1, k, "ann" if k % 2 else "bob", f"t{k}") for k in range(2500)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(chat.rotate(table).where("perspective = 'ann'").collect(), key=lambda r: r.part)
    assert [r.n_turns for r in got] == [1024, 1024, 452]
    whole = "".join(r.rendered for r in got)
    assert whole == "".join(f"<|im_start|>{'assistant' if k % 2 else 'user name=bob'}\nt{k}<|im_end|>\n" for k in range(2500))
    assert chat.rotate(table.where("conv_id < 0")).count() == 0


def plain_licences(text, templates, paragraphs, percent=80):
    """All lines and windows of a text that match, as (line, licence, common)."""
    import re

    norm = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).split()
    pairs = lambda w: {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}
    lines = (text or "").split("\n")
    words, of, out, matched = [], [], [], set()
    for i, line in enumerate(lines, 1):
        w = norm(line)
        words += w
        of += [i] * len(w)
        own, best = pairs(w), None
        for name, wording in sorted(templates.items()):
            t = pairs(norm(wording))
            common = len(own & t)
            if own and 200 * common >= percent * (len(own) + len(t)) and (best is None or common * (len(own) + best[2]) > best[1] * (len(own) + len(t))):
                best = (name, common, len(t))
        if best:
            out.append((i, best[0], best[1]))
            matched.add(i)
    windows = []
    for name, wording in (templates | paragraphs).items():
        w = norm(wording)
        t, span = pairs(w), len(w)
        for s in range(len(words)):
            part = words[s : s + span]
            own = pairs(part)
            if len(part) > 1 and f"{part[0]} {part[1]}" in t and 200 * len(own & t) >= percent * (len(own) + len(t)) and 2 * sum(x in matched for x in of[s : s + span]) <= len(part):
                windows.append((-len(own & t), len(own), name, s, s + len(part)))
    taken = []
    for w in sorted(windows):
        if not any(w[3] < t[4] and t[3] < w[4] for t in taken):
            taken.append(w)
    return sorted(out + [(of[w[3]], w[2], -w[0]) for w in taken])


def test_licences_match_a_plain_scan(spark):
    rng = random.Random(8)
    every = licenses.TEMPLATES | licenses.PARAGRAPHS
    texts = [None, "", "x"]
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += ["lorem", "ipsum", "the", "license"][: rng.randrange(5)] * rng.randrange(3)
            notice = rng.choice(list(every.values())).split()
            for _ in range(rng.randrange(4)):
                notice[rng.randrange(len(notice))] = rng.choice(["a", "the", "software", "x"])
            words += notice
        texts.append("".join(w + rng.choice(["\n" if rng.random() < 0.2 else " "]) for w in words))
    got = {}
    for r in licenses.scan(docs(spark, list(enumerate(texts)))).collect():
        got.setdefault(r.doc_id, []).append((r.line_no, r.license, r.common))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == plain_licences(t, licenses.TEMPLATES, licenses.PARAGRAPHS), t
    odd = spark.createDataFrame([(1, "Released under the MIT License.", "a", "b"), (1, "Released under the MIT License.", "a", "b")], "doc_id long, text string, line string, norm string")
    assert [(r.doc_id, r.license) for r in licenses.scan(odd).collect()] == [(1, "MIT")] * 2


def test_classifier_and_fit_match_plain_versions(spark):
    """Posteriors by the definition of naive Bayes, and rates by projected gradient without any tricks."""
    import xxhash

    rows = corpus(9, 120) + [(900, None), (901, LONG), (3, "the hand")]
    table = docs(spark, rows)
    truth = {i: (2 if i % 15 == 0 else 1 if i % 5 == 0 else 0) for i in range(100)}
    labels = spark.createDataFrame([(i, int(d == 0), int(d == 2)) for i, d in truth.items()], "doc_id long, quality int, toxic int")
    got = mixing.mix(table, labels, targets={"clean": 0.8, "low": 0.15, "toxic": 0.05}).toPandas()
    held = [(i, sorted({xxhash.xxh32_intdigest(w.lower()) % mixing.BUCKETS for w in (t or "").encode().split()}), len((t or "").split())) for i, t in rows]
    seen, n = np.full((3, mixing.BUCKETS), mixing.SMOOTHING), np.ones(3)
    for i, b, _ in held:
        if i in truth:
            seen[truth[i], b] += 1
            n[truth[i]] += 1
    logp, prior = np.log(seen / seen.sum(1, keepdims=True)), np.log(n / n.sum())
    p = []
    for _, b, _ in held:
        z = prior + (mixing.TEMPER * len(b) ** 0.5 * logp[:, b].mean(1) if b else 0)
        p.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    p, w = np.array(p), np.array([n for *_, n in held], float)
    columns = ["p_clean", "p_low", "p_toxic"]
    order = np.lexsort((w, [i for i, *_ in held]))
    have = got.sort_values(["doc_id", "tokens"])
    assert np.allclose(have[columns].to_numpy(), p[order], atol=1e-5) and (have.tokens.to_numpy() == w[order]).all()
    rate, p, w = have.rate.to_numpy(), p[order], w[order]
    assert np.abs((w * rate) @ p / w.sum() - [0.8, 0.15, 0.05]).max() < 1e-3 and (rate >= 0).all()


def test_packing_of_repeated_and_null_ids(spark):
    from collections import Counter

    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "same text"), (1, "same text"), (1, LONG), (None, "no id"), (None, None), (2, "")]
    table = spark.createDataFrame([(i, t, "a", 5, 6) for i, t in rows], "doc_id long, text string, salt string, length long, rank long")
    got = packing.pack_documents(table, path).collect()
    tok, want = Tokenizer.from_file(path), Counter()
    for i, t in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids) + 1
        want.update((i, s, min(2048, n - s), n) for s in range(0, n, 2048))
    assert Counter((p.doc_id, p.start, p.length, p.doc_tokens) for p in got) == want
    taken = Counter((p.sequence_id, p.offset + k) for p in got for k in range(p.length))
    assert max(taken.values()) == 1 and all(x[1] < 2048 for x in taken)


def test_language_model_with_empty_tables_long_texts_and_repeats(spark):
    good = [(i, "the hand and the other hand " * 4) for i in range(120)]
    rows = [*good, (7, "#!%XQZ" * 30), (7, good[1][1]), (None, "#!%XQZ" * 30), (500, LONG), (501, "the hand and " * 30_000)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120) if i != 7], "doc_id long, quality int, toxic int")
    for how in ({}, {"broadcast": 0}):
        got = quality_lm.classify(docs(spark, rows), labels, **how).collect()
        assert len(got) == len(rows)
        assert sorted((r.doc_id or -1, r.n_words) for r in got if not r.kept) == sorted([(7, 1), (-1, 1), (500, 140_000)])
    none = docs(spark, [])
    assert quality_lm.classify(none, labels).count() == 0 and quality_lm.keep(none, labels).count() == 0
    assert quality_lm.keep(docs(spark, rows), labels.where("doc_id < 0")).count() == len(rows)


def test_licences_with_equal_coefficients(spark):
    """Of templates that fit a line as well, the first by name counts."""
    own = {"b": "one two three four five", "a": "one two three four six"}
    text = "one two three four"
    got = licenses.scan(docs(spark, [(1, text)]), templates=own, paragraphs={}).collect()
    assert [(r.license, r.common) for r in got] == [("a", 3)]
