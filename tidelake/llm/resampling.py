"""Operator 13, target-distribution importance resampling with an integer word dictionary.

Texts are cut into blocks of bounded size, each with its documents' words as numbers of its own list of distinct words. The distinct words of all blocks make a dictionary in
shards; a word's id is its place in its shard times the number of shards, plus the shard. A block asks the shards for the ids of its words, so an n-gram of two words becomes a
tuple of ids. Blocks send their distinct tuples to a grid of cells, (first id, second id) modulo the side of the grid; a cell gets the words of its shards once, and hashes the
reconstructed bytes of each distinct tuple once. Only the buckets return to the blocks, in the order of their tuples, and are joined back to counts by document there. All that
travels is sorted, written as differences in planes of bytes, and compressed.

Features of a text are its words (runs of characters other than U+0000 to U+007F without 0-9, a-z; A-Z lower-cased first) and pairs of consecutive words joined by a space, repeats
counted. A bucket's gain is 1000 times the logarithm of its smoothed share among the target's features over that among all documents' features, rounded down; a document's weight
is the mean gain of its features, rounded down. Gumbel noise from a hash of the id makes drawing the highest scores a draw without replacement in proportion to exp(weight / 1000).

Defined cases: null and empty texts have no features and weight 0. Rows without an id hash as an empty id and come after the others on ties. Rows that repeat an id are documents
each. Ties of score and id are drawn in any order. An empty target, or empty documents, give the smoothed gains or no rows. Other columns are passed by, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.common import Scratch, give_back, map_batches

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 7, 25, 20
#: Bytes of text of a block; block words of a shard of the dictionary, and tuples of a cell, on average.
BLOCK, SHARD, CELL = 16 << 20, 1_000_000, 2_000_000

_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_KEPT).split() if text else []


def pack(values: np.ndarray, sorted_: bool = False) -> bytes:
    """Whole numbers from 0, compressed: their bytes in planes; of ascending ones the differences."""
    v = np.asarray(values).astype("<u8")
    v = np.diff(v, prepend=v.dtype.type(0)) if sorted_ else v
    return zstandard.compress(v.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(raw: bytes, sorted_: bool = False) -> np.ndarray:
    v = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()
    return (np.cumsum(v, dtype=np.uint64) if sorted_ else v).astype(np.int64)


def _joined(some: list[bytes]) -> bytes:
    return zstandard.compress(b" ".join(some), 1)


def _parted(raw: bytes) -> list[bytes]:
    return zstandard.decompress(raw).split()


def _texts(docs: DataFrame, target: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(side, id, text): documents on side 0, the target on side 1."""
    return docs.select(F.lit(0).alias("side"), F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).unionAll(target.select(F.lit(1), F.lit(None).cast("long"), F.col(text).cast("string")))


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _sharded(found: list[bytes], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shards of words, and their order by shard and word."""
    at = np.fromiter((xxhash.xxh32_intdigest(w) for w in found), np.int64, len(found)) % shards
    rank = np.empty(len(found), np.int64)
    rank[sorted(range(len(found)), key=found.__getitem__)] = np.arange(len(found))
    return at, np.lexsort((rank, at))


def _by_shard(found: list[bytes], shards: int) -> Iterator[tuple[int, list[bytes]]]:
    at, order = _sharded(found, shards)
    cuts = np.flatnonzero(np.diff(at[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(at[part[0]]), [found[i] for i in part.tolist()]


def dictionary(texts: DataFrame, shards: int, buckets: int, tmp: Scratch) -> DataFrame:
    """(shard, n, words, hashed): the distinct words of each shard in order, and their buckets."""

    def seen(batches):
        def told(some: set[bytes]):
            rows = list(_by_shard(list(some), shards))
            return pa.RecordBatch.from_pydict({"shard": pa.array([s for s, _ in rows], pa.int32()), "words": pa.array([_joined(w) for _, w in rows], pa.binary())})

        held, size = set(), 0
        for batch in batches:
            for t in batch.column("text").to_pylist():
                held.update(words(t))
                size += len(t or "")
                if size >= BLOCK:
                    yield told(held)
                    held, size = set(), 0
        if held:
            yield told(held)
        give_back()

    def merged(rows: pa.Table) -> pa.Table:
        every: set[bytes] = set()
        for raw in rows.column("words"):
            every.update(_parted(raw.as_py()))
        some = sorted(every)
        hashed = np.fromiter(map(zlib.crc32, some), np.int64, len(some)) % buckets
        return pa.Table.from_pydict({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()), "n": pa.array([len(some)], pa.int64()), "words": [_joined(some)], "hashed": [pack(hashed)]})

    found = texts.select("text").mapInArrow(seen, "shard int, words binary").groupBy("shard").applyInArrow(merged, "shard int, n long, words binary, hashed binary")
    return tmp.cut(found, "dictionary")


def _blocks(texts: DataFrame, shards: int, size: int) -> DataFrame:
    """Blocks of texts of one side: block, side, ids, n (words of each), seq (places in the block's words), and its words by shard."""
    schema = pa.schema([("block", pa.int64()), ("side", pa.int32()), ("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("seq", pa.binary()), ("shards", pa.list_(pa.int32())), ("words", pa.list_(pa.binary()))])

    def run(batches):
        made = TaskContext.get().partitionId() << 32
        held: dict[int, tuple] = {}

        def block(side):
            nonlocal made
            ids, n, seq, local, _ = held.pop(side)
            found = list(local)
            at, order = _sharded(found, shards)
            place = np.empty(len(found), np.int64)
            place[order] = np.arange(len(found))
            parts = np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else []
            row = {"block": made, "side": side, "ids": ids, "n": n, "seq": pack(place[np.frombuffer(seq, np.int32)] if len(seq) else np.empty(0)), "shards": [int(at[p[0]]) for p in parts], "words": [_joined([found[i] for i in p.tolist()]) for p in parts]}
            made += 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for side, i, t in zip(*(batch.column(c).to_pylist() for c in ("side", "id", "text")), strict=True):
                ids, n, seq, local, chars = held.setdefault(side, ([], [], array("i"), Numbers(), [0]))
                w = words(t)
                ids.append(i)
                n.append(len(w))
                seq.extend(map(local.__getitem__, w))
                chars[0] += len(t or "") + 64
                if chars[0] >= size:
                    yield block(side)
        for side in list(held):
            yield block(side)
        give_back()

    return texts.mapInArrow(run, "block long, side int, ids array<long>, n array<int>, seq binary, shards array<int>, words array<binary>")


def _pairs(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: each word's place and document; the distinct pairs of places, and for each pair of words which it is."""
    seq = unpack(row["seq"])
    doc = np.repeat(np.arange(len(row["n"])), row["n"])
    both = np.flatnonzero(doc[1:] == doc[:-1])
    pair, which = np.unique(seq[both] << 32 | seq[both + 1], return_inverse=True)
    return seq, doc, pair, which


def _told(row: dict, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a block's words, and their buckets, from what the shards replied."""
    got = {r["x"]: r for r in replies.filter(pa.compute.equal(replies.column("kind"), 0)).to_pylist()}
    ids = [unpack(got[s]["data"], True) for s in row["shards"]]
    hashed = [unpack(got[s]["more"]) for s in row["shards"] if got[s]["more"] is not None]
    return (np.concatenate(x) if x else np.empty(0, np.int64) for x in (ids, hashed))


REPLY = "block long, kind int, x int, y int, data binary, more binary"


def _reply(block, kind, x, y, data, more) -> pa.Table:
    return pa.Table.from_pydict({"block": pa.array(block, pa.int64()), "kind": pa.array([kind] * len(block), pa.int32()), "x": pa.array(x, pa.int32()), "y": pa.array(y, pa.int32()), "data": pa.array(data, pa.binary()), "more": pa.array(more, pa.binary())})


def _ids(blocks: DataFrame, known: DataFrame, shards: int, hashed: bool) -> DataFrame:
    """What each shard replies to each block: the ids of its words, and their buckets if asked for."""

    def ask(rows: pa.Table) -> pa.Table:
        (row,) = rows.to_pylist()
        return pa.Table.from_pydict({"shard": pa.array(row["shards"], pa.int32()), "block": pa.array([row["block"]] * len(row["shards"]), pa.int64()), "words": pa.array(row["words"], pa.binary())})

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        out: dict[str, list] = {"block": [], "x": [], "data": [], "more": []}
        if asked.num_rows:
            (one,) = own.to_pylist()
            place = {w: i for i, w in enumerate(_parted(one["words"]))}
            bucket = unpack(one["hashed"])
            for block, raw in zip(asked.column("block").to_pylist(), asked.column("words").to_pylist(), strict=True):
                at = np.fromiter(map(place.__getitem__, _parted(raw)), np.int64)
                out["block"].append(block)
                out["x"].append(one["shard"])
                out["data"].append(pack(at * shards + one["shard"], True))
                out["more"].append(pack(bucket[at]) if hashed else None)
        return _reply(out["block"], 0, out["x"], [0] * len(out["x"]), out["data"], out["more"])

    asked = blocks.groupBy("block").applyInArrow(ask, "shard int, block long, words binary")
    return asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(answer, REPLY)


def _cells(pair: np.ndarray, ids: np.ndarray, side: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a block's distinct pairs: the order by cell and tuple, and the cells and tuples in that order. A tuple in a cell is the two ids over side, as one number."""
    first, second = ids[pair >> 32], ids[pair & 0xFFFFFFFF]
    cell, key = first % side * side + second % side, first // side * most + second // side
    order = np.lexsort((key, cell))
    return order, cell[order], key[order]


def coded(texts: DataFrame, known: DataFrame, shards: int, side: int, buckets: int, size: int, tmp: Scratch) -> DataFrame:
    """(side, ids, n, features): for each block its documents, their numbers of words, and document * buckets + bucket of all features in order."""
    blocks = _blocks(texts, shards, size)
    longest = known.agg(F.max("n")).first()[0] or 0
    most = -(-longest * shards // side) + 1

    def ask(mine: pa.Table, replies: pa.Table) -> pa.Table:
        (row,) = mine.to_pylist()
        ids, _ = _told(row, replies)
        _, _, pair, _ = _pairs(row)
        _, cell, key = _cells(pair, ids, side, most)
        cuts = np.flatnonzero(np.diff(cell, prepend=-1)) if len(cell) else np.empty(0, np.int64)
        ends = [*cuts[1:].tolist(), len(cell)]
        n = len(cuts)
        return pa.Table.from_pydict({"x": pa.array(cell[cuts] // side, pa.int32()), "y": pa.array(cell[cuts] % side, pa.int32()), "block": pa.array([row["block"]] * n, pa.int64()), "data": pa.array([pack(key[s:e], True) for s, e in zip(cuts.tolist(), ends, strict=False)][:n], pa.binary())})

    def hash_(asked: pa.Table, own: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _reply([], 1, [], [], [], [])
        x, y = asked.column("x")[0].as_py(), asked.column("y")[0].as_py()
        keys = [unpack(raw, True) for raw in asked.column("data").to_pylist()]
        every = np.unique(np.concatenate(keys))
        lists: dict[tuple[bool, int], list[bytes]] = {(r["second"], r["shard"]): _parted(r["words"]) for r in own.to_pylist()}

        def spelt(quotient: np.ndarray, second: bool) -> tuple[list[bytes], np.ndarray]:
            distinct, which = np.unique(quotient, return_inverse=True)
            ids = distinct * side + (y if second else x)
            return [lists[second, s][i] for s, i in zip((ids % shards).tolist(), (ids // shards).tolist(), strict=True)], which

        first, i = spelt(every // most, False)
        second, j = spelt(every % most, True)
        first, crc = [w + b" " for w in first], zlib.crc32
        bucket = np.empty(len(every), np.int64)
        for s in range(0, len(every), 1 << 18):
            a, b = i[s : s + (1 << 18)].tolist(), j[s : s + (1 << 18)].tolist()
            bucket[s : s + len(a)] = np.fromiter((crc(first[p] + second[q]) for p, q in zip(a, b, strict=True)), np.int64, len(a)) % buckets
        n = len(keys)
        return _reply(asked.column("block").to_pylist(), 1, [x] * n, [y] * n, [pack(bucket[np.searchsorted(every, k)]) for k in keys], [None] * n)

    def code(mine: pa.Table, replies: pa.Table) -> pa.Table:
        (row,) = mine.to_pylist()
        ids, hashed = _told(row, replies)
        seq, doc, pair, which = _pairs(row)
        order, cell, _ = _cells(pair, ids, side, most)
        got = {(r["x"], r["y"]): r["data"] for r in replies.filter(pa.compute.equal(replies.column("kind"), 1)).to_pylist()}
        there = [unpack(got[divmod(c, side)]) for c in np.unique(cell).tolist()]
        bucket = np.empty(len(pair), np.int64)
        bucket[order] = np.concatenate(there) if there else 0
        both = np.flatnonzero(doc[1:] == doc[:-1])
        keys = np.sort(np.concatenate((doc * buckets + hashed[seq], doc[both] * buckets + bucket[which])))
        return pa.Table.from_pydict({"side": pa.array([row["side"]], pa.int32()), "ids": pa.array([row["ids"]], pa.list_(pa.int64())), "n": pa.array([row["n"]], pa.list_(pa.int32())), "features": pa.array([pack(keys, True)], pa.binary())})

    plain = _ids(blocks, known, shards, False)
    tuples = blocks.groupBy("block").cogroup(plain.groupBy("block")).applyInArrow(ask, "x int, y int, block long, data binary")
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    own = F.pmod("shard", F.lit(side)).cast("int")
    spread = known.select(own.alias("x"), every.alias("y"), F.lit(False).alias("second"), "shard", "words").unionAll(known.select(every, own, F.lit(True), "shard", "words").toDF("x", "y", "second", "shard", "words"))
    hashed = tuples.groupBy("x", "y").cogroup(spread.groupBy("x", "y")).applyInArrow(hash_, REPLY)
    replies = _ids(blocks, known, shards, True).unionAll(hashed)
    done = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(code, "side int, ids array<long>, n array<int>, features binary")
    return tmp.cut(done, "coded")


def bucket_counts(done: DataFrame, buckets: int) -> np.ndarray:
    """How many features of each side are in each bucket."""

    def run(batches):
        sums = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for side, raw in zip(batch.column("side").to_pylist(), batch.column("features").to_pylist(), strict=True):
                sums[side] += np.bincount(unpack(raw, True) % buckets, minlength=buckets)
        s, b = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({"side": pa.array(s, pa.int32()), "bucket": pa.array(b, pa.int32()), "c": pa.array(sums[s, b])})

    out = np.zeros((2, buckets), np.int64)
    for side, bucket, c in done.select("side", "features").mapInArrow(run, "side int, bucket int, c long").groupBy("side", "bucket").agg(F.sum("c")).collect():
        out[side, bucket] = c
    return out


def gains(counts: np.ndarray) -> np.ndarray:
    """What a feature of each bucket is worth, in thousandths."""
    (s, t), size = counts.tolist(), counts.shape[1]
    all_s, all_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log(((y + 1) * (all_s + size)) / ((x + 1) * (all_t + size)))) for x, y in zip(s, t, strict=True)], np.int64)


def weigh(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, block: int = BLOCK, shard: int = SHARD, cell: int = CELL) -> DataFrame:
    """doc_id, n_words, n_features, weight for each row of docs."""
    tmp = Scratch(docs.sparkSession, "resampling")
    texts = _texts(docs, target, doc_id, text)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    side = max(1, math.ceil(math.sqrt(size / 6 / cell)))
    shards = side * max(1, math.ceil(size / 24 / shard / side))  # a word in four is new to its block
    known = dictionary(texts, shards, buckets, tmp)
    done = coded(texts, known, shards, side, buckets, block, tmp)
    gain = gains(bucket_counts(done, buckets))

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_features": [], "weight": []}
        for ids, n, raw in zip(*(batch.column(c).to_pylist() for c in ("ids", "n", "features")), strict=True):
            doc, bucket = np.divmod(unpack(raw, True), buckets)
            sums = np.zeros(len(ids), np.int64)
            np.add.at(sums, doc, gain[bucket])
            n = np.array(n, np.int64)
            features = n + np.maximum(n - 1, 0)
            out["doc_id"] += ids
            out["n_words"] += n.tolist()
            out["n_features"] += features.tolist()
            out["weight"] += (sums // np.maximum(features, 1)).tolist()
        return out

    weighed = map_batches(done.where("side = 0").select("ids", "n", "features"), run, "doc_id long, n_words long, n_features long, weight long")
    weighed = tmp.cut(weighed, "weighed")
    tmp.drop("dictionary", "coded")
    return weighed


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, **how) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: of the documents with enough words, so many percent with the highest scores have a rank, from 1; ties to the smaller id."""
    weighed = weigh(docs, target, doc_id, text, **how)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("fit", F.col("n_words") >= least_words)
    # scores are whole numbers between bounds: logarithms of shares are below 1000 * 53 * ln 2, the noise is between -3200 and 23000
    sizes = scored.where("fit").groupBy("score").count().toArrow()
    score, n = sizes.column("score").to_numpy(), sizes.column("count").to_numpy()
    order = np.argsort(-score)
    start, drawn = np.cumsum(n[order]) - n[order], percent * int(n.sum()) // 100
    starts = docs.sparkSession.createDataFrame(pa.table({"score": score[order].astype(np.int64), "before": start.astype(np.int64)}).slice(0, int((start < drawn).sum())))
    near = scored.join(F.broadcast(starts), "score", "left")
    place = F.when(F.col("fit") & F.col("before").isNotNull(), F.col("before") + F.row_number().over(Window.partitionBy("score", "fit").orderBy(F.asc_nulls_last("doc_id"))))
    return near.withColumn("place", place).select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).cast("long").alias("rank"))


#: The same in DuckDB, for small tables. The table of the checksum is made by its rule (reversed polynomial 0xEDB88320).
SQL = r"""
WITH RECURSIVE tab(i, k, v) AS (SELECT range, 0, range::BIGINT FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM tab WHERE k < 8),
t AS (SELECT list(v ORDER BY i) AS tab FROM tab WHERE k = 8),
w AS (SELECT side, key, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
      FROM (SELECT 0 AS side, row_number() OVER () AS key, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark)),
f AS (SELECT side, key, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
c AS (SELECT side, key, f, count(*) AS c FROM f GROUP BY ALL),
d AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM c)),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda a, y: xor(a // 256, tab[xor(a % 256, y) + 1])), 4294967295) % 10000 AS bucket FROM d, t),
n AS (SELECT bucket, coalesce(sum(c) FILTER (side = 0), 0) AS s, coalesce(sum(c) FILTER (side = 1), 0) AS t FROM c JOIN b USING (f) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM n)::DOUBLE + 10000)) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n)::DOUBLE + 10000)))) AS gain FROM n),
m AS (SELECT key, sum(c * gain) AS gain FROM c JOIN b USING (f) JOIN g USING (bucket) WHERE side = 0 GROUP BY 1),
r AS (SELECT w.key, id AS doc_id, len(w)::BIGINT AS n_words, (len(w) + greatest(len(w) - 1, 0))::BIGINT AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE floor(gain / (2 * len(w) - 1)) END::BIGINT AS weight,
      ('0x' || substr(sha256('7:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM w LEFT JOIN m USING (key) WHERE side = 0),
p AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM r),
q AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM p)
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM p WHERE n_words >= 20) * 25 // 100 THEN place END::BIGINT AS rank FROM q
"""
