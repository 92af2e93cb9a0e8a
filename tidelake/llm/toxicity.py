"""Operator 12, toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words (runs of letters, digits and underscores) and the first STEMS characters of longer words, which inflected and compound forms share. They
are hashed to a fixed number of buckets. A text's logit is a bias, the sum of its terms' weights, and the sum over all pairs of terms of the inner products of their factors, in linear
time by ((sum of factors)^2 - sum of squared factors) / 2. So an insult beside a group's name may count where neither does alone.

Weights are learned by follow-the-regularised-leader steps with an L1 bound, which keeps words that tell nothing at 0. The first rounds learn weights alone; then factors begin, by adaptive
steps, each followed by a group shrinkage that sets a term's factors to 0 unless its pairs keep pulling the same way. So pairs take what weights alone leave unexplained, and thousands of
neutral words of a long text add nothing. The training rows are those of at most about SAMPLE labelled ids; they are dealt into shards. In a round each task trains the model on its
shard, and the mean of the shards' models, taken bucket range by bucket range, starts the next round.

Defined cases: null and empty texts have no terms and score the bias. Of repeated labels of an id the worst counts; null labels are left out. Rows without an id have no label and aren't
held out. Without labels every text scores the prior, below one half. Repeated rows are scored each. An empty table gives an empty result. Other columns are passed by.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import Scratch, map_batches
from tidelake.llm.resampling import pack, unpack

#: Buckets of terms, a power of two; factors of a term; lengths of the beginnings of words.
BUCKETS, FACTORS, STEMS = 1 << 18, 4, (4, 5)
#: Labelled ids that train, on average at most; rows and terms of a shard; rounds without and with factors, and passes of a task in a round; rows of a step.
SAMPLE, SHARD, SHARD_TERMS, ROUNDS, PASSES, STEP = 200_000, 16_384, 16 << 20, (2, 2), 2, 64
#: FTRL's rate, smoothing and bounds for weights; rate, shrinkage and size at the start of factors, and the training texts that must hold a term that pairs.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 6.0, 1.0
RATE, SHRINK, START, LEAST_SEEN = 0.2, 0.3, 0.03, 10
FOLDS = 5
#: Buckets of a range in which models are averaged.
RANGE = 1 << 14
WORD = re.compile(r"\w+")


class Terms(dict):
    """The buckets of a word."""

    def __missing__(self, word: str) -> list[int]:
        if len(self) > 200_000:
            self.clear()
        found = [xxhash.xxh32_intdigest(word) % BUCKETS, *(xxhash.xxh32_intdigest(word[:n] + "*") % BUCKETS for n in STEMS if len(word) > n)]
        if len(word) < 64:
            self[word] = found
        return found


def terms(text: str | None, known: Terms) -> np.ndarray:
    """The distinct buckets of a text, in order."""
    some = {b for w in set(WORD.findall(text.lower())) for b in known[w]} if text else ()
    return np.sort(np.fromiter(some, np.int32, len(some)))


class Model:
    """Weights by FTRL (z, n: sums of gradients, and of their squares), factors v and the sums of their squared gradients, in how many texts of a pass each term was, and the bias with its own sum."""

    def __init__(self, bias: float = 0.0, buckets: int = BUCKETS, factors: int = FACTORS):
        self.bias, self.bias_n = bias, 0.0
        self.z, self.n, self.v_n, self.seen = (np.zeros(buckets, np.float32) for _ in range(4))
        self.v = np.zeros((buckets, factors), np.float32)

    def begin(self, pairs: np.ndarray) -> None:
        """Small factors for the terms that may pair."""
        start = np.random.default_rng(12).standard_normal(self.v.shape) * START
        self.v[pairs] = start[pairs]

    @property
    def w(self) -> np.ndarray:
        return weights(self.z, self.n)

    def parts(self) -> list[np.ndarray]:
        """Its numbers by ranges of buckets; first the bias and its sum."""
        every = np.hstack((np.stack((self.z, self.n, self.v_n, self.seen), 1), self.v))
        return [np.array([self.bias, self.bias_n], np.float32), *(every[s : s + RANGE] for s in range(0, len(every), RANGE))]

    @classmethod
    def of(cls, parts: dict[int, bytes], buckets: int = BUCKETS, factors: int = FACTORS) -> Model:
        one = cls(*np.frombuffer(parts[0], np.float32)[:1].tolist(), buckets, factors)
        one.bias_n = float(np.frombuffer(parts[0], np.float32)[1])
        every = np.concatenate([np.frombuffer(parts[i], np.float32).reshape(-1, 4 + factors) for i in range(1, len(parts))])
        one.z, one.n, one.v_n, one.seen = (every[:, i].copy() for i in range(4))
        one.v = every[:, 4:].copy()
        return one


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)).astype(np.float32)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the runs of values that end at ends, empty runs included."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, 0, dtype=np.float64)))
    return total[ends] - total[np.concatenate(([0], ends[:-1]))]


def logits(at: np.ndarray, ends: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The logits of texts whose terms are the runs of at that end at ends."""
    x = v[at]
    s = _sums(x, ends)
    return bias + _sums(w[at], ends) + ((s * s).sum(1) - _sums((x * x).sum(1), ends)) / 2


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(model: Model, rows: list[np.ndarray], truth: np.ndarray, passes: int = PASSES, seed: int = 0) -> None:
    """Steps over all rows, passes times in an order of the seed."""
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), STEP):
            batch = order[s : s + STEP]
            own = [rows[i] for i in batch]
            ends = np.cumsum([len(x) for x in own])
            at = np.concatenate(own) if own else np.empty(0, np.int32)
            some, which = np.unique(at, return_inverse=True)
            z, n, v = model.z[some], model.n[some], model.v[some]
            w = weights(z, n)
            live = np.flatnonzero(v.any(1))  # terms whose factors are not 0
            pairs = np.zeros(len(some), bool)
            pairs[live] = True
            inside = pairs[which]
            doc = np.repeat(np.arange(len(own)), [len(x) for x in own])
            x, of = v[which[inside]], doc[inside]
            total = np.stack([np.bincount(of, x[:, f], len(own)) for f in range(v.shape[1])], 1)
            y = model.bias + np.bincount(doc, w[which], len(own)) + ((total * total).sum(1) - np.bincount(of, (x * x).sum(1), len(own))) / 2
            error = probability(y) - truth[batch]
            model.bias_n += float(error.sum()) ** 2
            model.bias -= ALPHA * float(error.sum()) / (BETA + model.bias_n**0.5)
            g = np.bincount(which, error[doc], len(some))
            step = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
            model.z[some], model.n[some] = z + g - step * w, n + g * g
            if len(live):
                slope = np.stack([np.bincount(which[inside], error[of] * (total[of, f] - x[:, f]), len(some)) for f in range(v.shape[1])], 1)[live]
                there = some[live]
                model.v_n[there] += (slope * slope).sum(1)
                rate = RATE / np.sqrt(1 + model.v_n[there])[:, None]
                new = v[live] - rate * slope
                size = np.sqrt((new * new).sum(1))[:, None]
                model.v[there] = new * np.maximum(0, 1 - rate * SHRINK / np.maximum(size, 1e-12))


def held_out(doc_id: str | Column, folds: int = FOLDS) -> Column:
    """Whether a row's label is kept from training: crc32 of the id as text leaves no remainder. An id that is null has none."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, shard: int = SHARD, rounds: tuple[int, int] = ROUNDS) -> Model:
    """The model of the labelled rows of docs that aren't held out. What reaches the driver is a model, of fixed size."""
    spark = docs.sparkSession
    tmp = Scratch(spark, "toxicity")
    truth = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").where(~held_out("id")).groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    truth = tmp.cut(truth, "truth")
    share = min(1.0, sample / max(1, truth.count()))
    some = truth.where(F.pmod(F.xxhash64("id", F.lit(12)), F.lit(1_000_000)) < F.lit(share * 1_000_000))
    known = Terms()

    def spelt(batch: pa.RecordBatch) -> dict:
        found = [terms(t, known) for t in batch.column("text").to_pylist()]
        return {"h": batch.column("h"), "y": batch.column("y"), "n": list(map(len, found)), "terms": [pack(x, True) for x in found]}

    chosen = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(some), "id")  # about sample ids at most
    rows = tmp.cut(map_batches(chosen.select(F.xxhash64("id").alias("h"), "y", "text"), spelt, "h long, y int, n int, terms binary"), "rows")
    n, positive, size = rows.agg(F.count("*"), F.sum("y"), F.sum("n")).first()
    positive = positive or 0
    shards = max(1, -(-n // shard), -(-(size or 0) // SHARD_TERMS))
    model = Model(math.log((positive + 0.5) / (n - positive + 1.5)))

    def gathered(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), ("terms", "ascending")])
        return pa.Table.from_pydict({"y": pa.array([t.column("y").to_pylist()], pa.list_(pa.int32())), "terms": pa.array([t.column("terms").to_pylist()], pa.list_(pa.binary()))})

    # a shard is one row from here on, so that rounds don't shuffle
    dealt = rows.select("h", "y", "terms").groupBy(F.pmod("h", F.lit(shards)).alias("shard")).applyInArrow(gathered, "y array<int>, terms array<binary>")
    dealt = tmp.cut(dealt, "shards")

    def mean(t: pa.Table) -> pa.Table:
        return pa.Table.from_pydict({"part": t.column("part")[:1], "data": [np.mean([np.frombuffer(x, np.float32) for x in t.column("data").to_pylist()], 0, np.float32).tobytes()]})

    def trained(k: int, shared):
        def one(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"part": [], "data": []}
            for y, packed in zip(batch.column("y").to_pylist(), batch.column("terms").to_pylist(), strict=True):
                own = Model.of({i: x.tobytes() for i, x in enumerate(shared.value.parts())})
                found = [unpack(x, True).astype(np.int32) for x in packed]
                own.seen = np.bincount(np.concatenate(found), minlength=len(own.z)).astype(np.float32)
                fit(own, found, np.array(y, float), seed=k)
                for i, x in enumerate(own.parts()):
                    out["part"].append(i)
                    out["data"].append(np.ascontiguousarray(x, np.float32).tobytes())
            return out

        return one

    for k in range(sum(rounds) if positive else 0):
        if k == rounds[0]:
            model.begin(model.seen * shards >= LEAST_SEEN)
        shared = spark.sparkContext.broadcast(model)
        told = map_batches(dealt, trained(k, shared), "part int, data binary").groupBy("part").applyInArrow(mean, "part int, data binary")
        model = Model.of({r["part"]: r["data"] for r in told.toArrow().to_pylist()})
        shared.destroy()
    tmp.drop("rows", "truth", "shards")
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on) for each row of docs."""
    known = Terms()
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v))  # fixed size

    def run(batch: pa.RecordBatch) -> dict:
        found = [terms(t, known) for t in batch.column("text").to_pylist()]
        p = probability(logits(np.concatenate(found), np.cumsum([len(x) for x in found]), *shared.value))
        return {"doc_id": batch.column("id"), "held_out": batch.column("held"), "score": p, "predicted": (p >= 0.5).astype(np.int32)}

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("id"), held_out(doc_id).alias("held"), F.col(text).alias("text")), run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Scores of all rows of docs by a model of its labelled rows."""
    return score(docs, train(docs, labels, doc_id, text, **how), doc_id, text)
