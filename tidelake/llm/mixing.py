"""Operator 2, mixing sources to target weights by soft membership.

A classifier learned from the labelled table (naive Bayes over hashed distinct words, its evidence tempered to the square root of a text's length, as words aren't
independent) gives every document posteriors of the domains. Each document gets a rate, how often it is to be seen; the rates are the
nonnegative least-squares fit of the expected domain totals, sum over documents of rate * tokens * posterior, to the targets, found from rates of 1 by
projected gradient steps. The gradient of a rate is its posteriors times the totals' residual, so what all steps so far did to a rate is its posteriors
times one vector; nothing is stored between steps, and a step is one pass over (tokens, posteriors) that returns a vector from each task. Steps are taken in
the metric of the curvature and projected from their sum, which ends in few passes; of all fits the one nearest to rates of 1 is found.

A step is thus a Newton step, damped by trying several lengths, on the dual of the projected least squares; projected gradient steps on the rates end in the same point.

A row is a document: its rate follows from its text, and how often it is seen is drawn by its id and its place in its part of the table, so rows that share an id, or have none,
are drawn each. The mixed table is made in one pass over the documents, without a join.

Defined cases: null and empty texts have no tokens and the priors as posteriors; their rate counts for nothing in the fit. Documents without a label,
or an id, are scored like all others. Of repeated labels the worst counts. Without labels every domain is as likely as any other. Repeated rows get a rate
each. An empty table gives an empty result. Other columns are passed by, whatever their names.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import IdFilter, Scratch, give_back, map_batches, trusted_labels, words

DOMAINS = ("clean", "low", "toxic")
#: Production targets: shares of the tokens that come out, and their number as a multiple of those that go in.
TARGETS, BUDGET = {"clean": 0.95, "low": 0.03, "toxic": 0.02}, 1.0
BUCKETS, TEMPER, SMOOTHING = 1 << 15, 6.0, 0.1
STEPS, CLOSE = 60, 1e-4
#: Weight of the rates' squared distance from 1; it decides where targets can't be met, or can be met in many ways.
SLACK = 1e-6
#: Rows of a task in a step.
ROWS = 2_000_000


class Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh32_intdigest(word) % BUCKETS
        return value


class Features:
    """In a task: for each text of its batches, in order, the number of words, the distinct buckets of the lower-cased words, and a draw from 0 to 1 by the row's id and place."""

    def __init__(self):
        self.buckets, self.seen = Buckets(), 0

    def __call__(self, ids: list[int | None], texts: list[str | None]) -> tuple[list[int], list[bytes], list[float]]:
        tokens, held, part = [], [], TaskContext.get().partitionId()
        for t in texts:
            w = words(t)
            tokens.append(len(w))
            held.append(np.fromiter(set(map(self.buckets.__getitem__, {x.lower() for x in w})), "<u2").tobytes())
        draws = [xxhash.xxh64_intdigest(f"{i} {part} {k}", 11) / 2**64 for k, i in enumerate(ids, self.seen)]
        self.seen += len(texts)
        return tokens, held, draws


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens, held, u): the number of words, the distinct buckets of the lower-cased words, and the draw."""
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64()), ("held", pa.binary()), ("u", pa.float64())])

    def run(batches):
        of = Features()
        for batch in batches:
            tokens, held, u = of(batch.column("id").to_pylist(), batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(tokens, pa.int64()), pa.array(held, pa.binary()), pa.array(u)], schema=schema)
        give_back()

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, tokens long, held binary, u double")


def train(held: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Log priors and log probabilities of the buckets, by domain, from all labelled documents. The counts that reach the driver are at most domains * (buckets + 1)."""
    truth = trusted_labels(labels).select("doc_id", F.when(F.col("toxic") > 0, 2).when(F.col("quality") <= 0, 1).otherwise(0).alias("domain"))

    def count(batches):
        sums = np.zeros((len(DOMAINS), BUCKETS + 1), np.int64)
        for batch in batches:
            for domain, raw in zip(batch.column("domain").to_pylist(), batch.column("held").to_pylist(), strict=True):
                sums[domain, np.frombuffer(raw, "<u2")] += 1  # distinct, so each index comes once
                sums[domain, BUCKETS] += 1
        d, b = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({"domain": pa.array(d, pa.int32()), "bucket": pa.array(b, pa.int32()), "n": pa.array(sums[d, b])})

    near = IdFilter(truth, "doc_id")  # features without a label aren't shuffled
    some = map_batches(held.select("doc_id", "held", near.at("doc_id").alias("at")), lambda batch: near.pick(batch).select(["doc_id", "held"]).to_pydict(), "doc_id long, held binary")
    both = some.join(truth.hint("merge"), "doc_id").select("domain", "held")
    sums = np.zeros((len(DOMAINS), BUCKETS + 1))
    for r in both.mapInArrow(count, "domain int, bucket int, n long").groupBy("domain", "bucket").agg(F.sum("n")).collect():
        sums[r[0], r[1]] = r[2]
    seen = sums[:, :BUCKETS] + SMOOTHING
    return np.log((sums[:, BUCKETS] + 1) / (sums[:, BUCKETS] + 1).sum()), np.log(seen / seen.sum(1, keepdims=True))


def posterior(held: list[bytes], prior: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Probabilities of the domains, a row for each text."""
    out = np.empty((len(held), len(prior)))
    for i, raw in enumerate(held):
        at = np.frombuffer(raw, "<u2")
        z = prior + (TEMPER * len(at) ** 0.5 * model[:, at].mean(1) if len(at) else 0)
        e = np.exp(z - z.max())
        out[i] = e / e.sum()
    return out


def posteriors(held: DataFrame, prior: np.ndarray, model: np.ndarray) -> DataFrame:
    """(doc_id, tokens, u, p: probabilities of the domains)."""
    shared = held.sparkSession.sparkContext.broadcast(model.astype(np.float32))  # fixed size

    def run(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(c) for c in ("doc_id", "tokens", "u")} | {"p": list(posterior(batch.column("held").to_pylist(), prior, shared.value))}

    return map_batches(held, run, "doc_id long, tokens long, u double, p array<double>")


def rates(p: np.ndarray, push: np.ndarray) -> np.ndarray:
    """The rates that the steps so far lead to: from 1 against their sum, cut off at 0. push: one vector of domains, or several as rows (then a column of rates for each)."""
    return np.maximum(0.0, 1.0 - p @ push.T)


def fit(docs: DataFrame, targets: np.ndarray, steps: int = STEPS, close: float = CLOSE) -> np.ndarray:
    """The sum of steps (a vector of domains) that leads to the rates of (tokens, p); targets: totals of tokens by domain. A step is the gradient of the squared distance between totals and targets in the metric of its curvature
    over the documents whose rate isn't 0; several lengths of it are tried in one pass, by the convex function whose gradient it is. Ends when no total is further from its target than close of their sum, or nothing gets better."""
    scale, size, lengths = max(1.0, float(targets.sum())), len(targets), np.array([1.0, 0.5, 0.25, 0.0625, 2**-8, 2**-16])

    def tried(push: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of push: the value of the function, the totals, the curvature."""

        def run(batches):
            value, s, h = np.zeros(len(push)), np.zeros((len(push), size)), np.zeros((len(push), size, size))
            for batch in batches:
                w = batch.column("tokens").to_numpy(zero_copy_only=False).astype(float)
                if len(w):
                    p = batch.column("p").values.to_numpy().reshape(len(w), -1)
                    r = rates(p, push)
                    value += w @ (r * r) / 2
                    s += (w[:, None] * r).T @ p
                    h += np.stack([(p * (w * (r[:, k] > 0))[:, None]).T @ p for k in range(len(push))])
            yield pa.RecordBatch.from_pydict({"x": pa.array([np.concatenate((value, s.ravel(), h.ravel())).tolist()])})

        n = len(push) * (1 + size + size * size)
        got = docs.select("tokens", "p").mapInArrow(run, "x array<double>").agg(*(F.sum(F.get("x", F.lit(i))) for i in range(n))).first()
        x = np.array([v or 0.0 for v in got])
        value, s, h = np.split(x, [len(push), len(push) * (1 + size)])
        s = s.reshape(len(push), size)
        return SLACK * (push**2).sum(1) / 2 + (value + push @ targets) / scale, s, h.reshape(len(push), size, size)

    push = np.zeros((1, size))
    (value,), (s,), (h,) = tried(push)
    for _ in range(steps):
        slope = SLACK * push[0] - (s - targets) / scale
        if not s.any() or np.abs(s - targets).max() < close * scale or np.abs(slope).max() < close / 1000:
            break
        ahead = push - lengths[:, None] * np.linalg.solve(SLACK * np.eye(size) + h / scale, slope)[None, :]
        values, totals, curves = tried(ahead)
        k = int(values.argmin())
        if not values[k] < value:
            break
        push, value, s, h = ahead[k : k + 1], values[k], totals[k], curves[k]
    else:
        warnings.warn(f"the rates still move after {steps} steps; totals are off by up to {np.abs(s - targets).max() / scale:.2g} of all tokens", stacklevel=2)
    return push[0]


def _fitted(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, targets: dict[str, float], budget: float) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, tokens, u, p) of docs, and what gives each row its rate: priors, model, and the sum of steps."""
    tmp = Scratch(docs.sparkSession, "mixing")
    held = tmp.cut(features(docs, doc_id, text), "features")
    prior, model = train(held, labels)
    n = held.count()
    post = tmp.cut(posteriors(held, prior, model).repartition(max(6, -(-n // ROWS))), "posteriors")
    tmp.drop("features")
    total = post.agg(F.sum("tokens")).first()[0] or 0
    return post, prior, model, fit(post, np.array([targets[d] for d in DOMAINS]) * budget * total)


def mix(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", targets: dict[str, float] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """doc_id, tokens, p_<domain>, rate, copies (rate, rounded up or down by the row's draw so that its expectation is the rate)."""
    post, _, _, push = _fitted(docs, labels, doc_id, text, targets, budget)

    def run(batch: pa.RecordBatch) -> dict:
        p = batch.column("p").values.to_numpy().reshape(batch.num_rows, -1)
        rate = rates(p, push)
        return {"doc_id": batch.column("doc_id"), "tokens": batch.column("tokens"), "rate": rate, "copies": np.floor(rate + batch.column("u").to_numpy()).astype(np.int64)} | {f"p_{d}": p[:, i] for i, d in enumerate(DOMAINS)}

    return map_batches(post, run, "doc_id long, tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS) + ", rate double, copies long")


def apply_mix(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", targets: dict[str, float] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """docs with each row as often as its own rate says, none for 0."""
    _, prior, model, push = _fitted(docs, labels, doc_id, text, targets, budget)
    shared, schema = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32)), docs.schema

    def run(batches):
        of = Features()
        for batch in batches:
            if batch.num_rows:
                _, held, u = of(batch.column(doc_id).to_pylist(), batch.column(text).to_pylist())
                copies = np.floor(rates(posterior(held, prior, shared.value), push) + u).astype(np.int64)
                rows = np.repeat(np.arange(batch.num_rows), copies)
                for s in range(0, len(rows), batch.num_rows):  # no output batch has more rows than its input
                    yield batch.take(pa.array(rows[s : s + batch.num_rows]))
        give_back()

    return docs.mapInArrow(run, schema)
