"""Operator 6, quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model predicts each byte of a text and the space that ends it from up to ORDER - 1 bytes before it, which reach over the words before to the space before the text. Runs of
white space are one space.
Trusted documents (labelled good and not toxic) train it, all but a tenth of them, held out, whose perplexities give each language its threshold: a high quantile, with a
margin. Documents above their language's threshold are rejected.

N-grams of all training text are counted within tasks and then by key, so the tables of counts, contexts and probabilities are sharded by n-gram and grow with the
corpus; each order's probabilities come from joins with its contexts' sums and with the next lower order. A finished model of up to BROADCAST rows goes
to the tasks as arrays. A larger one stays sharded: the n-grams that a block of documents needs are joined with the shards and only the answers return to the block.
Both give the same perplexities.

Defined cases: null and empty texts have a null perplexity and are kept (length is another rule's matter). Documents without a language share one. A language with
fewer than LEAST_HELD held-out documents uses the threshold of all. Without trusted documents nothing is rejected. Of repeated labels the worst counts.
Repeated rows are judged each. An empty table gives an empty result. Other columns are passed by.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import IdFilter, Scratch, give_back, map_batches, trusted_labels, words

#: Bytes of the longest n-grams; of those of 7, the most that fit into a key, there are three times as many.
ORDER = 6
QUANTILE, MARGIN, LEAST_HELD, HELD = 0.99, 1.25, 20, 10
#: Rows of a model that are sent to every executor, about 12 bytes each.
BROADCAST = 8_000_000
#: Bytes of text whose n-grams are looked at together.
CHUNK = 1 << 18
#: Documents, and characters, of a block that asks a sharded model, on average.
BLOCK_DOCS, BLOCK_CHARS = 8000, 16 << 20
TAG = 56


def expand(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every predicted byte of the texts: the n-gram that ends with it (at most order bytes, no further back than the space before the text) as a number, its length, and the text's index."""
    flat = np.frombuffer(b" " + b" ".join(texts) + b" " if texts else b" ", np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.repeat(np.arange(len(texts)), lengths + 1)
    before = np.arange(1, len(flat)) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1)  # bytes back to the text's space
    padded = np.concatenate((np.zeros(order - 1, np.int64), flat))
    gram = np.zeros(len(flat) - 1, np.int64)
    for j in range(order - 1, -1, -1):
        gram = np.where(before >= j, gram << 8 | padded[order - j : order - j + len(gram)], gram)
    return gram, np.minimum(before + 1, order), text


def chunks(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """The texts in lists of about CHUNK bytes."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def _counted(texts: list[bytes], order: int) -> pa.RecordBatch:
    gram, length, _ = expand(texts, order)
    key, n = np.unique(gram | length << TAG, return_counts=True)
    return pa.RecordBatch.from_pydict({"k": pa.array((key >> TAG).astype(np.int32)), "gram": pa.array(key & ((1 << TAG) - 1)), "n": pa.array(n.astype(np.int64))})


def count_ngrams(packed: DataFrame, order: int = ORDER) -> DataFrame:
    """(k, gram, n): the n-grams of compressed texts (column z)."""

    def run(batches):
        inflate = zstandard.ZstdDecompressor()
        texts = (b" ".join(inflate.decompress(z).split()) for batch in batches for z in batch.column("z").to_pylist())
        for part in chunks(t for t in texts if t):
            yield _counted(part, order)
        give_back()

    return packed.select("z").mapInArrow(run, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of n-grams seen once, twice and more often, from the numbers of n-grams seen 1 to 4 times; where these are too few, halves."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(i - (i + 1) * y * b / a, 0.05 * i), i) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def estimate(counts: DataFrame, tmp: Scratch, order: int = ORDER) -> DataFrame:
    """(key, value): the natural logarithm of each n-gram's interpolated probability under gram | k << TAG, and of each context's weight of the lower order under context | k << TAG | 1 << 62."""
    raw = tmp.cut(counts, "counts")
    level = {order: raw.where(F.col("k") == order).select("gram", "n")}
    for k in range(order - 1, 0, -1):
        # how many bytes precede an n-gram; the beginning of a text counts as one more
        before = level[k + 1].select(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram"))
        level[k] = tmp.cut(before.union(raw.where(F.col("k") == k).select("gram")).groupBy("gram").agg(F.count("*").alias("n")), f"level-{k}")
    out, lower = None, None
    for k in range(1, order + 1):
        own = level[k]
        n = own.agg(*(F.count_if(F.col("n") == i) for i in range(1, 5))).first()
        d = discounts(*n)
        less = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        own = own.withColumn("context", F.shiftright("gram", 8)).withColumn("less", less)
        sums = tmp.cut(own.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("less") / F.sum("n")).alias("weight")), f"contexts-{k}")
        own = own.join(sums.hint("merge"), "context")
        if lower is None:
            below = F.lit(1 / 256)
        else:
            own = own.withColumn("short", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(lower.select(F.col("gram").alias("short"), F.col("p").alias("below")).hint("merge"), "short")
            below = F.col("below")
        lower = tmp.cut(own.select("gram", ((F.col("n") - F.col("less")) / F.col("total") + F.col("weight") * below).alias("p")), f"p-{k}")
        rows = lower.select(F.col("gram").bitwiseOR(F.lit(k << TAG)).alias("key"), F.log("p").cast("float").alias("value"))
        rows = rows.union(sums.select(F.col("context").bitwiseOR(F.lit(k << TAG | 1 << 62)).alias("key"), F.log("weight").cast("float").alias("value")))
        out = rows if out is None else out.union(rows)
    return out


@dataclass
class Model:
    """Rows of estimate(), sorted by key; enough of them for the texts asked for."""

    keys: np.ndarray
    values: np.ndarray
    order: int = ORDER

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.values[at].astype(float)

    def costs(self, texts: list[bytes]) -> np.ndarray:
        """Minus the logarithm of the probability of each text and the space after it."""
        out = [np.zeros(0)]
        for part in chunks(texts):
            gram, length, text = expand(part, self.order)
            key, inverse = np.unique(gram | length << TAG, return_inverse=True)
            out.append(np.bincount(text, self._each(key & ((1 << TAG) - 1), key >> TAG)[inverse], minlength=len(part)))
        return np.concatenate(out)

    def _each(self, gram: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Minus the logarithm of each n-gram's probability."""
        cost = np.zeros(len(gram))
        open_ = np.arange(len(gram))
        for k in range(self.order, 0, -1):
            at = open_[length[open_] >= k]
            g = gram[at] & ((1 << 8 * k) - 1)
            seen, logp = self.find(g | k << TAG)
            cost[at[seen]] -= logp[seen]
            known, weight = self.find(g[~seen] >> 8 | k << TAG | 1 << 62)
            cost[at[~seen][known]] -= weight[known]
            closed = np.zeros(len(gram), bool)
            closed[at[seen]] = True
            open_ = open_[~closed[open_]]
        cost[open_] += math.log(256)
        return cost

    def perplexities(self, texts: list[list[bytes]]) -> list[float | None]:
        """Per byte, spaces included."""
        costs = iter(self.costs([b" ".join(t) for t in texts if t]).tolist())
        return [math.exp(min(700.0, next(costs) / (sum(map(len, t)) + len(t)))) if t else None for t in texts]


def needed_keys(texts: list[bytes], order: int = ORDER) -> np.ndarray:
    """All keys that the costs of these texts may ask for."""
    parts = [np.zeros(0, np.int64)]
    for part in chunks(texts):
        gram, length, _ = expand(part, order)
        parts.append(np.unique(gram | length << TAG))
    key = np.unique(np.concatenate(parts))
    gram, length = key & ((1 << TAG) - 1), key >> TAG
    out = []
    for k in range(1, order + 1):
        g = np.unique(gram[length >= k] & ((1 << 8 * k) - 1))
        out += [g | k << TAG, np.unique(g >> 8) | k << TAG | 1 << 62]
    return np.concatenate(out)


def _pack(docs: DataFrame, near: IdFilter, doc_id: str, text: str, lang: str) -> DataFrame:
    """(doc_id, lang, z): texts that may have a trusted label, compressed, for the one shuffle that joins them with their labels."""
    zip_ = _Lazy()

    def run(batch: pa.RecordBatch) -> dict:
        batch = near.pick(batch)
        z = [zip_.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "z": z}

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.col(text).alias("text"), near.at(doc_id).alias("at")).where("doc_id IS NOT NULL"), run, "doc_id long, lang string, z binary")


class _Lazy:
    """A compressor that is made where it is used."""

    def compress(self, raw: bytes) -> bytes:
        if not hasattr(self, "own"):
            self.own = zstandard.ZstdCompressor(level=1)
        return self.own.compress(raw)


@dataclass
class Judge:
    """A model, or the table of one that is too large to send, and the thresholds; "" stands for all languages."""

    table: DataFrame
    model: Model | None
    thresholds: dict[str, float]
    order: int


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN, broadcast: int = BROADCAST) -> Judge:
    spark = docs.sparkSession
    tmp = Scratch(spark, "quality-lm")
    trusted = trusted_labels(labels).where("quality > 0 AND toxic <= 0").select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0).alias("held"))
    trusted = tmp.cut(trusted, "labels")
    packed = tmp.cut(_pack(docs, IdFilter(trusted, "doc_id"), doc_id, text, lang).join(trusted.hint("merge"), "doc_id"), "trusted")
    table = tmp.cut(estimate(count_ngrams(packed.where("NOT held"), order), tmp, order), "model")
    model = None
    if table.count() <= broadcast:
        rows = table.toArrow()
        keys = rows.column("key").to_numpy()
        by = np.argsort(keys)
        model = Model(keys[by], rows.column("value").to_numpy()[by], order)
    judge = Judge(table, model, {}, order)
    held = map_batches(packed.where("held").select("doc_id", "lang", "z"), _inflate, "doc_id long, lang string, text string")
    scored = tmp.cut(score(held, judge, tmp=tmp), "held").where("perplexity IS NOT NULL")
    every = scored.groupBy(F.lit("").alias("lang")).agg(F.count("*").alias("n"), F.percentile_approx("perplexity", quantile, 10_000).alias("q"))
    by_lang = scored.where("lang <> ''").groupBy("lang").agg(F.count("*").alias("n"), F.percentile_approx("perplexity", quantile, 10_000).alias("q")).where(F.col("n") >= LEAST_HELD)
    judge.thresholds = {r.lang: r.q * margin for r in every.union(by_lang).collect() if r.q is not None}
    return judge


def _inflate(batch: pa.RecordBatch) -> dict:
    inflate = zstandard.ZstdDecompressor()
    return {"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "text": [inflate.decompress(z).decode("utf-8", "surrogatepass") for z in batch.column("z").to_pylist()]}


def _judged(langs: list[str | None], perplexity: list[float | None], thresholds: dict[str, float]) -> tuple[list, list]:
    limit = [thresholds.get(x or "", thresholds.get("")) for x in langs]
    return limit, [p is None or t is None or p <= t for p, t in zip(perplexity, limit, strict=True)]


SCORES = "doc_id long, lang string, n_words long, perplexity double, threshold double, kept boolean"


def score(docs: DataFrame, judge: Judge, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", tmp: Scratch | None = None) -> DataFrame:
    """doc_id, lang, n_words, perplexity (per byte), threshold, kept for each row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    thresholds = judge.thresholds
    if judge.model is None:
        schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("perplexity", pa.float64()), ("threshold", pa.float64()), ("kept", pa.bool_())])
        return _sharded(docs, judge, tmp or Scratch(docs.sparkSession, "quality-lm"), lambda rows, model: pa.Table.from_pydict(_scored(rows, model, thresholds), schema), SCORES)
    shared = docs.sparkSession.sparkContext.broadcast(judge.model)
    return map_batches(docs, lambda batch: _scored(batch, shared.value, thresholds), SCORES)


def _scored(rows: pa.RecordBatch | pa.Table, model: Model, thresholds: dict[str, float]) -> dict:
    texts = [words(t) for t in rows.column("text").to_pylist()]
    p, langs = model.perplexities(texts), rows.column("lang").to_pylist()
    limit, kept = _judged(langs, p, thresholds)
    return {"doc_id": rows.column("doc_id").to_pylist(), "lang": langs, "n_words": list(map(len, texts)), "perplexity": p, "threshold": limit, "kept": kept}


def _sharded(docs: DataFrame, judge: Judge, tmp: Scratch, answer: Callable[[pa.Table, Model], pa.Table], schema, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """answer(rows, model) for blocks of docs, with a model that stays in its shards: each block gets the rows of it that its texts ask for."""
    order = judge.order
    n, chars = docs.agg(F.count("*"), F.sum(F.length(text))).first()
    blocks = max(1, -(-n // BLOCK_DOCS), -(-(chars or 0) // BLOCK_CHARS))
    own = "__block" + "_" * max(map(len, docs.columns))  # no column of docs
    dealt = docs.withColumn(own, F.pmod(F.xxhash64(doc_id, text), F.lit(blocks)))

    def ask(rows: pa.Table) -> pa.Table:
        keys = needed_keys([b" ".join(w) for t in rows.column("text").to_pylist() if (w := words(t))], order)
        return pa.Table.from_pydict({"block": np.repeat(rows.column("block")[:1].to_numpy(), len(keys)), "key": keys})

    asked = dealt.select(F.col(own).alias("block"), F.col(text).alias("text")).groupBy("block").applyInArrow(ask, "block long, key long")
    told = tmp.cut(asked.join(judge.table.hint("merge"), "key").select("block", "key", "value"), "told")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right.column("key").to_numpy()
        by = np.argsort(keys)
        return answer(left.drop_columns([own]), Model(keys[by], right.column("value").to_numpy()[by], order))

    return dealt.groupBy(own).cogroup(told.groupBy("block")).applyInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **how) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold, kept for each row of docs."""
    return score(docs, train(docs, labels, doc_id, text, lang, **how), doc_id, text, lang)


def keep(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **how) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    judge = train(docs, labels, doc_id, text, lang, **how)
    thresholds = judge.thresholds

    def kept(rows, model: Model):
        p = model.perplexities([words(t) for t in rows.column(text).to_pylist()])
        return rows.filter(pa.array(_judged(rows.column(lang).to_pylist(), p, thresholds)[1], pa.bool_()))

    if judge.model is None:
        return _sharded(docs, judge, Scratch(docs.sparkSession, "quality-lm"), kept, docs.schema, doc_id, text)
    shared = docs.sparkSession.sparkContext.broadcast(judge.model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield kept(batch, shared.value)
        give_back()

    return docs.mapInArrow(run, docs.schema)
