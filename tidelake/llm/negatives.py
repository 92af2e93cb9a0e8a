"""Operator 11, hard-negative mining over a pivot table.

Vectors of whole numbers get one more component, the root of what their squared length lacks of the greatest one, M; an anchor gets 0 there. Then the squared distance of an anchor q
and a vector is |q|^2 + M - 2 * (inner product): the greatest inner product is the least Euclidean distance. Each vector's distances from a few pivots are stored (the pivot table),
and by the triangle inequality the differences and sums of these with the anchor's own bracket its distance, and so its score, from both sides.

Vectors are grouped by their nearest pivot, in blocks ordered by the distance from it; groups and blocks keep the range of each pivot's distances, so whole groups and blocks are
bracketed before their rows. Only rows whose bracket meets what is looked for, a window of scores and the k-th score so far, are checked by the exact inner product. First every
anchor searches the group with the greatest bound; the k-th score there is what it brings into the others. The pivots are picked, each far from those before, among at most SAMPLE
vectors of each dimension; all vectors are indexed, and the result doesn't depend on the pivots.

An anchor's positives are the k best rows of its label; for each of them the negatives are the best rows of other labels whose score is no greater than the positive's and at least so
many percent of it.

Defined cases: rows with a null id, label or vector, an empty vector, or null or non-finite components take no part. Rows with the anchor's id are its own, neither positives nor
negatives. Rows that repeat an id are candidates each; anchors that repeat one have their rows each. An anchor meets vectors of its own dimension. A positive with a negative score has
no negatives, as no score is between 80 hundredths of it and it. Fewer candidates are all returned. An empty table gives an empty result. Scores are exact up to 2 ** 53 in size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.common import Scratch, map_batches
from tidelake.llm.topk import best

SCALE, POSITIVES, NEGATIVES, LEAST_PERCENT = 256, 5, 5, 80
#: The contract's anchors, and the rows whose label is moved on by one of LABELS.
EVERY, MOVED, LABELS = 100, 7, 10
PIVOTS, SAMPLE = 8, 256
#: Rows of a group and of a block; asks that are searched together; groups whose ranges are looked at together.
GROUP, BLOCK, ASKS, RANGES = 8192, 1024, 512, 1024
#: Of |q|^2 + M, what rounding of distances may cost a bound.
SLACK = 1e-6


def _floats(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, width)


def _rows(vectors: DataFrame, anchor: Column, vec_id: str, embedding: str, label: str, scale: int) -> DataFrame:
    """(id, label, ask, dim, e: whole numbers, n2: squared length) of the rows that take part."""
    some = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("ask"), F.col(embedding).cast("array<double>").alias("e"))

    def run(batch: pa.RecordBatch) -> dict:
        e = batch.column("e")
        offsets, flat = e.offsets.to_numpy(), np.floor(scale * np.asarray(e.values.to_numpy(zero_copy_only=False), np.float64))  # nulls are NaN here
        each = [flat[s:t] for s, t in zip(offsets[:-1], offsets[1:], strict=True)]
        good = [bool(np.isfinite(x).all()) for x in each]
        each = [x for x, ok in zip(each, good, strict=True) if ok]
        keep = pa.array(good)
        return {c: batch.column(c).filter(keep) for c in ("id", "label", "ask")} | {"dim": [len(x) for x in each], "e": [x.tobytes() for x in each], "n2": [float(x @ x) for x in each]}

    return map_batches(some.where("id IS NOT NULL AND label IS NOT NULL AND size(e) > 0"), run, "id long, label long, ask boolean, dim int, e binary, n2 double")


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n of points, each the one farthest from those before; the first is the first."""
    chosen, least = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < n and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


class Pivots:
    """The pivots of one dimension, with the greatest squared length: points have one component more."""

    def __init__(self, candidates: np.ndarray, most: float, n: int):
        self.most = most
        self.points = far_apart(self.lifted(candidates), n)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.hstack((x, np.sqrt(np.maximum(0, self.most - (x * x).sum(1)))[:, None]))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 * self.most - 2 * self.lifted(x) @ self.points.T))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + self.most - 2 * q @ self.points[:, :-1].T))


def brackets(q2: np.ndarray, asked: np.ndarray, low: np.ndarray, high: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest score of asks (squared lengths q2, distances asked) with what lies between distances low and high from each pivot."""
    near, far = np.zeros((len(asked), len(low))), np.full((len(asked), len(low)), np.inf)
    for j in range(asked.shape[1]):
        own = asked[:, j, None]
        np.maximum(near, np.maximum(own - high[None, :, j], low[None, :, j] - own), out=near)
        np.minimum(far, own + high[None, :, j], out=far)
    whole = (q2 + most)[:, None]
    return (whole - far * far) / 2 - SLACK * whole - 1e-9, (whole - near * near) / 2 + SLACK * whole + 1e-9


def _pivots(rows: DataFrame, n: int, sample: int) -> dict[int, Pivots]:
    """Pivots by dimension, from at most sample rows of each."""
    h = F.xxhash64("id")
    got = rows.groupBy("dim", F.pmod(h, F.lit(sample))).agg(F.min_by("e", F.struct(h, "e")).alias("e"), F.min(h).alias("h"), F.max("n2").alias("n2")).toArrow().to_pylist()
    out = {}
    for dim in {r["dim"] for r in got}:
        own = sorted((r for r in got if r["dim"] == dim), key=lambda r: (r["h"], r["e"]))
        out[dim] = Pivots(np.stack([np.frombuffer(r["e"], np.float64) for r in own]), max(r["n2"] for r in own), n)
    return out


def _groups(rows: DataFrame, pivots: dict[int, Pivots], group: int, block: int, tmp: Scratch) -> DataFrame:
    """name, dim, and of up to about group rows: ids, labels, mat, table (distances from the pivots), the ranges of its blocks and its own (low, high, least, most)."""

    def near(batch: pa.RecordBatch) -> dict:
        out = {"key": batch.column("key"), "dim": batch.column("dim"), "cell": np.zeros(batch.num_rows, np.int32)}
        dims, raw = batch.column("dim").to_numpy(), batch.column("e").to_pylist()
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            out["cell"][at] = pivots[dim].of_rows(_floats(b"".join(raw[i] for i in at.tolist()), dim)).argmin(1)
        return out | {c: batch.column(c) for c in ("id", "label", "e")}

    placed = tmp.cut(map_batches(rows.select("key", "dim", "id", "label", "e"), near, "key long, dim int, cell int, id long, label long, e binary"), "placed")
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / group).alias("chunks"))  # a row for each pivot
    chunked = placed.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("key"), "chunks"))

    def build(t: pa.Table) -> pa.Table:
        dim, cell, chunk = (t.column(c)[0].as_py() for c in ("dim", "cell", "chunk"))
        mat = _floats(b"".join(t.column("e").to_pylist()), dim)
        far = pivots[dim].of_rows(mat)
        ids, labels = t.column("id").to_numpy(), t.column("label").to_numpy()
        order = np.lexsort((labels, ids, far[:, cell]))
        mat, far, starts = mat[order], far[order], np.arange(0, len(order), block)
        low, high = np.minimum.reduceat(far, starts), np.maximum.reduceat(far, starts)
        out = {"name": f"{dim}-{cell}-{chunk}", "dim": dim, "ids": ids[order].tobytes(), "labels": labels[order].tobytes(), "mat": mat.tobytes(), "far": far.tobytes()}
        out |= {"low": low.tobytes(), "high": high.tobytes(), "least": low.min(0).tobytes(), "most": high.max(0).tobytes()}
        return pa.Table.from_pylist([out], schema=pa.schema([pa.field(k, {str: pa.string(), int: pa.int32()}.get(type(v), pa.binary())) for k, v in out.items()]))

    made = chunked.groupBy("dim", "cell", "chunk").applyInArrow(build, "name string, dim int, ids binary, labels binary, mat binary, far binary, low binary, high binary, least binary, most binary")
    return tmp.cut(made, "groups")


def _blocks(asks: DataFrame, pivots: dict[int, Pivots], size: int, tmp: Scratch, name: str) -> DataFrame:
    """Asks (key, id, label, dim, e, low, high) in blocks: ask, dim, and their columns, with squared lengths q2 and distances far from the pivots."""
    n = max(1, -(-asks.count() // size))

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        dim, at = t.column("dim")[0].as_py(), t.column("at")[0].as_py()
        mat = _floats(b"".join(t.column("e").to_pylist()), dim)
        out = {"ask": f"{dim}-{at}", "dim": dim, "mat": mat.tobytes(), "q2": (mat * mat).sum(1).tobytes(), "far": pivots[dim].of_anchors(mat).tobytes()}
        out |= {c: t.column(c).to_numpy().tobytes() for c in ("key", "id", "label", "low", "high")}
        return pa.Table.from_pylist([out], schema=pa.schema([pa.field(k, {str: pa.string(), int: pa.int32()}.get(type(v), pa.binary())) for k, v in out.items()]))

    dealt = asks.withColumn("at", F.pmod(F.xxhash64("key"), F.lit(n)))
    return tmp.cut(dealt.groupBy("dim", "at").applyInArrow(build, "ask string, dim int, mat binary, q2 binary, far binary, key binary, id binary, label binary, low binary, high binary"), name)


def _reached(asked: DataFrame, groups: DataFrame, pivots: dict[int, Pivots], ranges: int, which) -> DataFrame:
    """(ask, q, name, bound) for the pairs that which(row, names, feasible bounds) takes; a bound is -inf where the bracket misses the ask's window. Distances and ranges alone are sent, not the vectors."""
    parts = max(1, -(-groups.count() // ranges))
    spot = F.pmod(F.xxhash64("name"), F.lit(parts)).cast("long").alias("part")
    of = groups.groupBy("dim", spot).agg(F.collect_list(F.struct("name", "least", "most")).alias("of"))
    every = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"ask": [], "q": [], "name": [], "bound": []}
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            own = pivots[row["dim"]]
            width = len(own.points)
            floor, ceiling = (np.frombuffer(row[c], np.float64) for c in ("low", "high"))
            least, most = (_floats(b"".join(g[c] for g in row["of"]), width) for c in ("least", "most"))
            low, high = brackets(np.frombuffer(row["q2"], np.float64), _floats(row["far"], width), least, most, own.most)
            bound = np.where((high >= floor[:, None]) & (low <= ceiling[:, None]), high, -np.inf)
            q, g = which(row, bound)
            out["ask"] += [row["ask"]] * len(q)
            out["q"] += q.tolist()
            out["name"] += [row["of"][j]["name"] for j in g.tolist()]
            out["bound"] += bound[q, g].tolist()
        return out

    return map_batches(every.join(of.hint("merge"), ["dim", "part"]), run, "ask string, q int, name string, bound double")


def search(ask: dict, group: dict, most: float, block: int, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ask, score, id) of the k best rows of a group for each ask, of those within its window that come before its k-th place so far: score kth, id last."""
    held, kth, last = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)), ask["kth"].copy(), ask["last"].copy()
    low, high = brackets(ask["q2"], ask["far"], group["low"], group["high"], most)
    for b in np.argsort(-high.max(0), kind="stable").tolist():
        q = np.flatnonzero((high[:, b] >= np.maximum(kth, ask["low"])) & (low[:, b] <= ask["high"]))
        if not len(q):
            continue
        rows = slice(b * block, (b + 1) * block)
        far, ids = group["far"][rows], group["ids"][rows]
        least, greatest = brackets(ask["q2"][q], ask["far"][q], far, far, most)
        floor = np.maximum(kth[q], ask["low"][q])
        may = (greatest >= floor[:, None]) & (least <= ask["high"][q][:, None]) & (ids[None, :] != ask["id"][q][:, None]) & ((group["labels"][rows][None, :] == ask["label"][q][:, None]) == same)
        q, may = q[may.any(1)], may[may.any(1)]
        cols = np.flatnonzero(may.any(0))
        score = np.where(may[:, cols], ask["mat"][q] @ group["mat"][rows][cols].T, -np.inf)
        score[(score < ask["low"][q][:, None]) | (score > ask["high"][q][:, None])] = -np.inf
        own = ids[cols]
        good = np.isfinite(score) & ((score > kth[q][:, None]) | ((score == kth[q][:, None]) & (own[None, :] <= last[q][:, None])))
        r, c = np.nonzero(good)
        held = best(*(np.concatenate(x) for x in zip(held, (q[r], score[r, c], own[c]), strict=True)), k)
        n = np.bincount(held[0], minlength=len(kth))
        full = np.flatnonzero(n >= k)
        at = np.cumsum(n)[full] - 1
        better = (held[1][at] > kth[full]) | ((held[1][at] == kth[full]) & (held[2][at] < last[full]))
        kth[full[better]], last[full[better]] = held[1][at[better]], held[2][at[better]]
    return held


def _searched(pairs: DataFrame, asked: DataFrame, groups: DataFrame, pivots: dict[int, Pivots], block: int, k: int, same: bool) -> DataFrame:
    """The k best of each pair of a block of asks and a group: ask, q, key, id, score. pairs: ask, name, x (rows of the block, and the score and id of their k-th place so far)."""
    of = groups.select("name", *(F.col(c).alias(f"g_{c}") for c in ("ids", "labels", "mat", "far", "low", "high")))
    both = pairs.join(asked.hint("merge"), "ask").join(of.hint("merge"), "name")

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"ask": [], "q": [], "key": [], "id": [], "score": []}
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            dim, own = row["dim"], pivots[row["dim"]]
            width, qs = len(own.points), np.array([x["q"] for x in row["x"]])
            one = {"mat": _floats(row["mat"], dim)[qs], "far": _floats(row["far"], width)[qs]} | {c: np.frombuffer(row[c], np.float64)[qs] for c in ("q2", "low", "high")} | {c: np.frombuffer(row[c], np.int64)[qs] for c in ("key", "id", "label")}
            one |= {"kth": np.array([x["kth"] for x in row["x"]], float), "last": np.array([x["last"] for x in row["x"]], np.int64)}
            group = {"mat": _floats(row["g_mat"], dim)} | {c: _floats(row[f"g_{c}"], width) for c in ("far", "low", "high")} | {c: np.frombuffer(row[f"g_{c}"], np.int64) for c in ("ids", "labels")}
            r, s, v = search(one, group, own.most, block, k, same)
            for name, x in (("ask", [row["ask"]] * len(r)), ("q", qs[r].tolist()), ("key", one["key"][r].tolist()), ("id", v.tolist()), ("score", s.astype(np.int64).tolist())):
                out[name] += x
        return out

    return map_batches(both, run, "ask string, q int, key long, id long, score long")


def _best(asks: DataFrame, groups: DataFrame, pivots: dict[int, Pivots], k: int, same: bool, tmp: Scratch, tag: str, block: int, size: int, ranges: int) -> DataFrame:
    """key, rank, id, score: for each ask its k rows with the greatest score in its window, of its own label or of all others."""
    asked = _blocks(asks, pivots, size, tmp, f"{tag}-asks")
    light = asked.select("ask", "dim", "q2", "far", "low", "high")
    open_ = F.struct(F.lit(float("-inf")).alias("kth"), F.lit((1 << 63) - 1).alias("last"))

    def greatest(row, bound):
        q = np.flatnonzero(np.isfinite(bound).any(1))
        return q, bound[q].argmax(1)

    first = _reached(light, groups, pivots, ranges, greatest).groupBy("ask", "q").agg(F.max_by("name", F.struct("bound", "name")).alias("name")).withColumn("p", open_)
    first = tmp.cut(first.groupBy("ask", "name").agg(F.collect_list(F.struct("q", "p.kth", "p.last")).alias("x")), f"{tag}-first")
    early = tmp.cut(_searched(first, asked, groups, pivots, block, k, same), f"{tag}-early")
    place = F.max(F.struct((-F.col("score")).cast("double").alias("s"), "id"))
    kth = early.groupBy("ask", "q").agg(F.when(F.count("*") >= k, F.struct((-place["s"]).alias("kth"), place["id"].alias("last"))).alias("p"))
    own = first.select("ask", "name", F.explode("x.q").alias("q"))
    state = own.join(kth.hint("merge"), ["ask", "q"], "left").withColumn("p", F.coalesce("p", open_)).groupBy("ask").agg(F.collect_list(F.struct("q", "p.kth", "p.last", "name")).alias("state"))
    state = tmp.cut(state, f"{tag}-state")

    def others(row, bound):
        need, number = np.zeros(bound.shape, bool), {g["name"]: j for j, g in enumerate(row["of"])}
        for x in row["state"]:
            need[x["q"]] = np.isfinite(bound[x["q"]]) & (bound[x["q"]] >= x["kth"])
            if x["name"] in number:
                need[x["q"], number[x["name"]]] = False
        return np.nonzero(need)

    floors = state.select("ask", F.explode("state").alias("s")).select("ask", "s.q", "s.kth", "s.last")
    rest = _reached(light.join(state.hint("merge"), "ask"), groups, pivots, ranges, others).join(floors.hint("merge"), ["ask", "q"])
    rest = tmp.cut(rest.groupBy("ask", "name").agg(F.collect_list(F.struct("q", "kth", "last")).alias("x")), f"{tag}-rest")
    found = early.union(_searched(rest, asked, groups, pivots, block, k, same)).select("key", "id", "score")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
    return tmp.cut(found.withColumn("rank", rank).where(F.col("rank") <= k), f"{tag}-best")


def mine(
    vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT,
    scale: int = SCALE, pivots: int = PIVOTS, sample: int = SAMPLE, group: int = GROUP, block: int = BLOCK, asks: int = ASKS, ranges: int = RANGES,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. anchor: which rows are anchors, a condition on columns of vectors."""
    tmp = Scratch(vectors.sparkSession, "negatives")
    rows = tmp.cut(_rows(vectors, anchor, vec_id, embedding, label, scale).withColumn("key", F.monotonically_increasing_id()), "rows")
    table = _pivots(rows, pivots, sample)
    groups = _groups(rows, table, group, block, tmp)
    anchors = rows.where("ask").select("key", "id", "label", "dim", "e")
    every = F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")
    own = _best(anchors.select("*", *every), groups, table, positives, True, tmp, "positive", block, asks, ranges)
    own = own.where("score >= 0").select(F.col("key").alias("of"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("key") * positives + F.col("rank") - 1).alias("key"))
    window = F.expr(f"double(({least_percent} * positive_score + 99) div 100)").alias("low"), F.col("positive_score").cast("double").alias("high")
    pairs = own.join(anchors.withColumnRenamed("key", "of").hint("merge"), "of")
    found = _best(pairs.select("key", "id", "label", "dim", "e", *window), groups, table, negatives, False, tmp, "negative", block, asks, ranges)
    named = pairs.select("key", F.col("id").alias("anchor_id"), "positive_id", "positive_score").join(found.select("key", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).hint("merge"), "key")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def moved(vectors: DataFrame, vec_id: str = "vec_id", label: str = "label", every: int = MOVED, labels: int = LABELS) -> DataFrame:
    """vectors with the label of each row whose id is divisible by every moved on by one, a planted error."""
    return vectors.withColumn(label, F.when(F.col(vec_id) % every == 0, (F.col(label) + 1) % labels).otherwise(F.col(label)))


#: The same in DuckDB, by all pairs.
SQL = """
WITH v AS (SELECT row_number() OVER () AS key, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.key, a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score FROM v a, v c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT key, anchor_id, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY key ORDER BY score DESC, other) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.key, place ORDER BY score DESC, other) AS rank
      FROM p JOIN s ON s.key = p.key AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
