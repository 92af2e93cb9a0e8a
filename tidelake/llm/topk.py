"""Operator 9, exact top-k search by block-at-a-time pruning.

Vectors of whole numbers are stored in blocks of ranges of ids, each a forward index (its vectors) with the largest and smallest component of each
dimension (term); neighbouring blocks form a group, which one task searches for a block of queries. For a query, the sum over terms of the larger product
with these two bounds every score in a block. Each query takes a group's blocks in falling order of their bounds, keeps its k best so far, and stops where
a bound falls below its k-th score. First every query searches the group with its greatest bound; the k-th score from there is what it brings into the
other groups, and groups without a block that reaches it are left out. A task returns at most k rows for a query.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, as query or candidate, nor do rows without an id;
a query meets candidates of its own dimension. Rows with the query's id are its own. Rows that repeat an id are candidates each, and may take several
places; queries that repeat an id share its k places. With k or fewer candidates all are returned. An empty table gives an empty result. Scores are exact
up to 2 ** 53 in size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.common import Scratch, map_batches

K, EVERY, SCALE = 20, 20, 64
#: Vectors of a block, blocks of a group, queries of a block.
BLOCK, GROUP, QUERIES = 1024, 16, 512
#: Groups and blocks of queries that meet in one cell of the grid of bounds.
CELL = 64


def _groups(vectors: DataFrame, vec_id: str, embedding: str, scale: int, rows: int, blocks: int, tag: str, tmp: Scratch) -> DataFrame:
    """Groups of about blocks blocks of up to rows vectors, neighbours by id: name, dim, ids, mat, and for each block high and low. Tasks cut their range of ids into pieces of up to a group; pieces that follow each other become one group, so that groups don't depend on the number of tasks."""
    spread = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e")).where("id IS NOT NULL AND size(e) > 0")
    spread = spread.repartitionByRange("id", F.xxhash64("e")).sortWithinPartitions("id")
    most = rows * blocks
    cut = pa.schema([("part", pa.int32()), ("made", pa.int32()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("mat", pa.binary())])

    def pieces(batches):
        part, made, held = TaskContext.get().partitionId(), 0, {}

        def piece(dim):
            nonlocal made
            ids, mat = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            for s in range(0, len(ids), most):
                out = {"part": part, "made": made, "dim": dim, "n": len(ids[s : s + most]), "ids": ids[s : s + most].tobytes(), "mat": mat[s : s + most].tobytes()}
                made += 1
                yield pa.RecordBatch.from_pylist([out], schema=cut)

        for batch in batches:
            ids, e = batch.column("id").to_numpy(zero_copy_only=False), batch.column("e")
            offsets = e.offsets.to_numpy()
            flat = np.floor(scale * np.asarray(e.values.to_numpy(zero_copy_only=False), np.float64))  # nulls are NaN here
            sizes = np.diff(offsets)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                mat = flat[offsets[at][:, None] + np.arange(dim)]
                good = np.isfinite(mat).all(1)
                held.setdefault(dim, []).append((ids[at[good]].astype(np.int64), mat[good]))
                if sum(len(x) for x, _ in held[dim]) >= most:
                    yield from piece(dim)
        for dim in [d for d, x in held.items() if any(len(i) for i, _ in x)]:
            yield from piece(dim)

    made = tmp.cut(spread.mapInArrow(pieces, "part int, made int, dim int, n int, ids binary, mat binary"), f"pieces-{tag}")
    before = F.sum("n").over(Window.partitionBy("dim").orderBy("part", "made")) - F.col("n")
    place = made.select("part", "made", F.floor(before / most).alias("g"), "dim", "n").select("part", "made", "g")  # sizes alone are put in order
    whole = made.join(place.hint("merge"), ["part", "made"]).groupBy("dim", "g").agg(F.array_sort(F.collect_list(F.struct("part", "made", "ids", "mat"))).alias("x"))

    def blocked(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"name": [], "dim": [], "ids": [], "mat": [], "high": [], "low": []}
        for dim, g, x in zip(batch.column("dim").to_pylist(), batch.column("g").to_pylist(), batch.column("x").to_pylist(), strict=True):
            one = _matrix(b"".join(p["mat"] for p in x), dim)
            starts = np.arange(0, len(one), rows)
            for name, value in (("name", f"{tag}{dim}-{g}"), ("dim", dim), ("ids", b"".join(p["ids"] for p in x)), ("mat", one.tobytes()), ("high", np.maximum.reduceat(one, starts).tobytes()), ("low", np.minimum.reduceat(one, starts).tobytes())):
                out[name].append(value)
        return out

    return map_batches(whole, blocked, "name string, dim int, ids binary, mat binary, high binary, low binary")


def _matrix(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, dim)


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For queries and blocks the greatest score that may be in the block."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, ties to the smaller id, ordered by row."""
    order = np.lexsort((ids, -score, row))
    row, score, ids = row[order], score[order], ids[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], score[first], ids[first]


def search(queries: np.ndarray, qids: np.ndarray, kth: np.ndarray, last: np.ndarray, ids: np.ndarray, mat: np.ndarray, high: np.ndarray, low: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, score, id) of the k best of a group for each query, of those that come before its k-th place so far: score kth, id last. Blocks are taken in falling order of bounds, and one is scored for the queries whose k-th score it may reach."""
    reach = bounds(queries, high, low)
    order, kth, last = np.argsort(-reach, axis=1, kind="stable"), kth.copy(), last.copy()
    held = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
    for step in range(reach.shape[1]):
        now = order[:, step]
        live = reach[np.arange(len(now)), now] >= kth
        if not live.any():  # nor do later blocks, whose bounds are no greater
            break
        parts = [held]
        for b in np.unique(now[live]).tolist():
            q = np.flatnonzero(live & (now == b))
            score, own = queries[q] @ mat[b * rows : (b + 1) * rows].T, ids[b * rows : (b + 1) * rows]
            score[qids[q][:, None] == own[None, :]] = -np.inf
            least = kth[q]
            if len(own) > k:
                least = np.maximum(least, -np.partition(-score, k - 1, axis=1)[:, k - 1])
            before = (score >= least[:, None]) & np.isfinite(score) & ((score > kth[q][:, None]) | (own[None, :] <= last[q][:, None]))
            r, c = np.nonzero(before)
            parts.append(best(q[r], score[r, c], own[c], k))
        held = best(*map(np.concatenate, zip(*parts, strict=True)), k)
        n = np.bincount(held[0], minlength=len(kth))
        full = np.flatnonzero(n >= k)
        at = np.cumsum(n)[full] - 1
        better = (held[1][at] > kth[full]) | ((held[1][at] == kth[full]) & (held[2][at] < last[full]))
        kth[full[better]], last[full[better]] = held[1][at[better]], held[2][at[better]]
    return held


def _reached(asked: DataFrame, groups: DataFrame, which) -> DataFrame:
    """(qblock, q, name, reach) for what which(row, greatest bounds of queries and groups) returns. Blocks of queries and the bounds of groups meet in a grid of cells, by a join on the cell and their dimension."""
    nq, ng = (-(-df.count() // CELL) or 1 for df in (asked, groups))
    spot = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = asked.withColumn("cq", spot("qblock", nq)).withColumn("cg", every(ng))
    right = groups.groupBy("dim", spot("name", ng).alias("cg")).agg(F.collect_list(F.struct("name", "high", "low")).alias("of")).withColumn("cq", every(nq))

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"qblock": [], "q": [], "name": [], "reach": []}
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            queries = _matrix(row["mat"], row["dim"])
            reach = np.stack([bounds(queries, _matrix(g["high"], row["dim"]), _matrix(g["low"], row["dim"])).max(1) for g in row["of"]], 1)
            q, g = which(row, reach)
            out["qblock"] += [row["qblock"]] * len(q)
            out["q"] += q.tolist()
            out["name"] += [row["of"][j]["name"] for j in g.tolist()]
            out["reach"] += reach[q, g].tolist()
        return out

    return map_batches(left.join(right.hint("merge"), ["dim", "cq", "cg"]), run, "qblock string, q int, name string, reach double")


def _searched(pairs: DataFrame, asked: DataFrame, groups: DataFrame, rows: int, k: int) -> DataFrame:
    """The k best of each pair of a block of queries and a group: qblock, q, query_id, vec_id, score. pairs: qblock, name, x (query rows, and the score and id of their k-th place so far)."""
    both = pairs.join(asked.select("qblock", F.col("ids").alias("qids"), F.col("mat").alias("qmat")).hint("merge"), "qblock").join(groups.hint("merge"), "name")

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"qblock": [], "q": [], "query_id": [], "vec_id": [], "score": []}
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            dim, qs = row["dim"], np.array([x["q"] for x in row["x"]])
            qids, kth, last = np.frombuffer(row["qids"], np.int64)[qs], np.array([x["kth"] for x in row["x"]], float), np.array([x["last"] for x in row["x"]], np.int64)
            r, s, v = search(_matrix(row["qmat"], dim)[qs], qids, kth, last, np.frombuffer(row["ids"], np.int64), *(_matrix(row[c], dim) for c in ("mat", "high", "low")), rows, k)
            for name, x in (("qblock", [row["qblock"]] * len(r)), ("q", qs[r].tolist()), ("query_id", qids[r].tolist()), ("vec_id", v.tolist()), ("score", s.astype(np.int64).tolist())):
                out[name] += x
        return out

    return map_batches(both, run, "qblock string, q int, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, scale: int = SCALE, block: int = BLOCK, group: int = GROUP, asks: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors with the greatest inner product of floor(scale * x) with each query, ties to the smaller id."""
    tmp = Scratch(vectors.sparkSession, "topk")
    groups = tmp.cut(_groups(vectors, vec_id, embedding, scale, block, group, "d", tmp), "groups")
    asked = tmp.cut(_groups(queries, vec_id, embedding, scale, asks, 1, "q", tmp).select(F.col("name").alias("qblock"), "dim", "ids", "mat"), "queries")
    open_ = F.struct(F.lit(float("-inf")).alias("kth"), F.lit((1 << 63) - 1).alias("last"))
    most = lambda row, reach: (np.arange(len(reach)), reach.argmax(1))
    first = _reached(asked, groups, most).groupBy("qblock", "q").agg(F.max_by("name", F.struct("reach", "name")).alias("name")).withColumn("p", open_)
    first = tmp.cut(first.groupBy("qblock", "name").agg(F.collect_list(F.struct("q", "p.kth", "p.last")).alias("x")), "first")
    early = tmp.cut(_searched(first, asked, groups, block, k), "early")
    place = F.max(F.struct((-F.col("score")).cast("double").alias("s"), "vec_id"))
    kth = early.groupBy("qblock", "q").agg(F.when(F.count("*") >= k, F.struct((-place["s"]).alias("kth"), place["vec_id"].alias("last"))).alias("p"))
    own = first.select("qblock", "name", F.explode("x.q").alias("q"))
    state = own.join(kth.hint("merge"), ["qblock", "q"], "left").withColumn("p", F.coalesce("p", open_)).groupBy("qblock").agg(F.collect_list(F.struct("q", "p.kth", "p.last", "name")).alias("state"))
    state = tmp.cut(state, "state")

    def others(row, reach):
        need, number = np.zeros(reach.shape, bool), {g["name"]: j for j, g in enumerate(row["of"])}
        for x in row["state"]:
            need[x["q"]] = reach[x["q"]] >= x["kth"]
            if x["name"] in number:
                need[x["q"], number[x["name"]]] = False
        return np.nonzero(need)

    floors = state.select("qblock", F.explode("state").alias("s")).select("qblock", "s.q", "s.kth", "s.last")
    rest = _reached(asked.join(state.hint("merge"), "qblock"), groups, others).join(floors.hint("merge"), ["qblock", "q"])
    rest = tmp.cut(rest.groupBy("qblock", "name").agg(F.collect_list(F.struct("q", "kth", "last")).alias("x")), "rest")
    late = _searched(rest, asked, groups, block, k)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = early.union(late).select("query_id", "vec_id", "score")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same in DuckDB, by all pairs.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
