"""Operator 7, MinHash near-dedup with bottom-k sketches.

One hash function maps a text's shingles to 64-bit values; the k smallest are its sketch. Texts with the same shingle set become one class.
The values that class sketches retain, ordered from the rarest, give inverted lists: two sets that are similar enough share, but for a chance of
at most TAIL, one of their first values in that order (the prefix bound on their sketches' overlap). Pairs from the lists are filtered by the
similarity that the sketch of the union estimates, which loses a similar pair with a chance of at most TAIL again, and the rest are verified by the exact
Jaccard similarity of their full sets. Both chances are exact binomial tails for pairs just at the bound; of more similar pairs fewer are missed.

The members of long lists are listed again by the rarest values of their whole sets, of which similar sets must share one; what meets there is counted in full, without an estimate. Lists
that are still long (large groups of near copies) aren't expanded into all pairs: their members meet a few centres, those with the most common values,
and the links found give components. A list within one component is done; in the others the members outside the largest component meet all others, in
blocks, by their full sets. That last step is quadratic in the members of a list that are linked with none of its centres.

Defined cases: null and empty texts have no shingles and are linked with nothing; a text of 1 to 4 words has one shingle. Rows without an id are
linked with nothing and are kept. Rows that repeat an id are returned each, in the component of that id. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import IdFilter, Scratch, map_batches, words

SHINGLE, SKETCH, PERCENT = 5, 48, 85
#: Lists of up to so many members are expanded into all their pairs.
SHORT = 16
#: Centres of a long list; members of a block.
CENTRES, BLOCK = 8, 64
#: The chance that a sketch's prefix, or its estimate, misses a pair just at the bound.
TAIL = 1e-8
#: Edges that one task joins by itself, 16 bytes each.
HELD_EDGES = 2_000_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_sets(texts: list[str | None], hashes: WordHashes, size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct hashes (as signed longs) of its shingles: size words in a row after lower-casing A-Z, or all of fewer."""
    lists = [words(t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")) if t else [] for t in texts]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((h for w in lists for h in map(hashes.__getitem__, w)), np.uint64, int(lengths.sum()))
    ends = np.cumsum(lengths)
    none = np.empty(0, np.int64)
    out = []
    with np.errstate(over="ignore"):
        n = max(0, len(flat) - size + 1)
        key = np.full(n, size, np.uint64)
        for j in range(size):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + flat[j : n + j])
        for length, end in zip(lengths.tolist(), ends.tolist(), strict=True):
            if length >= size:
                out.append(np.unique(key[end - length : end - size + 1].view(np.int64)))
            elif length:
                k = np.array([length], np.uint64)
                for j in range(end - length, end):
                    k = _mix(k * np.uint64(0x9E3779B97F4A7C15) + flat[j : j + 1])
                out.append(k.view(np.int64))
            else:
                out.append(none)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def least_shared(k: int, percent: int = PERCENT, tail: float = TAIL) -> int:
    """How many of the k smallest values of the union two sets at the bound share at least, but for a chance of tail: the exact binomial tail."""
    p, below, c = percent / 100, 0.0, 0
    while c < k and (below := below + math.comb(k, c) * p**c * (1 - p) ** (k - c)) <= tail:
        c += 1
    return max(1, c)


def prefix_length(k: int, percent: int = PERCENT) -> int:
    """How many of a sketch's k values, rarest first, meet those of any similar set but for chance."""
    return k - least_shared(k, percent) + 1


def _sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    hashes = WordHashes()

    def run(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(batch.column(text).to_pylist(), hashes)
        return {
            "doc_id": batch.column(doc_id), "n": [len(s) for s in sets],
            "fp": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "sketch": [s[:SKETCH] for s in sets],
        }

    return map_batches(docs.select(F.col(doc_id).cast("long").alias(doc_id), text), run, "doc_id long, n int, fp binary, sketch array<long>")


def _lists(values: DataFrame, least: Column, tmp: Scratch, name: str) -> DataFrame:
    """For each set (values: rep, h: tells sets of one rep apart, n, v) cap (how many of them any other set holds), score (the sum of how many hold each) and first: the first of its k values, k - least + 1 of them, (c: how many hold it, v), in ascending order. Two sets that share at least least of theirs meet in one of these. Values that one set alone holds come first and are left out."""
    common = tmp.cut(values.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), f"common-{name}")
    ranked = values.join(common.hint("merge"), "v").groupBy("rep", "h", "n").agg(F.sum("c").alias("score"), F.array_sort(F.collect_list(F.struct("c", "v"))).alias("x"))
    first = F.slice("x", 1, F.greatest(F.lit(0), F.size("x") - least.cast("int") + 1))
    return ranked.select("rep", "h", "n", F.size("x").alias("cap"), "score", first.alias("first")).where("size(first) > 0")


def _estimated(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the sketch of the union allows the bound. a, b: sorted sketches."""
    both = np.concatenate((a[:SKETCH], b[:SKETCH]))
    both.sort()
    twice = both[1:] == both[:-1]
    k = min(SKETCH, len(both) - int(twice.sum()))
    inside = np.cumsum(np.concatenate(([True], ~twice))) <= k
    return int((twice & inside[1:]).sum()) >= least_shared(k, percent)


def _overlapping(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sketches (lists: rep, sketch, first) that meet in a short list and whose estimate may reach the bound. A pair is looked at in one list: that of the least value the two meet in."""
    own = F.filter("first", lambda x: x["c"] <= SHORT)
    own = lists.select("rep", "sketch", F.transform(own, lambda x: x["v"]).alias("own"))
    spots = own.select("rep", "sketch", F.expr("aggregate(own, 0L, (m, v) -> m | shiftleft(1L, cast(array_position(sketch, v) - 1 AS INT)))").alias("spots"), F.explode("own").alias("lid"))
    groups = spots.groupBy("lid").agg(F.collect_list(F.struct("rep", "sketch", "spots")).alias("x")).where("size(x) > 1")

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"a": [], "b": []}
        x = batch.column("x")
        at, lids, inner = x.offsets.to_pylist(), batch.column("lid").to_pylist(), x.values
        reps, spots, sketch = inner.field("rep").to_pylist(), inner.field("spots").to_pylist(), inner.field("sketch")
        values, ends = sketch.values.to_numpy(), sketch.offsets.to_pylist()
        for lid, start, stop in zip(lids, at, at[1:], strict=False):
            members = []
            for i in range(start, stop):
                s = values[ends[i] : ends[i + 1]]
                own = {v for j, v in enumerate(s.tolist()) if spots[i] >> j & 1}
                for rep, t, other in members:
                    if min(own & other) == lid and rep != reps[i] and _estimated(s, t, percent):
                        out["a"].append(min(rep, reps[i]))
                        out["b"].append(max(rep, reps[i]))
                members.append((reps[i], s, own))
        return out

    return map_batches(groups, run, "a long, b long")


def _meeting(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of whole sets (lists: rep, n, cap, first) that meet in a short list and whose sizes allow the bound: no intersection is larger than either cap."""
    groups = lists.select(F.struct("rep", "n", "cap").alias("x"), F.explode(F.filter("first", lambda x: x["c"] <= SHORT)).alias("f")).groupBy("f.v").agg(F.collect_list("x").alias("x")).where("size(x) > 1")
    pairs = F.expr(
        "flatten(transform(x, (p, i) -> transform(filter(slice(x, i + 2, size(x)), q -> q.rep <> p.rep AND least(p.cap, q.cap) * 100 >= (p.n + q.n - least(p.cap, q.cap)) * " + str(percent) + "), "
        "q -> struct(least(p.rep, q.rep) AS a, greatest(p.rep, q.rep) AS b))))"
    )
    return groups.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def _full_sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame, tmp: Scratch) -> DataFrame:
    """(rep, h, n, full) of at least all ids in wanted (rep): texts are read again, and what a filter of bounded size drops isn't shingled."""
    hashes, near = WordHashes(), IdFilter(wanted, "rep")

    def run(batch: pa.RecordBatch) -> dict:
        batch = near.pick(batch)
        sets = shingle_sets(batch.column("text").to_pylist(), hashes)
        return {"rep": batch.column("rep"), "n": [len(s) for s in sets], "fp": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "full": sets}

    some = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text"), near.at(doc_id).alias("at")).where("rep IS NOT NULL")
    return tmp.cut(map_batches(some, run, "rep long, n int, fp binary, full array<long>").where("n > 0").withColumn("h", F.xxhash64("fp")).drop("fp"), "full")


def _linked(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar enough; all are counted through."""
    one = lambda side: full.select(F.col("rep").alias(side), F.col("full").alias(f"full_{side}"))
    both = pairs.join(one("a").hint("merge"), "a").join(one("b").hint("merge"), "b")

    def run(batch: pa.RecordBatch) -> dict:
        a, b, keep = batch.column("full_a"), batch.column("full_b"), []
        va, oa, vb, ob = a.values.to_numpy(), a.offsets.to_numpy(), b.values.to_numpy(), b.offsets.to_numpy()
        for i in range(batch.num_rows):
            x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
            both = np.concatenate((x, y))
            both.sort()
            inter = int((both[1:] == both[:-1]).sum())
            keep.append(inter * 100 >= (len(both) - inter) * percent)
        return {c: batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")}

    return map_batches(both, run, "a long, b long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges a, b and, for each, the least node that these edges reach."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        new = label.copy()
        np.minimum.at(new, p, q)
        np.minimum.at(new, q, p)
        while not np.array_equal(new, up := new[new]):
            new = up
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def connected(edges: DataFrame, tmp: Scratch, tag: str = "", held: int = HELD_EDGES, rounds: int = 100) -> DataFrame:
    """(node, comp) for the nodes of edges (a, b): comp is the smallest node that can be reached. Each task joins what its own edges join, up to about held of them; where one task has them all that is the answer. Else in each round a node takes the
    least label of its neighbours in these forests and then that label's own; labels only fall, and a round without change ends it. It is an error if the rounds don't suffice."""
    edges = tmp.cut(edges.select("a", "b").where("a <> b"), f"{tag}edges")
    parts = -(-edges.count() // held) or 1

    def run(batches):
        got = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches if x.num_rows]
        if got:
            node, comp = forest(*map(np.concatenate, zip(*got, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(comp)], names=["node", "comp"])

    near = edges.coalesce(parts)
    one = near.rdd.getNumPartitions() <= 1
    trees = tmp.cut(near.mapInArrow(run, "node long, comp long"), f"{tag}trees")
    if one:
        return trees
    both = tmp.cut(trees.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b")).union(trees.where("node <> comp").select("comp", "node")).distinct(), f"{tag}both")
    label = tmp.cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("comp")), f"{tag}label-0")
    for k in range(1, rounds + 1):
        seen = both.join(label.select(F.col("node").alias("b"), "comp").hint("merge"), "b").select(F.col("a").alias("node"), "comp")
        least = tmp.cut(seen.union(label).groupBy("node").agg(F.min("comp").alias("comp")), f"{tag}least-{k}")
        jump = least.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        now = least.join(jump.hint("merge"), "comp").join(label.select("node", F.col("comp").alias("was")).hint("merge"), "node")
        now = tmp.cut(now.select("node", F.col("next").alias("comp"), (F.col("next") < F.col("was")).alias("moved")), f"{tag}label-{k}")
        tmp.drop(f"{tag}least-{k}", f"{tag}label-{k - 1}")
        label = now.select("node", "comp")
        if now.where("moved").isEmpty():
            return label
    raise RuntimeError(f"components aren't complete after {rounds} rounds")


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray], width: int = 1 << 14) -> np.ndarray:
    """Sizes of the intersections of sets: products of 0/1 matrices over the values that both sides hold, width of them at a time."""
    x, y = np.concatenate(xs), np.concatenate(ys)
    values = np.intersect1d(x, y)
    out = np.zeros((len(xs), len(ys)), np.int64)
    if len(values):
        sides = []
        for flat, sets in ((x, xs), (y, ys)):
            at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
            have = values[at] == flat
            sides.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[have], at[have]))
        for s in range(0, len(values), width):
            one = []
            for (row, at), sets in zip(sides, (xs, ys), strict=True):
                here = (at >= s) & (at < s + width)
                m = np.zeros((len(sets), min(width, len(values) - s)), np.float32)
                m[row[here], at[here] - s] = 1
                one.append(m)
            out += (one[0] @ one[1].T).astype(np.int64)
    return out


def _blocks(members: DataFrame, full: DataFrame, of: str, name: str) -> DataFrame:
    """Members (lid, rep, comp, size in the column of) with their full sets in blocks of about BLOCK: lid, name."""
    at = F.pmod(F.xxhash64("rep"), F.ceil(F.col(of) / BLOCK)).alias("block")
    return members.join(full.select("rep", "full").hint("merge"), "rep").groupBy("lid", at).agg(F.collect_list(F.struct("rep", "comp", "full")).alias(name)).drop("block")


def _across(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of blocks (lid, x) and (lid, y) of the same list that are in different components; pairs are rows only if they are links."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"a": [], "b": []}
        sides = []
        for name in ("x", "y"):
            inner, full = batch.column(name).values, batch.column(name).values.field("full")
            sides.append((batch.column(name).offsets.to_pylist(), inner.field("rep").to_numpy(), inner.field("comp").to_numpy(), full.values.to_numpy(), full.offsets.to_numpy()))
        for i in range(batch.num_rows):
            (xr, xc, xs), (yr, yc, ys) = ((rep[o[i] : o[i + 1]], comp[o[i] : o[i + 1]], [v[e[j] : e[j + 1]] for j in range(o[i], o[i + 1])]) for o, rep, comp, v, e in sides)
            inter = overlaps(xs, ys)
            union = np.array([*map(len, xs)])[:, None] + np.array([*map(len, ys)])[None, :] - inter
            p, q = np.nonzero((inter * 100 >= union * percent) & (xc[:, None] != yc[None, :]))
            out["a"] += np.minimum(xr[p], yr[q]).tolist()
            out["b"] += np.maximum(xr[p], yr[q]).tolist()
        return out

    return map_batches(left.join(right.hint("merge"), "lid").select("x", "y"), run, "a long, b long")


def _crowded(lists: DataFrame, full: DataFrame, links: DataFrame, tmp: Scratch, percent: int) -> DataFrame:
    """Labels (a: node, b: component) of links and of all links within long lists (rep, score, lid)."""
    heads = tmp.cut(lists.groupBy("lid").agg(F.max_by("rep", F.struct("score", -F.col("rep"))).alias("head")), "heads")
    # lists whose most common member is the same become one, whose pairs are those of all of them and more
    own = tmp.cut(lists.join(heads.hint("merge"), "lid").groupBy(F.col("head").alias("lid"), "rep").agg(F.max("score").alias("score")), "members")
    bucket = F.pmod(F.xxhash64("rep"), F.lit(CENTRES))
    centres = own.groupBy("lid", bucket).agg(F.max_by("rep", F.struct("score", -F.col("rep"))).alias("c"), F.count("*").alias("n")).groupBy("lid").agg(F.collect_list("c").alias("c"), F.sum("n").alias("size"))
    centres = tmp.cut(centres, "centres")
    alone = own.join(centres.select("lid", "size").hint("merge"), "lid").select("lid", "rep", F.col("rep").alias("comp"), "size")
    star = _across(_blocks(alone, full, "size", "x"), _blocks(centres.select("lid", F.explode("c").alias("rep"), F.lit(1).alias("one")).withColumn("comp", F.col("rep")), full, "one", "y"), percent)
    label = connected(links.union(star), tmp, "star-")
    comp = label.select(F.col("node").alias("rep"), "comp")
    placed = tmp.cut(own.join(comp.hint("merge"), "rep", "left").select("lid", "rep", F.coalesce("comp", "rep").alias("comp")), "placed")
    of_list = placed.groupBy("lid", "comp").agg(F.count("*").alias("m")).groupBy("lid").agg(F.max_by("comp", F.struct("m", -F.col("comp"))).alias("most"), F.sum("m").alias("size"), (F.sum("m") - F.max("m")).alias("others"))
    of_list = tmp.cut(of_list.where("others > 0"), "largest")  # read again, so that a join with a long list can be split
    # every link that is left has an end outside its list's largest component; these members meet all others, block by block
    left = tmp.cut(placed.join(of_list.hint("merge"), "lid"), "open")
    rest = _across(_blocks(left, full, "size", "x"), _blocks(left.where("comp <> most"), full, "others", "y"), percent)
    tmp.drop("heads", "members", "placed")
    return label.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(rest)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs. Rows are linked if 100 * intersection >= percent * union of their shingle sets."""
    spark: SparkSession = docs.sparkSession
    tmp = Scratch(spark, "minhash")
    sets = tmp.cut(_sketches(docs, doc_id, text), "sets")
    classes = tmp.cut(
        sets.where("fp IS NOT NULL AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes"
    )
    classes = classes.withColumn("h", F.xxhash64("fp"))
    k = F.least(F.col("n"), F.lit(SKETCH))
    least = F.element_at(F.array(*(F.lit(least_shared(i, percent)) for i in range(1, SKETCH + 1))), k)
    lists = _lists(classes.select("rep", "h", "n", F.explode("sketch").alias("v")), least, tmp, "sketch")
    lists = tmp.cut(lists.join(classes.select("rep", "h", "sketch").hint("merge"), ["rep", "h"]), "lists")
    pairs = tmp.cut(_overlapping(lists, percent), "pairs")
    # whoever is in a long list is listed again by its whole set: similar sets share so much that few members are left whose first values are common
    crowd = lists.where(F.exists("first", lambda x: x["c"] > SHORT)).select("rep", F.lit(True).alias("crowd"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().withColumn("crowd", F.lit(False))
    wanted = tmp.cut(crowd.union(ends), "wanted")
    full = _full_sets(docs, doc_id, text, wanted, tmp)
    whole = full.join(wanted.where("crowd").select("rep").hint("merge"), "rep", "left_semi").dropDuplicates(["rep", "h"])
    again = tmp.cut(_lists(whole.select("rep", "h", "n", F.explode("full").alias("v")), F.ceil(F.col("n") * percent / 100), tmp, "whole"), "again")
    links = tmp.cut(_linked(pairs.union(_meeting(again, percent)).distinct(), full, percent), "links")
    crowded = again.select("rep", "score", F.explode(F.filter("first", lambda x: x["c"] > SHORT)).alias("f")).select("rep", "score", F.col("f.v").alias("lid"))
    label = connected(_crowded(crowded, full, links, tmp, percent), tmp)
    tmp.drop("full", "lists", "pairs", "wanted", "again", "common-sketch", "common-whole")
    rep = classes.select("fp", "rep").join(label.select(F.col("node").alias("rep"), "comp").hint("merge"), "rep", "left").select("fp", F.coalesce("comp", "rep").alias("component_id"))
    rep = tmp.cut(rep, "rep")
    slim = sets.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "fp")
    out = slim.join(rep.hint("merge"), "fp", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: The same in DuckDB, for small tables.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) END AS sh FROM d),
n AS (SELECT doc_id, len(sh) AS n FROM s),
u AS (SELECT doc_id, md5(x) AS x FROM (SELECT doc_id, unnest(sh) AS x FROM s)),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.id, sym.b FROM reach JOIN sym ON sym.a = reach.r),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c ON c.id = n.doc_id
"""
