"""Operator 5, packing by minimum bin slack.

Texts become token ids; each is cut into full windows and a remainder. The remainders are packed by their lengths alone: the histogram of lengths,
never larger than the window, goes to the driver. Again and again the longest remaining length opens a window, and a bitset subset-sum dynamic
programme over the remaining multiset finds the sum closest to what is left of the window; backtracking gives how many of each length it uses, long
ones first. The pattern found is applied as often as the counts allow, so that each step uses up a length and there are no more steps than lengths.
Pieces then find their places by their rank among the pieces of their length; ranks are taken within groups of bounded size.

Defined cases: a null text counts as empty, and a text without ids still has the closing id. Rows that repeat an id are packed each. An empty table
gives no pieces. Other columns are passed by.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.common import Scratch, map_batches

WINDOW, CLOSING_ID = 2048, 1
#: Ranking groups: none holds more than this share of all pieces (or GROUP pieces), so their number is bounded by WINDOW + GROUPS.
GROUPS, GROUP = 4096, 64


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Characters about which regular expression engines of any age agree whether they are letters, numbers or white space; a text with others goes to the tokenizer itself.
_OTHER = re.compile("[^\t\n\r -~\u00a1-\u024f]")
#: Fixed value: the pattern of byte-level pre-tokens, as the vocabulary's users have it.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBE = "I'll say  it's  2nd-rate:\n\n a\t b 12,345 naïve\u0161 x's 'T end \n"


@cache
def _merger(path: str):
    """A faster engine for the same byte-level BPE, with its ranks from the same file; None if the file is of another kind or the two don't agree on a probe."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
        return None, ()
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    special = tuple(t["content"] for t in spec.get("added_tokens", []))
    ranks = {bytes(byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
    engine = tiktoken.Encoding("bpe", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    same = engine.encode_ordinary(_PROBE) == _tokenizer(path).encode(_PROBE, add_special_tokens=False).ids
    return (engine if same else None), special


class Encoder:
    """Ids as the tokenizer of a file gives them, by a faster engine wherever that can't differ: texts of common characters, without the spelling of a special token."""

    def __init__(self, path: str):
        self.path = path

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text, without the closing id."""
        engine, special = _merger(self.path)
        out, rest = [np.empty(0, np.uint32)] * len(texts), []
        for i, text in enumerate(texts):
            if not text:
                continue
            if engine is None or _OTHER.search(text) or any(t in text for t in special):
                rest.append(i)
            else:
                out[i] = np.asarray(engine.encode_to_numpy(text, disallowed_special=()), np.uint32)
        for k in range(0, len(rest), 64):
            part = rest[k : k + 64]
            for i, e in zip(part, _tokenizer(self.path).encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, np.uint32)
        return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """The full windows and the remainder of each text's ids: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids."""
    encoder = Encoder(tokenizer_path)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
        for one, ids in zip(batch.column(doc_id).to_pylist(), encoder.ids(batch.column(text).to_pylist()), strict=True):
            ids = np.append(ids, np.uint32(CLOSING_ID)).astype("<u4")
            for start in range(0, len(ids), window):
                part = ids[start : start + window]
                for k, v in (("doc_id", one), ("start", start), ("length", len(part)), ("ids_crc32", zlib.crc32(part.tobytes())), ("doc_tokens", len(ids))):
                    out[k].append(v)
                if with_ids:
                    out["ids"].append(part.astype(np.int32))
        return out

    return map_batches(docs.select(F.col(doc_id).cast("long").alias(doc_id), text), run, PIECES + (", ids array<int>" if with_ids else ""))


def fill(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: how many}, windows of this pattern) that use up the multiset of lengths, by minimum bin slack."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        goal = window - longest
        mask, reach, steps = (1 << (goal + 1)) - 1, 1, []
        for length in sorted(k for k, v in left.items() if v and k <= goal):
            steps.append((length, reach))
            most, n = min(left[length], goal // length), 1
            while most > 0:
                reach |= reach << (length * min(n, most)) & mask
                most -= n
                n *= 2
        used, at = {longest: 1}, reach.bit_length() - 1
        for length, before in reversed(steps):
            most = min(left[length], at // length)
            n = next(k for k in range(most, -1, -1) if before >> (at - k * length) & 1)
            if n:
                used[length] = used.get(length, 0) + n
                at -= n * length
        left[longest] += 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((used, times))
    return out


def _places(patterns: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """For each length and pattern: length, first rank, how many in a window, first window, first offset; ordered by length and rank."""
    rows, ranks, first = [], {}, 0
    for used, times in patterns:
        offset = 0
        for length in sorted(used, reverse=True):
            rows.append((length, ranks.get(length, 0), used[length], first, offset))
            ranks[length] = ranks.get(length, 0) + used[length] * times
            offset += used[length] * length
        first += times
    return tuple(np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else (np.empty(0, np.int64),) * 5


def pack(cut: DataFrame, tmp: Scratch, window: int = WINDOW) -> DataFrame:
    """The pieces, a table that can be read again, with sequence_id and offset."""
    spark = cut.sparkSession
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most one row for each length up to window
    target = max(GROUP, math.ceil(sum(counts.values()) / GROUPS))
    small = lambda rows, schema: F.broadcast(spark.createDataFrame(rows, schema))
    salts = small([(k, math.ceil(v / target)) for k, v in counts.items()], "length long, salts int")
    salted = cut.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("salts")).cast("int")).drop("salts")
    bases, at = [], {}
    for length, salt, n in sorted(tuple(r) for r in salted.groupBy("length", "salt").count().collect()):  # at most window + GROUPS rows
        bases.append((length, salt, at.get(length, 0)))
        at[length] = at.get(length, 0) + n
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order)).join(small(bases, "length long, salt int, base long"), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.col("base")).drop("salt", "base")
    lengths, ranks, uses, firsts, offsets = _places(fill(counts, window))
    key = lengths * (1 << 50) + ranks
    names = [c for c in ranked.columns if c != "rank"]

    def place(batch: pa.RecordBatch) -> dict:
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        i = np.searchsorted(key, length * (1 << 50) + rank, "right") - 1
        more = rank - ranks[i]
        return {c: batch.column(c) for c in names} | {"sequence_id": firsts[i] + more // uses[i], "offset": offsets[i] + more % uses[i] * length}

    schema = T.StructType([ranked.schema[c] for c in names]).add("sequence_id", "long").add("offset", "long")
    return map_batches(ranked, place, schema).select(*cut.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Every piece of every text with its place: doc_id, start, length, ids_crc32, doc_tokens, (ids,) sequence_id, offset."""
    tmp = Scratch(docs.sparkSession, "packing")
    return pack(tmp.cut(pieces(docs, tokenizer_path, doc_id, text, window, with_ids), "pieces"), tmp, window)
