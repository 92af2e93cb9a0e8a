"""Operator 3, quality rules: a short-circuit cascade.

Every rule is a predicate over the statistics of a text. On a sample of the rows each rule's cost (seconds a row) and selectivity (share of rows
it rejects) are estimated; the rules then run in descending order of rejection per cost, each over only those rows that all before it let pass.
The verdict is the conjunction of the rules, so the order changes what is computed and never what is kept.

Defined cases: a null text counts as an empty one; it has no words and fails the base rule. Repeated rows give repeated results. An empty table
gives an empty result, with the rules in their given order. Columns besides the id and the text are passed by.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import map_batches, tune

WINDOW = 5
SYMBOLS = frozenset(b"#*$%&|<>")
NOT_SYMBOLS = bytes(i for i in range(256) if i not in SYMBOLS)
#: Rows of the sample on which costs and selectivities are estimated. It decides the order alone.
SAMPLE_ROWS = 400


@dataclass(frozen=True)
class Rule:
    """rejects(batch, rows): for a Batch and the indices of rows still alive, which of them it rejects."""

    name: str
    rejects: Callable[[Batch, np.ndarray], np.ndarray]


class Batch:
    """Texts with statistics that are computed for the rows that ask for them, once."""

    def __init__(self, texts: list[str | None]):
        self.texts = texts
        self.raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.memo: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.tokens: list[list[bytes] | None] = [None] * len(texts)

    def split(self, i: int) -> list[bytes]:
        if self.tokens[i] is None:
            self.tokens[i] = self.raw[i].split()
        return self.tokens[i]

    def stat(self, name: str, rows: np.ndarray) -> np.ndarray:
        """The statistic of the rows as longs; rows that have it already aren't computed again."""
        have, value = self.memo.setdefault(name, (np.zeros(len(self.texts), bool), np.zeros(len(self.texts), np.int64)))
        todo = rows[~have[rows]]
        if len(todo):
            value[todo] = STATS[name](self, todo)
            have[todo] = True
        return value[rows]


def _n_words(b: Batch, rows) -> list[int]:
    return [len(b.split(i)) for i in rows]


def _word_chars(b: Batch, rows) -> list[int]:
    """Code points in words: bytes that begin a code point, without the six separators."""
    out = []
    for i in rows:
        t = b.raw[i]
        joined = b"".join(b.split(i))
        out.append(len(joined) if len(t) == len(b.texts[i] or "") else len(joined.decode("utf-8", "surrogatepass")))
    return out


def _n_symbols(b: Batch, rows) -> list[int]:
    return [len(b.raw[i].translate(None, NOT_SYMBOLS)) for i in rows]


def _n_lines(b: Batch, rows) -> list[int]:
    """Lines with a word."""
    return [sum(1 for x in b.raw[i].split(b"\n") if x and not x.isspace()) for i in rows]


def _n_dup_lines(b: Batch, rows) -> list[int]:
    out = []
    for i in rows:
        lines = b.raw[i].split(b"\n")
        if len(lines) == 1:
            out.append(0)
        else:
            full = [x for x in lines if x and not x.isspace()]
            out.append(len(full) - len(set(full)))
    return out


def _n_distinct(b: Batch, rows) -> list[int]:
    return [len(set(b.split(i))) for i in rows]


def _n_repeat_words(b: Batch, rows) -> np.ndarray:
    """Words in 5-word windows found twice or more in their own text. Windows of all rows are hashed together and sorted once; those whose hash comes up again are compared word by word."""
    ids: dict[bytes, int] = {}
    take = ids.setdefault
    out = np.zeros(len(rows), np.int64)
    lists, owner = [], []
    for k, i in enumerate(rows):
        w = b.split(i)
        if len(w) > WINDOW:
            lists.append([take(x, len(ids)) for x in w])
            owner.append(k)
    if not lists:
        return out
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((x for w in lists for x in w), np.uint64, int(lengths.sum()))
    text = np.repeat(np.arange(len(lists), dtype=np.uint64), lengths)
    n = len(flat) - WINDOW + 1
    with np.errstate(over="ignore"):
        mixed = (flat + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        key = text[:n] * np.uint64(0xD6E8FEB86659FD93)
        for j in range(WINDOW):
            key = (key + mixed[j : n + j]) * np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(31)
    within = text[:n] == text[WINDOW - 1 :]
    at = np.flatnonzero(within)
    key = key[at]
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    same = np.zeros(len(key), bool)
    again = key[1:] == key[:-1]
    same[1:] |= again
    same[:-1] |= again
    at = at[same]
    if not len(at):
        return out
    rowsof = np.column_stack([text[at].astype(np.int64), *(flat[at + j].astype(np.int64) for j in range(WINDOW))])
    _, inverse, count = np.unique(rowsof, axis=0, return_inverse=True, return_counts=True)
    at = at[count[inverse.ravel()] > 1]
    covered = np.zeros(len(flat) + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    hit = np.cumsum(covered[:-1]) > 0
    out[owner] = np.bincount(text[hit].astype(np.int64), minlength=len(lists))
    return out


STATS: dict[str, Callable[[Batch, np.ndarray], list[int] | np.ndarray]] = {
    "n_words": _n_words, "word_chars": _word_chars, "n_symbols": _n_symbols, "n_lines": _n_lines, "n_dup_lines": _n_dup_lines, "n_distinct": _n_distinct, "n_repeat_words": _n_repeat_words,
}


def _above(a: str, factor: int, b: str, share: int, batch: Batch, rows: np.ndarray) -> np.ndarray:
    """factor * a > share * b"""
    return factor * batch.stat(a, rows) > share * batch.stat(b, rows)


def _below(a: str, factor: int, b: str, share: int, batch: Batch, rows: np.ndarray) -> np.ndarray:
    return factor * batch.stat(a, rows) < share * batch.stat(b, rows)


#: The base: too short, or over 20 in 100 words in repeated windows.
BASE = (
    Rule("too_short", lambda b, r: b.stat("n_words", r) < 10),
    Rule("repeated_windows", partial(_above, "n_repeat_words", 100, "n_words", 20)),
)
#: Production rules besides the base, in whole numbers so that any engine agrees on them.
RULES = (
    Rule("symbols", partial(_above, "n_symbols", 10, "n_words", 1)),
    Rule("repeated_lines", partial(_above, "n_dup_lines", 10, "n_lines", 3)),
    Rule("short_words", partial(_below, "word_chars", 1, "n_words", 2)),
    Rule("long_words", partial(_above, "word_chars", 1, "n_words", 15)),
    Rule("few_distinct_words", partial(_below, "n_distinct", 20, "n_words", 1)),
)


def order_rules(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules in descending order of rejections per cost, as measured on rows drawn from the whole table, sample_rows on average. A rule's cost is what it adds to the words, which all rules share. Very long texts of the sample stand for their first 100,000 characters here."""
    n = docs.count()
    drawn = docs.select(F.substring(text, 1, 100_000)).sample(min(1.0, sample_rows / max(1, n)), seed=3)
    texts = [x[0] for x in drawn.limit(2 * sample_rows).collect()]
    if not texts:
        return tuple(rules)
    score, rows = {}, np.arange(len(texts))
    for rule in rules:
        batch = Batch(texts)
        batch.stat("n_words", rows)
        began = time.perf_counter()
        rejected = int(rule.rejects(batch, rows).sum())
        score[rule.name] = (rejected + 0.5) / (len(texts) + 1) / max(time.perf_counter() - began, 1e-7)
    return tuple(sorted(rules, key=lambda r: -score[r.name]))


def cascade(batch: Batch, rules) -> tuple[np.ndarray, np.ndarray]:
    """Which rows pass all rules, and the index of the first rule that rejects the others (-1: none)."""
    alive, first = np.arange(len(batch.texts)), np.full(len(batch.texts), -1)
    for k, rule in enumerate(rules):
        if not len(alive):
            break
        bad = rule.rejects(batch, alive)
        first[alive[bad]] = k
        alive = alive[~bad]
    return first < 0, first


def apply_rules(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that the base and all rules keep, with all their columns. Rejected rows cost no more than the rules up to the first that rejects them."""
    tune(docs.sparkSession)
    ordered = order_rules(docs, (*BASE, *rules), text, sample_rows)

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                passed, _ = cascade(Batch(batch.column(text).to_pylist()), ordered)
                yield batch.filter(pa.array(passed))

    return docs.mapInArrow(keep, docs.schema)


BASE_COLUMNS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base statistics of every row, base_failed, kept (false if base_failed, else whether all rules pass). The base statistics are returned for all rows and so computed for all; the cascade spares rejected rows the others (lines, distinct words)."""
    tune(docs.sparkSession)
    ordered = order_rules(docs, rules, text, sample_rows)

    def run(batch: pa.RecordBatch) -> dict:
        b = Batch(batch.column(text).to_pylist())
        rows = np.arange(batch.num_rows)
        n, repeat = b.stat("n_words", rows), b.stat("n_repeat_words", rows)
        failed = (n < 10) | (100 * repeat > 20 * n)
        stats = {k: pa.array(b.stat(k, rows)) for k in BASE_COLUMNS}
        kept, alive = ~failed, np.flatnonzero(~failed)
        for rule in ordered:
            if not len(alive):
                break
            bad = rule.rejects(b, alive)
            kept[alive[bad]] = False
            alive = alive[~bad]
        return {"doc_id": batch.column(doc_id), "n_words": pa.array(n), **stats, "base_failed": pa.array(failed), "kept": pa.array(kept)}

    return map_batches(docs.select(F.col(doc_id).cast("long").alias(doc_id), text), run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


#: The same in DuckDB. kept carries RULES as they stand above.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row_no, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
n AS (SELECT row_no, ws, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars, n_symbols, len(list_distinct(ws)) AS n_distinct FROM w),
pos AS (SELECT row_no, ws, unnest(range(1, len(ws) - 3)) AS i FROM n WHERE len(ws) >= 5),
win AS (SELECT row_no, i, list_slice(ws, i, i + 4) AS g FROM pos),
rep AS (SELECT row_no, i FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT row_no, count(DISTINCT p) AS n_repeat_words FROM (SELECT row_no, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY row_no),
ln AS (SELECT row_no, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT row_no, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_no),
s AS (SELECT d.doc_id, n_words, word_chars, n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_distinct
      FROM d JOIN n USING (row_no) LEFT JOIN lines USING (row_no) LEFT JOIN cov USING (row_no)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 20 * n_distinct < n_words) AS kept
FROM b
"""
