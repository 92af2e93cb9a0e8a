"""What a listener may rely on in a stream of events of one analysis: sequence numbers rise by one, times never go back, one completion ends it, and a stage that is still open then was closed as failed before.

A stream that stops without a completion is ended for it, TIMEOUT after its last event: by an error if it told of none, the end of its open stage, and a failed completion. Whatever comes after an end isn't given out.
complete() is the rule over a table, by windows; follow() keeps a state for each stream, with a timer for those that fall silent. Both give the same events."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TIMEOUT = datetime.timedelta(hours=12)
#: Kinds of events with a meaning for the order; others pass.
START, END, ERROR, COMPLETION = "stage_start", "stage_end", "error", "completion"
OUTPUT = "stream string, sequence int, kind string, stage string, outcome string, occurred_at timestamp"
STATE = "last timestamp, open string, failed boolean, sequence int, done boolean"


def _interval(timeout: datetime.timedelta) -> Column:
    return F.expr(f"INTERVAL {int(timeout.total_seconds())} SECONDS")


def complete(events: DataFrame, timeout: datetime.timedelta = TIMEOUT) -> DataFrame:
    """OUTPUT for events (stream, place: order of arrival, at, kind, stage) of a table."""
    arrived = Window.partitionBy("stream").orderBy("place")
    before = arrived.rowsBetween(Window.unboundedPreceding, -1)
    x = events.withColumn("occurred_at", F.max("at").over(arrived)).withColumn("last", F.max("at").over(before))
    silent = F.coalesce(F.col("occurred_at") > F.col("last") + _interval(timeout), F.lit(False))
    x = x.withColumn("silent", F.max(silent).over(arrived)).withColumn("done", F.coalesce(F.max(F.col("kind") == COMPLETION).over(before), F.lit(False)))
    x = x.where("NOT silent AND NOT done")
    said = x.select("stream", F.struct(F.lit(0).alias("group"), "place").alias("order"), "kind", "stage", F.lit(None).cast("string").alias("outcome"), "occurred_at")
    stage = F.max_by(F.when(F.col("kind") == START, F.col("stage")), F.when(F.col("kind").isin(START, END), F.col("place")))
    ends = x.groupBy("stream").agg(F.max(F.col("kind") == COMPLETION).alias("whole"), F.max(F.col("kind") == ERROR).alias("failed"), stage.alias("open"), F.max("occurred_at").alias("last")).where("NOT whole")
    event = lambda kind, stage, outcome: F.struct(F.lit(kind).alias("kind"), stage.cast("string").alias("stage"), F.lit(outcome).cast("string").alias("outcome"))
    none = F.lit(None)
    closing = F.array_compact(F.array(F.when(~F.col("failed"), event(ERROR, none, None)), F.when(F.col("open").isNotNull(), event(END, F.col("open"), "failed")), event(COMPLETION, none, "failed")))
    made = ends.select("stream", (F.col("last") + _interval(timeout)).alias("occurred_at"), F.posexplode(closing).alias("k", "e"))
    made = made.select("stream", F.struct(F.lit(1).alias("group"), F.col("k").cast("long").alias("place")).alias("order"), "e.kind", "e.stage", "e.outcome", "occurred_at")
    sequence = F.row_number().over(Window.partitionBy("stream").orderBy("order")) - 1
    return said.unionByName(made).select("stream", sequence.alias("sequence"), "kind", "stage", "outcome", "occurred_at")


class Ordering(StatefulProcessor):
    """The state of a stream: the last time given out, the open stage, whether it told of an error, the next number, and whether it has ended."""

    def __init__(self, timeout: datetime.timedelta = TIMEOUT):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", STATE)

    def _ended(self, stream: str, last, open_: str | None, failed: bool, sequence: int) -> list[tuple]:
        kinds = ([] if failed else [(ERROR, None, None)]) + ([(END, open_, "failed")] if open_ is not None else []) + [(COMPLETION, None, "failed")]
        return [(stream, sequence + k, *kind, last + self.timeout) for k, kind in enumerate(kinds)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (stream,) = key
        last, open_, failed, sequence, done = self.state.get() if self.state.exists() else (None, None, False, 0, False)
        out = []
        for r in pd.concat(list(rows)).sort_values("place").itertuples():
            if done:
                break
            at = r.at if last is None else max(last, r.at)
            if last is not None and at > last + self.timeout:
                out += self._ended(stream, last, open_, failed, sequence)
                done = True
                break
            out.append((stream, sequence, r.kind, r.stage, None, at))
            last, sequence = at, sequence + 1
            open_ = r.stage if r.kind == START else None if r.kind == END else open_
            failed |= r.kind == ERROR
            done = r.kind == COMPLETION
        self.state.update((last, open_, failed, sequence, done))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not done:
            self.handle.registerTimer(int((last + self.timeout).replace(tzinfo=datetime.UTC).timestamp() * 1000) + 1)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, open_, failed, sequence, done = self.state.get()
        out = [] if done else self._ended(key[0], last, open_, failed, sequence)
        self.state.update((last, open_, failed, sequence + len(out), True))
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def follow(events: DataFrame, timeout: datetime.timedelta = TIMEOUT, late: str = "1 hour") -> DataFrame:
    """OUTPUT for a streaming frame of events (stream, place, at, kind, stage). Times are taken in UTC. It needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    keyed = events.withWatermark("at", late).groupBy("stream")
    return keyed.transformWithStateInPandas(Ordering(timeout), OUTPUT, "Append", "EventTime")
