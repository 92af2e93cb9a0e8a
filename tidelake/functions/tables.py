"""Statistics as table functions of SQL: SELECT * FROM unit_root(TABLE(observations) PARTITION BY series_id ORDER BY period).

A call gets the rows of one series in order. Which columns hold the series and its values is found when the query is planned; a table without them, or a call without parts, is refused there."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from tidelake.functions import stats


def of_series(columns: dict[str, T.DataType], function: Callable[[np.ndarray], list[tuple]]) -> type:
    """A table function that gathers the values of one series, nulls left out, and gives out what function says of them; what can't be computed is null."""

    class OfSeries:
        @staticmethod
        def analyze(observations: AnalyzeArgument) -> AnalyzeResult:
            kinds = {f.name: f.dataType for f in observations.dataType.fields} if observations.isTable else {}
            if not {"series_id", "value"} <= set(kinds) or not isinstance(kinds["value"], T.NumericType):
                raise ValueError("observations must be a table with a column series_id and a number value: TABLE(...) PARTITION BY series_id ORDER BY period")
            return AnalyzeResult(T.StructType([T.StructField("series_id", kinds["series_id"]), *(T.StructField(n, t) for n, t in columns.items())]))

        def __init__(self):
            self.series, self.values = None, []

        def eval(self, row):
            self.series = row["series_id"]
            if row["value"] is not None:
                self.values.append(float(row["value"]))

        def terminate(self):
            try:
                found = function(np.array(self.values))
            except (stats.Refused, np.linalg.LinAlgError, ZeroDivisionError, ValueError):
                found = [(None,) * len(columns)]
            for r in found:
                yield self.series, *r

    return OfSeries


def _unit_root(values: np.ndarray) -> list[tuple]:
    t, lag = stats.unit_root(values)
    return [(t, stats.unit_root_p(t), lag)]


def _kpss(values: np.ndarray) -> list[tuple]:
    s = stats.kpss(values)
    return [(s, stats.kpss_p(s))]


def _change_points(values: np.ndarray) -> list[tuple]:
    """The position of the first value after each break (from 0), and its kind; none for series without one, or too short."""
    try:
        return stats.change_points(values.tolist(), *stats.penalties(values.tolist()), SHORTEST)
    except stats.Refused:
        return []


SHORTEST = 6
_D, _I, _S = T.DoubleType(), T.IntegerType(), T.StringType()
FUNCTIONS = {
    "unit_root": of_series({"statistic": _D, "p": _D, "lag": _I}, _unit_root), "kpss": of_series({"statistic": _D, "p": _D}, _kpss),
    "change_points": of_series({"position": _I, "kind": _S}, _change_points),
}


def register(spark: SparkSession) -> None:
    """The functions by name, for SQL of this session."""
    for name, kind in FUNCTIONS.items():
        spark.udtf.register(name, udtf(kind))
