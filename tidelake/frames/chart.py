"""How columns of a frame are drawn: one axis for each pair of unit and measure, two at most. The only query is one aggregate of medians."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.frames.frame import Frame, Refused

#: Medians this many times apart make a common axis unreadable; indexing is then recommended.
MAGNITUDE = 100.0


class ChartRefused(Refused):
    pass


@dataclass(frozen=True)
class Chart:
    chart_id: str
    chart_type: str
    axes: tuple[tuple[str, str], ...]
    magnitude_ratio: float | None
    indexing_recommended: bool
    title: str | None


def _chosen(frame: Frame, keys: list[str] | None):
    if keys is not None and len(set(keys)) < len(keys):
        raise ChartRefused("invalid_override", "a column is asked for twice")
    if keys is not None and (unknown := [k for k in keys if frame.measure(k) is None]):
        raise ChartRefused("unknown_column", f"there is no column {', '.join(unknown)}")
    kinds = dict(frame.data.dtypes)
    numeric = {m.key for m in frame.columns if kinds[m.key] in ("double", "float", "int", "bigint")}
    picked = [m for m in frame.columns if (m.key in numeric if keys is None else m.key in keys)]
    if not picked:
        raise ChartRefused("no_numeric_columns")
    for m in picked:
        for bad, reason in ((m.key not in numeric, "non_numeric_column"), (m.unit is None, "missing_unit"), (not m.unit, "missing_unit_symbol"), (not m.measure_type, "missing_measure_type")):
            if bad:
                raise ChartRefused(reason, f"{m.key} can't be drawn: {reason.replace('_', ' ')}")
    return picked


def axes_of(frame: Frame, keys: list[str] | None = None) -> DataFrame:
    """column_key, axis, magnitude_ratio, indexing: the chosen axes beside the columns' medians, all in one aggregate that stays a table."""
    sides, picked = _sides(_chosen(frame, keys)), _chosen(frame, keys)
    one = frame.data.agg(*(F.median(F.when(F.col(m.key) != 0, F.abs(F.col(m.key)))).alias(m.key) for m in picked))
    known = F.array_compact(F.array(*(F.col(m.key) for m in picked)))
    ratio = F.when(F.size(known) > 1, F.array_max(known) / F.array_min(known))
    axes = F.explode(F.array(*(F.struct(F.lit(k).alias("column_key"), F.lit(a).alias("axis")) for k, a in sides.items())))
    return one.select(axes.alias("a"), ratio.alias("magnitude_ratio")).select("a.column_key", "a.axis", "magnitude_ratio", F.coalesce(F.col("magnitude_ratio") >= MAGNITUDE, F.lit(False)).alias("indexing"))


def _sides(picked: list) -> dict[str, str]:
    """The left axis for columns of the first one's unit and measure, the right one for those of another; no third."""
    groups = list(dict.fromkeys((m.unit, m.scale, m.measure_type) for m in picked))
    if len(groups) > 2:
        raise ChartRefused("too_many_unit_groups", "two axes can't show more than two units")
    return {m.key: "left" if (m.unit, m.scale, m.measure_type) == groups[0] else "right" for m in picked}


def select_chart(frame: Frame, keys: list[str] | None = None, axes: dict[str, str] | None = None, chart_type: str = "line", title: str | None = None) -> Chart:
    """The chart of the columns, in the frame's order. axes: an axis for every column in that order, in place of the chosen ones."""
    picked = _chosen(frame, keys)
    sides = _sides(picked)
    if axes is not None:
        if list(axes) != list(sides) or not set(axes.values()) <= {"left", "right"} or "left" not in axes.values():
            raise ChartRefused("invalid_override", "every column needs an axis, and one of them the left one")
        sides = axes
    medians = frame.data.agg(*(F.median(F.when(F.col(m.key) != 0, F.abs(F.col(m.key)))).alias(m.key) for m in picked)).first()
    known = [x for x in medians if x is not None]
    ratio = max(known) / min(known) if len(known) > 1 else None
    far = ratio is not None and ratio >= MAGNITUDE
    said = {"frame": frame.frame_id, "version": frame.version, "type": chart_type, "axes": list(sides.items()), "indexing": far, "title": title}
    digest = hashlib.sha256(json.dumps(said, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    return Chart(f"chart-{digest[:16]}", chart_type, tuple(sides.items()), ratio, far, title)
