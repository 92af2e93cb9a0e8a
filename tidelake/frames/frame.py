"""A frame is one lazy DataFrame on a date spine, with what each column measures. Every operation gives a new frame; the plans of earlier versions stay
valid, so keeping them costs nothing. What metadata can refuse is refused before a plan is built; what only data can tell comes from one aggregate of one row.

Nulls stay null through all operations. A spine that isn't strictly increasing or holds a null is refused when the frame is made."""

from __future__ import annotations

import datetime
import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.operators import alignment

#: The one way of stating prices of a base period: nominal * index at the base / index.
CONVENTION = "cpi_base_period_constant_prices_v1"
KINDS = ("add_column", "deflate_column", "index_column", "revert_to")


class Refused(ValueError):
    """reason names why, for programs; the message says it for people."""

    def __init__(self, reason: str, message: str = ""):
        super().__init__(message or reason.replace("_", " "))
        self.reason = reason


class AddRefused(Refused):
    pass


class DeflateRefused(Refused):
    pass


class IndexRefused(Refused):
    pass


class ExecuteRefused(Refused):
    pass


class HistoryRefused(Refused):
    pass


class FindingRefused(Refused):
    pass


@dataclass(frozen=True)
class Measure:
    key: str
    label: str
    unit: str
    scale: float
    measure_type: str
    made_of: tuple[str, ...] = ()
    how: str = "source"


@dataclass(frozen=True)
class Step:
    """One operation as it was applied; it led from source_version to the next."""

    kind: str
    source_version: int
    parameters: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Finding:
    finding_id: str
    statement: str
    columns: tuple[str, ...]
    version: int
    supersedes: str | None = None


@dataclass(frozen=True)
class Frame:
    frame_id: str
    data: DataFrame
    columns: tuple[Measure, ...] = ()
    steps: tuple[Step, ...] = ()
    findings: tuple[Finding, ...] = ()
    earlier: tuple[Frame, ...] = field(default=(), repr=False)

    @property
    def version(self) -> int:
        return len(self.steps)

    def measure(self, key: str) -> Measure | None:
        return next((m for m in self.columns if m.key == key), None)

    def missing(self) -> dict[str, int]:
        """How many values each column lacks."""
        if not self.columns:
            return {}
        return self.data.agg(*(F.count_if(F.col(m.key).isNull()).alias(m.key) for m in self.columns)).first().asDict()


def check_spine(spine: DataFrame) -> None:
    """Refuses a spine that isn't of dates, is empty, or has a null or a period twice."""
    if dict(spine.dtypes).get("period") != "date":
        raise AddRefused("spine_type", "a spine is a column period of dates")
    n, known, distinct = spine.agg(F.count(F.lit(1)), F.count("period"), F.count_distinct("period")).first()
    if not n or known < n or distinct < n:
        raise AddRefused("invalid_spine", "a spine holds each of its periods once")


def new_frame(frame_id: str, spine: DataFrame) -> Frame:
    check_spine(spine)
    return Frame(frame_id, spine.select("period"))


def _fresh(frame: Frame, key: str, error: type[Refused]) -> None:
    if key == "period" or frame.measure(key):
        raise error("collision", f"the key {key} is taken")


def _numeric(frame: Frame, key: str, error: type[Refused]) -> Measure:
    found = frame.measure(key)
    if found is None:
        raise error("not_found", f"there is no column {key}")
    if dict(frame.data.dtypes)[key] not in ("double", "float", "int", "bigint"):
        raise error("type", f"the column {key} isn't numeric")
    return found


def _infinite(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == F.lit(math.inf))


def add_column(frame: Frame, catalog: DataFrame, observations: DataFrame, series_id: str, key: str) -> tuple[DataFrame, Measure]:
    """The spine with one series, collapsed by its own rule to the spine's frequency."""
    _fresh(frame, key, AddRefused)
    about = catalog.where(F.col("series_id") == series_id).head(1)
    if not about:
        raise AddRefused("not_found", f"there is no series {series_id}")
    about = about[0]
    if about["measure_type"] in (None, "unknown") or not about["unit"]:
        raise AddRefused("measure", f"what {series_id} measures isn't known")
    target = alignment.infer_frequency(frame.data.select(F.lit("spine").alias("series_id"), "period")).head()["frequency"]
    if alignment.COARSENESS[about["native_freq"]] > alignment.COARSENESS[target]:
        raise AddRefused("frequency", f"{series_id} has frequency {about['native_freq']} and isn't shown at {target}")
    own = observations.where(F.col("series_id") == series_id).select("series_id", "period", "value", F.lit(about["aggregation_rule"]).alias("aggregation_rule"))
    if about["native_freq"] != target:
        own = alignment.collapse(own, target)
    data = alignment.spine_join(frame.data, own, key)
    if not data.where(F.col(key).isNotNull()).head(1):
        raise AddRefused("empty", f"{series_id} has no value on the spine")
    how = "source" if about["native_freq"] == target else f"collapse_frequency {about['native_freq']} to {target}"
    return data, Measure(key, series_id, about["unit"], 1.0, about["measure_type"], (series_id,), how)


def deflate_column(frame: Frame, key: str, deflator: str, base: datetime.date, convention: str = CONVENTION) -> tuple[DataFrame, Measure]:
    """A stock at the prices of a base period."""
    if convention != CONVENTION:
        raise DeflateRefused("convention", f"only {CONVENTION} is known")
    if key == deflator:
        raise DeflateRefused("deflator_measure", "a column can't deflate itself")
    target, by = _numeric(frame, key, DeflateRefused), _numeric(frame, deflator, DeflateRefused)
    if target.measure_type != "stock":
        raise DeflateRefused("target_measure", f"{key} is a {target.measure_type}, not a stock")
    if by.measure_type != "index":
        raise DeflateRefused("deflator_measure", f"{deflator} is a {by.measure_type}, not an index")
    out = f"{key}__deflated_by_{deflator}_{base.isoformat()}"
    _fresh(frame, out, DeflateRefused)
    at, v, p = F.col("period") == F.lit(base), F.col(key), F.col(deflator)
    seen = frame.data.agg(
        F.count_if(at).alias("rows"), F.max(F.when(at, p)).alias("base"), F.count_if(_infinite(p) | (p <= 0)).alias("bad"), F.count_if(_infinite(v)).alias("bad_nominal"), F.max(F.abs(v)).alias("most"), F.min(p).alias("least")
    ).head()
    if not seen["rows"]:
        raise DeflateRefused("base_not_found", f"{base} isn't on the spine")
    if seen["base"] is None:
        raise DeflateRefused("base_missing", f"{deflator} has no value at {base}")
    if seen["bad"]:
        raise DeflateRefused("deflator_value", f"{deflator} holds values that aren't positive")
    real = v * F.lit(float(seen["base"])) / p
    if seen["bad_nominal"] or (not math.isfinite((seen["most"] or 0.0) * seen["base"] / seen["least"]) and frame.data.where(_infinite(real)).head(1)):
        raise DeflateRefused("calculation", f"{key} can't be deflated to finite values")
    return frame.data.withColumn(out, real), replace(target, key=out, label=f"{target.label} at {base} prices", made_of=(key, deflator), how=f"deflate {convention}")


def index_column(frame: Frame, key: str, base: datetime.date) -> tuple[DataFrame, Measure]:
    """A column in hundredths of its value at a base period."""
    target = _numeric(frame, key, IndexRefused)
    out = f"{key}__index_{base.isoformat()}"
    _fresh(frame, out, IndexRefused)
    at, v = F.col("period") == F.lit(base), F.col(key)
    seen = frame.data.agg(F.count_if(at).alias("rows"), F.max(F.when(at, v)).alias("base"), F.count_if(_infinite(v)).alias("bad")).head()
    if not seen["rows"]:
        raise IndexRefused("base_not_found", f"{base} isn't on the spine")
    if seen["base"] is None:
        raise IndexRefused("base_missing", f"{key} has no value at {base}")
    if seen["base"] == 0:
        raise IndexRefused("base_zero", f"{key} is 0 at {base}")
    indexed = v / F.lit(float(seen["base"])) * 100
    if seen["bad"] or frame.data.where(_infinite(indexed)).head(1):
        raise IndexRefused("calculation", f"{key} can't be indexed to finite values")
    return frame.data.withColumn(out, indexed), replace(target, key=out, label=f"{target.label}, {base} = 100", unit="index", scale=1.0, measure_type="index", made_of=(key,), how="index")


@dataclass(frozen=True)
class Lake:
    """What add_column reads."""

    catalog: DataFrame
    observations: DataFrame


def execute(frame: Frame, kind: str, expected_version: int, lake: Lake | None = None, **parameters) -> Frame:
    """The next version of a frame, or a refusal that changes nothing. Operations add one column each, or go back to an earlier version; findings stay in either case."""
    if kind not in KINDS:
        raise ExecuteRefused("unsupported", f"{kind} is none of {', '.join(KINDS)}")
    if expected_version != frame.version:
        raise ExecuteRefused("version", f"the frame has version {frame.version}, not {expected_version}")
    step = Step(kind, frame.version, tuple(sorted((k, str(v)) for k, v in parameters.items())))
    kept = dict(steps=(*frame.steps, step), earlier=(*frame.earlier, frame))
    if kind == "revert_to":
        target = parameters["target_version"]
        if not 0 <= target < frame.version:
            raise HistoryRefused("not_found", f"there is no earlier version {target}")
        then = frame.earlier[target]
        return replace(frame, data=then.data, columns=then.columns, **kept)
    if kind == "add_column":
        if lake is None:
            raise ExecuteRefused("handler", "a lake is needed to add a column")
        data, new = add_column(frame, lake.catalog, lake.observations, **parameters)
    else:
        data, new = (deflate_column if kind == "deflate_column" else index_column)(frame, **parameters)
    if data.columns != [*frame.data.columns, new.key]:
        raise ExecuteRefused("postcondition", "an operation adds one column and changes no other")
    return replace(frame, data=data, columns=(*frame.columns, new), **kept)


def find(frame: Frame, finding_id: str, statement: str, columns: tuple[str, ...], supersedes: str | None = None) -> Frame:
    """The frame with one more finding, its version unchanged. A finding is revised at most once, by a new one that supersedes it."""
    ids = {f.finding_id for f in frame.findings}
    if supersedes is not None and supersedes not in ids:
        raise FindingRefused("not_found", f"there is no finding {supersedes}")
    if supersedes is not None and any(f.supersedes == supersedes for f in frame.findings):
        raise FindingRefused("already_superseded", f"{supersedes} was revised before")
    if finding_id in ids:
        raise FindingRefused("duplicate", f"the finding {finding_id} exists")
    if not columns or any(frame.measure(c) is None for c in columns):
        raise FindingRefused("evidence", "a finding rests on columns of the frame")
    return replace(frame, findings=(*frame.findings, Finding(finding_id, statement, tuple(columns), frame.version, supersedes)))


def active(frame: Frame) -> tuple[Finding, ...]:
    gone = {f.supersedes for f in frame.findings}
    return tuple(f for f in frame.findings if f.finding_id not in gone)


class FrameStore:
    """Frames by id, each with its versions. A frame is put only if it follows the current one."""

    def __init__(self):
        self._kept: dict[str, dict[int, Frame]] = {}

    def put(self, frame: Frame) -> None:
        own = self._kept.setdefault(frame.frame_id, {})
        if own:
            now = own[max(own)]
            if frame.version < now.version:
                raise HistoryRefused("stale", f"the store has version {now.version}")
            if frame.version == now.version and frame.steps != now.steps or frame.version > now.version + 1:
                raise HistoryRefused("conflict", f"version {frame.version} doesn't follow {now.version}")
            if frame.steps[: now.version] != now.steps:
                raise HistoryRefused("lineage", "the steps before differ")
        own[frame.version] = frame

    def get(self, frame_id: str, version: int) -> Frame:
        try:
            return self._kept[frame_id][version]
        except KeyError:
            raise HistoryRefused("not_found", f"there is no version {version} of {frame_id}") from None

    def current(self, frame_id: str, version: int | None = None) -> Frame:
        """The newest version; a caller that names another one is told that it is out of date."""
        own = self._kept.get(frame_id)
        if not own:
            raise HistoryRefused("not_found", f"there is no frame {frame_id}")
        if version is not None and version != max(own):
            raise HistoryRefused("stale", f"{frame_id} has version {max(own)}")
        return own[max(own)]
