"""The gold store: a catalog of series and their observations as Parquet, written once and read by every query of series.

Observations lie in a folder for each source, in files that hold ranges of series, so that a point lookup opens one folder and few row groups. They are
replaced as a whole; nothing is updated in place."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CATALOG, OBSERVATIONS, METRICS = "series_catalog", "series_observations", "store_metrics"
#: Columns of the catalog, and of observations: value is a period's own figure, value_reported the published one.
CATALOG_COLUMNS = (
    "series_id source source_ref name_tr raw_label measure_type statement_kind sector_scope currency_basis province unit_raw unit_normalized scale_factor cumulative_mode cumulative_evidence "
    "cumulative_verified_by native_freq aggregation_rule coverage_start coverage_end observations nonzero_observations retrieved_at source_hash notes"
).split()
OBSERVATION_COLUMNS = ("series_id", "period", "value", "value_reported")
_OPEN: dict[tuple[str, str], str] = {}


class StoreRefused(ValueError):
    """A store that breaks its own schema: keys that repeat, or required columns without a value."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session. Where it is unset and all runs in one process (tests), a new temporary folder, which is then set for the session; on a cluster no local folder is ever taken instead."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        path = f"file://{tempfile.mkdtemp(prefix='tidelake-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def path_of(spark: SparkSession, sf_dir: str, name: str = "gold") -> str:
    return f"{shared_dir(spark)}/tidelake/{name}-{hashlib.sha1(sf_dir.encode()).hexdigest()[:12]}-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a table that is written now and read from then on, so that its lineage ends there and a lost executor costs no more than its tasks."""
    path = f"{shared_dir(df.sparkSession)}/tidelake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_observations(obs: DataFrame, root: str, watch: dict[str, Column] | None = None) -> None:
    """obs (source and OBSERVATION_COLUMNS) replaces what is stored. watch: what is counted on the way, in the same pass, and kept as the store's metrics."""
    ranged = obs.select("source", *OBSERVATION_COLUMNS).repartitionByRange("source", "series_id").sortWithinPartitions("source", "series_id", "period")
    seen = Observation() if watch else None
    if seen:
        ranged = ranged.observe(seen, *(e.alias(f"m{i}") for i, e in enumerate(watch.values())))  # after the last shuffle, so that no row is seen twice
    ranged.write.mode("overwrite").partitionBy("source").parquet(f"{root}/{OBSERVATIONS}")
    if seen:
        rows = [(name, seen.get[f"m{i}"]) for i, name in enumerate(watch)]
        obs.sparkSession.createDataFrame(rows, "name string, n long").coalesce(1).write.mode("overwrite").parquet(f"{root}/{METRICS}")


def read_metrics(spark: SparkSession, root: str) -> DataFrame:
    """name, n: what was counted when the observations were written."""
    return spark.read.schema("name string, n long").parquet(f"{root}/{METRICS}")


def read_observations(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("series_id string, period date, value double, value_reported double, source string").parquet(f"{root}/{OBSERVATIONS}")


def write_catalog(catalog: DataFrame, root: str) -> None:
    """catalog (CATALOG_COLUMNS) replaces what is stored."""
    catalog.select(CATALOG_COLUMNS).write.mode("overwrite").parquet(f"{root}/{CATALOG}")


def read_catalog(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{CATALOG}")


REQUIRED = ("series_id", "source", "source_ref", "name_tr", "measure_type", "cumulative_mode", "native_freq", "aggregation_rule")


def check(spark: SparkSession, root: str) -> None:
    """Refuses a store whose keys repeat, whose catalog lacks what every series must have, or which holds observations of a series that isn't in the catalog."""
    known, seen = read_catalog(spark, root), read_observations(spark, root)
    gone = F.count_if(F.exists(F.array(*(F.col(c).isNull() for c in REQUIRED)), lambda x: x))
    n, keys, lacking = known.agg(F.count("*"), F.countDistinct("series_id"), gone).first()
    if n != keys or lacking:
        raise StoreRefused(f"{n - keys} series repeat, {lacking} lack a required column")
    if not seen.groupBy("series_id", "period").count().where("count > 1 OR period IS NULL").isEmpty():
        raise StoreRefused("a series has a period twice, or none")
    if not seen.select("series_id").distinct().join(known, "series_id", "left_anti").isEmpty():
        raise StoreRefused("observations of a series that the catalog doesn't know")


def rebuilt(spark: SparkSession, sf_dir: str, build) -> str:
    """A new store of sf_dir, written by build(root), checked, and from then on the session's. Who still reads the former one isn't disturbed."""
    root = f"{path_of(spark, sf_dir)}-{uuid.uuid4().hex}"
    build(root)
    check(spark, root)
    _OPEN[spark.sparkContext.applicationId, sf_dir] = root
    return root


def opened(spark: SparkSession, sf_dir: str, build) -> str:
    """Where the store of sf_dir is; it is built the first time a session asks."""
    return _OPEN.get((spark.sparkContext.applicationId, sf_dir)) or rebuilt(spark, sf_dir, build)


def kept(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """Where the session's files of that name are; write(root) makes them the first time."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}|{name}")
    if key not in _OPEN:
        root = f"{shared_dir(spark)}/tidelake/{name}-{uuid.uuid4().hex}"
        write(root)
        _OPEN[key] = root
    return _OPEN[key]


def write_silver(points: DataFrame, root: str) -> DataFrame:
    """Points (series_code, period, value, retrieved_at) in the typed schema of the silver layer; what is stored is returned."""
    typed = points.select("series_code", F.col("period").cast("date"), F.col("value").cast("decimal(38,10)"), F.col("retrieved_at").cast("timestamp"))
    typed.repartitionByRange("series_code", "period").sortWithinPartitions("series_code", "period").write.mode("overwrite").parquet(f"{root}/silver")
    return points.sparkSession.read.parquet(f"{root}/silver")


def coverage(stored: DataFrame, config: DataFrame) -> DataFrame:
    """For each series of the configuration (series_code) what is stored: n, missing, lo, hi, status (ok or no_data)."""
    seen = stored.groupBy("series_code").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.min("period").alias("lo"), F.max("period").alias("hi"))
    out = config.join(seen, "series_code", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("missing", F.coalesce("missing", F.lit(0)))
    return out.withColumn("status", F.when(F.col("n") > 0, "ok").otherwise("no_data"))
