"""What the corpus operators share: intermediate tables, words, batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.sources.store import shared_dir

#: Bytes of an Arrow batch that goes to a Python worker. Rows of very long texts then travel few at a time.
BATCH_BYTES = 1 << 20


def tune(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches; a session's own setting below the bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


class Scratch:
    """Intermediate tables of one run, as Parquet under the shared folder. Reading one back cuts the lineage, and a lost executor costs no more than the tasks it was running."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tidelake/{name}-{uuid.uuid4().hex}"
        tune(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The maximal runs of characters other than space and U+0009 to U+000D, in UTF-8. bytes.split() parts at just these six."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def give_back() -> None:
    """At a task's end: what it freed goes back to the system. Python workers live on from task to task, and their allocators keep what a task needed at its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def map_batches(df: DataFrame, function, schema: T.StructType | str) -> DataFrame:
    """mapInArrow with a function of one record batch that returns columns as a dict of lists or arrays (None: no rows)."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f in arrow for x in (out[f.name],)], schema=arrow)
        give_back()

    return df.mapInArrow(run, schema)


def trusted_labels(labels: DataFrame) -> DataFrame:
    """One row for each labelled doc_id: quality and toxic, of repeated rows the worst (lowest quality, highest toxic). Rows without an id or a quality are left out; a null toxic counts as 0."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
    )


#: Bits of a filter of ids: between these, as many as its ids need. Ids beyond what fits make it let more through, never less.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28


class IdFilter:
    """Which rows may have one of many ids: never says no to one of them, and yes to few others. Tasks OR a bitmap of hashed ids, whose size is bounded, and it goes to the tasks that read the rows."""

    def __init__(self, ids: DataFrame, column: str):
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * ids.count()).bit_length()))
        at = ids.where(F.col(column).isNotNull()).select(self.at(column).alias("at"))
        found = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, at & 63))").alias("b")).toArrow()
        bitmap = np.zeros(self.bits >> 6, np.int64)
        bitmap[found.column("w").to_numpy()] = found.column("b").to_numpy()
        self.held = ids.sparkSession.sparkContext.broadcast(bitmap)

    def at(self, column: str) -> Column:
        """Where an id stands in the bitmap; null has a place too."""
        return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(self.bits)).cast("int")

    def pick(self, batch: pa.RecordBatch, column: str = "at") -> pa.RecordBatch:
        """In a task: the rows that may have one of the ids; column holds at()."""
        i = batch.column(column).to_numpy(zero_copy_only=False)
        return batch.filter(pa.array((self.held.value[i >> 6] >> (i & 63) & 1).astype(bool)))
