"""Sessions of the event stream: what a user does without a longer pause than the gap is one session, however the rows arrive; a row that joins two sessions makes one of them.

The same function serves a stream, where a session is given out once the watermark has passed its end and later rows for it are dropped and counted, and a table, by which the stream is checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GAP, LATE = "6 hours", "1 day"


def sessions(events: DataFrame, gap: str = GAP, late: str = LATE) -> DataFrame:
    """user_id, started, ended (the last row's time), n, kinds (sorted), total of a streaming or batch frame of events. Rows without a time or a user belong to no session."""
    x = events.where("ts IS NOT NULL AND user_id IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    own = x.groupBy("user_id", F.session_window("ts", gap).alias("w"))
    out = own.agg(F.max("ts").alias("ended"), F.count("*").alias("n"), F.array_sort(F.collect_set("event_type")).alias("kinds"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("total"))
    return out.select("user_id", F.col("w.start").alias("started"), "ended", "n", "kinds", "total")


def run(spark: SparkSession, source: str, target: str, checkpoint: str, gap: str = GAP, late: str = LATE) -> int:
    """Everything now under source (a folder of Parquet files, one a step) into target; a later run goes on from the checkpoint. How many rows came too late for their session."""
    events = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = sessions(events, gap, late).writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
