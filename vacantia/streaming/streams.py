"""Streams over the same functions as the batch plans: windowed counts with a watermark, and ingest without repeats."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators import transitions
from vacantia.session import shared_dir, table


def _files(spark: SparkSession, d: str, name: str) -> DataFrame:
    schema = table(spark, d, name).schema
    # one file or a folder of files, both found by the glob
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet*")


def _run(stream: DataFrame, mode: str) -> DataFrame:
    """All that is available now, to a table in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/vacantia-stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{base}/out")
    else:  # each batch gives the whole result, which replaces the one before
        spark.createDataFrame([], stream.schema).write.parquet(f"{base}/out")
        writer = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{base}/out"))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def daily_events(spark: SparkSession, d: str, late: str = "2 days") -> DataFrame:
    """Events a day and type in tumbling windows; complete mode, so that the last windows are given too."""
    events = _files(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counts = events.groupBy(F.window("at", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return _run(counts.select(F.unix_micros("window.start").alias("day_us"), "event_type", "n"), "complete")


def accepted_events(spark: SparkSession, d: str, late: str = "2 days") -> DataFrame:
    """Events as transitions, each event id once within the watermark."""
    events = _files(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    once = events.dropDuplicatesWithinWatermark(["event_id"])
    return _run(once.select("event_id", "user_id", transitions.status_of(F.col("event_type")).alias("to_status")), "append")
