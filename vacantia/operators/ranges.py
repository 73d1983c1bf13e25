"""Points in time to the window that holds them: a range join by buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest_window(points: DataFrame, windows: DataFrame, bucket: int = 86_400_000_000) -> DataFrame:
    """points (id, at) and windows (window_id, start, end), in micros, to (id, window_id): the window started last among those that hold the point.

    Windows include both ends; a null end is open, and such windows count from their start on. A
    window stands in every bucket it touches, so the join is one of equal buckets; give a bucket
    about as long as a window. Points in no window, and null ones, get a null window_id; of windows
    that start together the larger id wins.
    """
    last = points.agg(F.max("at").alias("last"))  # one row: open windows need no buckets past it
    spread = windows.filter("start is not null").join(F.broadcast(last)).select(
        "window_id", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.greatest(F.floor(F.col("start") / bucket), F.floor(F.coalesce("end", "last", "start") / bucket)))).alias("bucket")
    )
    held = points.filter("at is not null").withColumn("bucket", F.floor(F.col("at") / bucket)).join(spread, "bucket").filter("at >= start and (end is null or at <= end)")
    best = held.groupBy("id").agg(F.max(F.struct("start", "window_id"))["window_id"].alias("window_id"))
    return points.select("id").join(best, "id", "left")
