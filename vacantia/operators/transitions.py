"""The state machine of applications, its fold over a history of events, and schedule slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which status may follow which.
EDGES = {
    "DISCOVERED": ("MATCHED", "REJECTED", "SKIPPED", "EXPIRED", "BLOCKED"),
    "MATCHED": ("SELECTED", "REJECTED", "SKIPPED", "EXPIRED", "BLOCKED"),
    "SELECTED": ("PREPARING", "SKIPPED", "EXPIRED", "BLOCKED", "REQUIRES_USER_INPUT"),
    "PREPARING": ("READY", "REQUIRES_USER_INPUT", "FAILED", "SKIPPED", "EXPIRED", "BLOCKED"),
    "READY": ("SUBMITTING", "REQUIRES_USER_INPUT", "SKIPPED", "EXPIRED", "BLOCKED", "SUBMITTED"),
    "SUBMITTING": ("SUBMITTED", "FAILED", "BLOCKED", "REQUIRES_USER_INPUT"),
    "SUBMITTED": ("RESPONSE_RECEIVED", "INTERVIEW", "OFFER", "REJECTED", "WITHDRAWN", "NO_RESPONSE"),
    "REQUIRES_USER_INPUT": ("PREPARING", "READY", "SKIPPED", "EXPIRED", "BLOCKED", "SUBMITTED"),
    "FAILED": ("PREPARING", "READY", "SKIPPED", "EXPIRED", "BLOCKED"),
    "BLOCKED": ("READY", "SKIPPED", "EXPIRED", "SUBMITTED"),
    "SKIPPED": ("SELECTED",),
    "RESPONSE_RECEIVED": ("INTERVIEW", "REJECTED", "WITHDRAWN", "OFFER", "NO_RESPONSE"),
    "INTERVIEW": ("OFFER", "REJECTED", "WITHDRAWN", "INTERVIEW"),
    "OFFER": ("ACCEPTED", "DECLINED", "WITHDRAWN"),
    "NO_RESPONSE": ("RESPONSE_RECEIVED", "INTERVIEW", "REJECTED"),
}
#: The binding of event types to statuses.
STATUS = {"signup": "MATCHED", "view": "SELECTED", "click": "PREPARING", "purchase": "SUBMITTED"}


def status_of(event_type: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[event_type], F.lit("FAILED"))


def allowed(old: Column, new: Column) -> Column:
    table = F.array(*[F.lit(f"{a}>{b}") for a, ends in EDGES.items() for b in ends])
    return F.array_contains(table, F.concat(old, F.lit(">"), new))


def fold(events: DataFrame, initial: str = "DISCOVERED") -> DataFrame:
    """(job_id, event_id, ts, to_status) to (job_id, status, accepted): each event is taken if its edge is allowed from the status so far."""
    history = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "to_status"))).alias("h"))
    start = F.struct(F.lit(initial).alias("status"), F.lit(0).alias("accepted"))

    def step(acc: Column, e: Column) -> Column:
        ok = allowed(acc["status"], e["to_status"])
        return F.struct(F.when(ok, e["to_status"]).otherwise(acc["status"]).alias("status"), (acc["accepted"] + ok.cast("int")).alias("accepted"))

    return history.select("job_id", F.aggregate("h", start, step).alias("x")).select("job_id", "x.*")


def slots(zones: DataFrame, first_day: str, days: int, times: tuple[str, ...], grace_minutes: int) -> DataFrame:
    """Instants of the wall-clock times in each row's zone over some days, with the end of their grace window."""
    day = F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.date_add(F.lit(first_day).cast("date"), i)))
    rows = zones.select("source_key", "zone_name", day.alias("day")).withColumn("time", F.explode(F.array(*map(F.lit, times))))
    wall = F.unix_date("day").cast("long") * 86_400_000_000 + (F.substring("time", 1, 2).cast("long") * 60 + F.substring("time", 4, 2).cast("long")) * 60_000_000
    at = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), F.col("zone_name")))
    return rows.select("source_key", F.col("day").cast("string").alias("day"), "time", at.alias("slot_us"), (at + grace_minutes * 60_000_000).alias("grace_us"))
