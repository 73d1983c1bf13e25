"""Pay statistics: annualised midpoints, exact percentiles, explicit and expected apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.operators.demand import instant

#: Periods of a year.
ANNUAL = {"year": 1, "month": 12, "week": 52, "day": 260, "hour": 2080}


def annual_factor(period: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in ANNUAL.items() for x in kv])[period]


def midpoint(low: Column, high: Column) -> Column:
    return F.coalesce((low + high) / 2, low, high)


@dataclass(frozen=True)
class PayFilter:
    """Optional, AND-ed. A role or location is looked for in the posting's title or location, whatever the case; periods are half open."""

    start: str | None = None
    end: str | None = None
    seniority: str | None = None
    role: str | None = None
    location: str | None = None
    work_mode: str | None = None
    source: str | None = None

    def of(self, rows: DataFrame) -> DataFrame:
        """rows: observations with their seniority and the posting's title, place, country, mode and source_key, null without a posting."""
        if self.start:
            rows = rows.filter(F.col("observed_at") >= instant(self.start))
        if self.end:
            rows = rows.filter(F.col("observed_at") < instant(self.end))
        for column, wanted in (("seniority", self.seniority), ("work_mode", self.work_mode), ("source_key", self.source)):
            if wanted:
                rows = rows.filter(F.col(column) == wanted)
        if self.role:
            rows = rows.filter(F.contains(F.lower("title"), F.lit(self.role.lower())))
        if self.location:
            rows = rows.filter(F.contains(F.lower("location"), F.lit(self.location.lower())) | F.contains(F.lower("country"), F.lit(self.location.lower())))
        return rows


def statistics(observations: DataFrame, jobs: DataFrame, by: list[str], currency: str, min_sample: int = 3, wanted: PayFilter = PayFilter(), sources: DataFrame | None = None) -> DataFrame:
    """One row per observation type and group. Below min_sample only size and mean confidence are given.

    Percentiles are interpolated at (n - 1) p between ranks; the sort behind the ranks may spill, so
    that no group has to fit into one buffer.
    """
    paid = observations.filter((F.col("currency") == currency) & F.col("period").isin(*ANNUAL) & F.coalesce("min_amount", "max_amount").isNotNull())
    posting = jobs.select(F.col("id").alias("job_id"), F.col("seniority").alias("job_seniority"), "duplicate_of_job_id", "title", "location", "country", "work_mode", "source_id")
    if sources is not None:
        posting = posting.join(sources.select(F.col("id").alias("source_id"), "source_key"), "source_id", "left")
    rows = paid.join(posting, "job_id", "left").filter("duplicate_of_job_id is null")
    rows = rows.withColumns({"mid": midpoint(F.col("min_amount"), F.col("max_amount")) * annual_factor(F.col("period")), "seniority": F.coalesce("seniority", "job_seniority")})
    rows = wanted.of(rows)
    group = Window.partitionBy("observation_type", *by)
    rows = rows.withColumns({"rank": F.row_number().over(group.orderBy("mid")), "size": F.count(F.lit(1)).over(group)})

    def percentile(p: float) -> Column:
        at = (F.col("size") - 1) * p
        below, part = F.floor(at) + 1, at - F.floor(at)
        return F.sum(F.when(F.col("rank") == below, F.col("mid") * (1 - part)).when(F.col("rank") == below + 1, F.col("mid") * part))

    enough = F.count(F.lit(1)) >= min_sample
    stat = lambda x, name: F.when(enough, F.floor(x + 0.5).cast("double")).alias(name)
    return rows.groupBy("observation_type", *by).agg(
        F.count(F.lit(1)).alias("sample_size"), stat(F.min("mid"), "lowest"), stat(F.max("mid"), "highest"), stat(percentile(0.5), "median"),
        stat(percentile(0.25), "p25"), stat(percentile(0.75), "p75"), (F.floor(F.avg("confidence") * 100 + 0.5) / 100).alias("mean_confidence"),
    )
