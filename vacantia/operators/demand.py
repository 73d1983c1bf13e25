"""Skill demand, growth and co-occurrence over canonical postings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("explicit_required", "explicit_preferred", "mentioned", "expected")


def instant(text: str) -> Column:
    return F.expr(f"timestamp'{text} UTC'")


@dataclass(frozen=True)
class Filters:
    """Optional, AND-ed; only those supplied become predicates. Periods are half open."""

    start: str | None = None
    end: str | None = None
    source: str | None = None
    seniority: str | None = None
    work_mode: str | None = None
    country: str | None = None
    title: str | None = None
    mention_types: tuple[str, ...] = ()
    category: str | None = None

    def postings(self, jobs: DataFrame, sources: DataFrame) -> DataFrame:
        out = jobs.filter("duplicate_of_job_id is null")
        if self.start:
            out = out.filter(F.col("discovered_at") >= instant(self.start))
        if self.end:
            out = out.filter(F.col("discovered_at") < instant(self.end))
        if self.source:
            one = sources.filter(F.col("source_key") == self.source).select(F.col("id").alias("source_id"))
            out = out.join(F.broadcast(one), "source_id", "left_semi")  # at most one row
        if self.seniority:
            out = out.filter(F.col("seniority") == self.seniority)
        if self.work_mode:
            out = out.filter(F.col("work_mode") == self.work_mode)
        if self.country:
            out = out.filter(F.lower("country") == self.country.lower())
        if self.title:
            out = out.filter(F.lower("title").contains(self.title.lower()))
        return out


def half_up(x: Column, digits: int = 1) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def demand(jobs: DataFrame, mentions: DataFrame, skills: DataFrame, sources: DataFrame, f: Filters = Filters()) -> DataFrame:
    """Per skill: postings, mentions by kind, and share of all filtered postings (whatever the mention filters).

    Mentions are summed per posting and skill first, so that one hot skill shuffles partial counts.
    """
    postings = f.postings(jobs, sources).select(F.col("id").alias("job_id"))
    rows = mentions.filter("skill_id is not null").select("job_id", "skill_id", "mention_type")
    if f.mention_types:
        rows = rows.filter(F.col("mention_type").isin(*f.mention_types))
    # one row a posting and skill; counting postings then needs no distinct
    per = rows.groupBy("job_id", "skill_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("mention_type") == k).alias(k) for k in KINDS])
    per = per.join(postings, "job_id")
    sums = per.groupBy("skill_id").agg(F.count(F.lit(1)).alias("job_count"), F.sum("n").alias("mention_count"), *[F.sum(k).alias(k) for k in KINDS])
    named = skills.select(F.col("id").alias("skill_id"), "slug", "name", "category")
    if f.category:
        named = named.filter(F.col("category") == f.category)
    total = postings.agg(F.count(F.lit(1)).alias("total"))  # a single row
    out = sums.join(named, "skill_id").join(F.broadcast(total), F.lit(True))
    return out.select("slug", "name", "job_count", "mention_count", *KINDS, half_up(F.col("job_count") * 100.0 / F.col("total")).alias("share"))


def top(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(F.desc("job_count"), F.desc("mention_count"), "name").limit(limit)


def growth(jobs: DataFrame, mentions: DataFrame, skills: DataFrame, sources: DataFrame, start: str, end: str) -> DataFrame:
    """Postings a skill has in [start, end) and in the period of the same length before, from one pass over both."""
    s, e = F.unix_micros(instant(start)), F.unix_micros(instant(end))
    at = F.unix_micros("discovered_at")
    both = jobs.filter("duplicate_of_job_id is null").filter((at < e) & (at >= 2 * s - e)).select(F.col("id").alias("job_id"), (at >= s).alias("current"))
    pairs = mentions.filter("skill_id is not null").select("job_id", "skill_id").distinct().join(both, "job_id")
    counts = pairs.groupBy("skill_id").agg(F.count_if("current").alias("job_count"), F.count_if(~F.col("current")).alias("previous_count")).filter("job_count > 0")
    rate = F.when(F.col("previous_count") > 0, half_up((F.col("job_count") - F.col("previous_count")) * 100.0 / F.col("previous_count")))
    return counts.join(skills.select(F.col("id").alias("skill_id"), "slug"), "skill_id").select("slug", "job_count", "previous_count", rate.alias("growth"))


def cooccurrence(jobs: DataFrame, mentions: DataFrame, skills: DataFrame, skill_id: int, limit: int = 15) -> DataFrame:
    """Other skills of the canonical postings that name the skill, by number of postings."""
    pairs = mentions.filter("skill_id is not null").select("job_id", "skill_id").distinct()
    mine = pairs.filter(F.col("skill_id") == skill_id).select("job_id")
    canonical = jobs.filter("duplicate_of_job_id is null").select(F.col("id").alias("job_id"))
    others = pairs.filter(F.col("skill_id") != skill_id).join(mine, "job_id", "left_semi").join(canonical, "job_id", "left_semi")
    counts = others.groupBy("skill_id").agg(F.count(F.lit(1)).alias("jobs"))
    return counts.join(skills.select(F.col("id").alias("skill_id"), "slug"), "skill_id").select("slug", "jobs").orderBy(F.desc("jobs"), "slug").limit(limit)
