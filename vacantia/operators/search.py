"""Search over postings: optional predicates, AND-ed, only those supplied become filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.operators.demand import instant


@dataclass(frozen=True)
class JobSearch:
    """Canonical and active postings unless told otherwise. text is looked for as it is, in title, company, location and description."""

    canonical_only: bool = True
    status: str = "active"  # "any" takes all
    source: str | None = None
    work_mode: str | None = None
    seniority: str | None = None
    company: str | None = None
    country: str | None = None
    discovered_after: str | None = None
    text: str | None = None
    min_score: float | None = None
    eligible_only: bool = False
    unscored_only: bool = False
    profile_version: int | None = None
    limit: int = 50
    offset: int = 0

    def run(self, jobs: DataFrame, sources: DataFrame, matches: DataFrame) -> DataFrame:
        """matches (match_id, job_id, score, eligible, profile_version). One row a posting: job_id, source_key, score, by score, then newest, then id; at most 500."""
        out = jobs
        if self.canonical_only:
            out = out.filter("duplicate_of_job_id is null")
        if self.status != "any":
            out = out.filter(F.col("status") == self.status)
        for column, wanted in (("work_mode", self.work_mode), ("seniority", self.seniority)):
            if wanted:
                out = out.filter(F.col(column) == wanted)
        for column, wanted in (("company_name", self.company), ("country", self.country)):
            if wanted:
                out = out.filter(F.lower(column) == wanted.lower())
        if self.discovered_after:
            out = out.filter(F.col("discovered_at") >= instant(self.discovered_after))
        if self.text:
            out = out.filter(F.greatest(*[F.coalesce(F.contains(F.lower(c), F.lit(self.text.lower())), F.lit(False)) for c in ("title", "company_name", "location", "description")]))
        named = sources.select(F.col("id").alias("source_id"), "source_key")
        out = out.select(F.col("id").alias("job_id"), "source_id", "discovered_at").join(named.filter(F.col("source_key") == self.source) if self.source else named, "source_id")
        latest = matches.groupBy("job_id").agg(F.max_by(F.struct("score", "eligible"), "match_id").alias("m")).select("job_id", "m.*")
        out = out.join(latest, "job_id", "left")
        if self.min_score is not None:
            out = out.filter(F.col("score") >= self.min_score)
        if self.eligible_only:
            out = out.filter("eligible")
        if self.unscored_only:
            scored = matches if self.profile_version is None else matches.filter(F.col("profile_version") == self.profile_version)
            out = out.join(scored.select("job_id"), "job_id", "left_anti")
        ordered = out.orderBy(F.coalesce("score", F.lit(-1.0)).desc(), F.desc_nulls_last("discovered_at"), "job_id")
        return ordered.offset(self.offset).limit(min(self.limit, 500)).select("job_id", "source_key", "score")
