"""Scores of postings against a profile: factors from 0 to 100, weights renormalised over those that apply, and vetoes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.operators.demand import half_up
from vacantia.operators.pay import annual_factor

#: Weights of the factors, of kinds of mention, of skill levels, and ranks of seniority.
WEIGHTS = {"required_skill": 0.14, "technical": 0.18, "experience": 0.10, "seniority": 0.10, "location": 0.10, "compensation": 0.10, "preference": 0.05}
MENTION = {"explicit_required": 1.0, "explicit_preferred": 0.6, "mentioned": 0.3, "expected": 0.4}
LEVELS = {"expert": 1.0, "advanced": 0.85, "intermediate": 0.65, "basic": 0.4, "learning": 0.2}
SENIORITY = {"intern": 0, "junior": 1, "mid": 2, "senior": 3, "staff": 4, "lead": 4, "manager": 4, "principal": 5, "director": 6, "executive": 7}


@dataclass(frozen=True)
class Profile:
    seniority: str
    years: float
    countries: tuple[str, ...]
    employment_types: tuple[str, ...]
    minimum: float
    target: float
    threshold: float = 60.0
    undisclosed: int = 60


PROFILE = Profile("senior", 8.0, ("Germany", "Spain", "Mexico"), ("full_time", "contract"), 60_000.0, 90_000.0)


def profile_levels(skills: DataFrame) -> DataFrame:
    """A profile's skills for the queries: every seventh known well, its neighbours less."""
    level = F.element_at(F.create_map(F.lit(0), F.lit("expert"), F.lit(1), F.lit("intermediate"), F.lit(2), F.lit("basic")), (F.col("id") % 7).cast("int"))
    return skills.filter(F.col("id") % 7 < 3).select(F.col("id").alias("skill_id"), _lookup(LEVELS, level).alias("level"))


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def _hundredths(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("int")


def score(jobs: DataFrame, mentions: DataFrame, pay: DataFrame, levels: DataFrame, profile: Profile) -> DataFrame:
    """One row per posting: its factors (null where one does not apply), overall, vetoes and eligible."""
    named = mentions.filter("skill_id is not null").select("job_id", "skill_id", "mention_type").distinct()
    graded = named.join(levels, "skill_id", "left").withColumns({"level": F.coalesce(_hundredths("level"), F.lit(0)), "w": _lookup({k: round(v * 10) for k, v in MENTION.items()}, F.col("mention_type"))})
    skills = graded.groupBy("job_id").agg(
        F.floor(F.avg(F.when(F.col("mention_type") == "explicit_required", F.col("level"))) + 0.5).alias("required_skill"),
        F.floor(F.sum(F.col("w") * F.col("level")) / F.sum("w") + 0.5).alias("technical"),
    )
    years = mentions.groupBy("job_id").agg(F.max("years_required").alias("years"))
    annual = pay.filter("observation_type = 'explicit' and currency = 'USD' and job_id is not null").groupBy("job_id").agg(F.max(F.col("max_amount") * annual_factor(F.col("period"))).alias("pay"))
    df = jobs.select(F.col("id").alias("job_id"), F.col("seniority").alias("level"), "work_mode", "country", "employment_type")
    df = df.join(skills, "job_id", "left").join(years, "job_id", "left").join(annual, "job_id", "left")

    gap = F.lit(SENIORITY[profile.seniority]) - _lookup(SENIORITY, F.col("level"))
    accepted = F.coalesce(F.col("country").isin(*profile.countries), F.lit(False))
    on_place = F.coalesce(F.col("work_mode").isin("hybrid", "onsite"), F.lit(False))
    ratio = F.lit(profile.years) / F.greatest("years", F.lit(1.0))
    span = profile.target - profile.minimum
    df = df.withColumns(
        {
            "experience": F.when(F.col("years").isNotNull(), F.when(F.col("years") <= profile.years, 100).otherwise(F.floor(ratio * 90 + 0.5))),
            "seniority": F.when(gap == 0, 100).when(gap == -1, 75).when(gap == 1, 85).when(gap <= -2, 40).when(gap.isNotNull(), 45),
            "location": F.when(F.col("work_mode") == "remote", F.when(accepted, 100).otherwise(30)).when(on_place, F.when(accepted, 100).otherwise(10)).otherwise(60),
            "compensation": F.when(F.col("pay").isNull(), profile.undisclosed).when(F.col("pay") < profile.minimum, 0).when(F.col("pay") >= profile.target, 90).otherwise(F.floor(50 + 40 * (F.col("pay") - profile.minimum) / span + 0.5)),
            "preference": F.when(F.coalesce("employment_type", F.lit("unknown")).isin("unknown", *profile.employment_types), 75).otherwise(35),
            "vetoes": F.array_compact(F.array(F.when(F.col("level").isin("intern", "junior"), "junior posting"), F.when(F.col("pay") < profile.minimum, "below minimum pay"), F.when(on_place & ~accepted, "place not accepted"))),
        }
    )
    # whole hundredths, so that a result never hangs on the order of a floating sum
    hundredths = {f: round(w * 100) for f, w in WEIGHTS.items()}
    weight = sum((F.when(F.col(f).isNotNull(), w).otherwise(0) for f, w in hundredths.items()), F.lit(0))
    total = sum((F.coalesce(F.col(f).cast("long") * w, F.lit(0)) for f, w in hundredths.items()), F.lit(0))
    df = df.withColumn("overall", half_up(total / weight))
    return df.withColumn("eligible", (F.col("overall") >= profile.threshold) & (F.size("vetoes") == 0))


def factors_long(scored: DataFrame) -> DataFrame:
    every = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("int").alias("score")) for f in WEIGHTS])
    return scored.select("job_id", F.explode(every).alias("x")).select("job_id", "x.*").filter("score is not null")


def vetoes(scored: DataFrame) -> DataFrame:
    return scored.select("job_id", F.explode("vetoes").alias("veto"))
