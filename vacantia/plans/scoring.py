"""Weighted, explainable scoring of postings against a profile, with vetoes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacantia.operators import scoring
from vacantia.session import table


def _scored(spark: SparkSession, d: str) -> DataFrame:
    levels = scoring.profile_levels(table(spark, d, "skills"))
    return scoring.score(table(spark, d, "jobs"), table(spark, d, "job_skills"), table(spark, d, "compensation_observations"), levels, scoring.PROFILE)


def score_factors(spark, d):
    return scoring.factors_long(_scored(spark, d))


def score_overall(spark, d):
    return _scored(spark, d).select("job_id", "overall", "eligible")


def hard_constraints(spark, d):
    return scoring.vetoes(_scored(spark, d))


QUERIES = {f.__name__: f for f in (score_factors, score_overall, hard_constraints)}
_LEVEL = "CASE k.skill_id % 7 WHEN 0 THEN 100 WHEN 1 THEN 65 WHEN 2 THEN 40 ELSE 0 END"
_WEIGHT = "CASE k.mention_type WHEN 'explicit_required' THEN 10 WHEN 'explicit_preferred' THEN 6 WHEN 'mentioned' THEN 3 ELSE 4 END"
_RANK = "CASE j.seniority WHEN 'intern' THEN 0 WHEN 'junior' THEN 1 WHEN 'mid' THEN 2 WHEN 'senior' THEN 3 WHEN 'staff' THEN 4 WHEN 'lead' THEN 4 WHEN 'manager' THEN 4 WHEN 'principal' THEN 5 WHEN 'director' THEN 6 WHEN 'executive' THEN 7 END"
_BASE = f"""
  WITH m AS (SELECT DISTINCT job_id, skill_id, mention_type FROM job_skills WHERE skill_id IS NOT NULL),
  s AS (SELECT k.job_id, floor(avg(CASE WHEN k.mention_type = 'explicit_required' THEN {_LEVEL} END) + 0.5) AS required_skill, floor(sum({_WEIGHT} * {_LEVEL}) / sum({_WEIGHT}) + 0.5) AS technical FROM m k GROUP BY k.job_id),
  y AS (SELECT job_id, max(years_required) AS years FROM job_skills GROUP BY job_id),
  p AS (SELECT job_id, max(max_amount * CASE period WHEN 'year' THEN 1 WHEN 'month' THEN 12 WHEN 'week' THEN 52 WHEN 'day' THEN 260 WHEN 'hour' THEN 2080 END) AS pay FROM compensation_observations
    WHERE observation_type = 'explicit' AND currency = 'USD' AND job_id IS NOT NULL GROUP BY job_id),
  f AS (SELECT j.id AS job_id, s.required_skill, s.technical,
    CASE WHEN y.years IS NOT NULL THEN CASE WHEN 8 >= y.years THEN 100 ELSE floor(8 / greatest(y.years, 1) * 90 + 0.5) END END AS experience,
    CASE WHEN {_RANK} IS NOT NULL THEN CASE 3 - {_RANK} WHEN 0 THEN 100 WHEN -1 THEN 75 WHEN 1 THEN 85 ELSE CASE WHEN 3 - {_RANK} <= -2 THEN 40 ELSE 45 END END END AS seniority,
    CASE WHEN j.work_mode = 'remote' THEN CASE WHEN j.country IN ('Germany', 'Spain', 'Mexico') THEN 100 ELSE 30 END WHEN j.work_mode IN ('hybrid', 'onsite') THEN CASE WHEN j.country IN ('Germany', 'Spain', 'Mexico') THEN 100 ELSE 10 END ELSE 60 END AS location,
    CASE WHEN p.pay IS NULL THEN 60 WHEN p.pay < 60000 THEN 0 WHEN p.pay >= 90000 THEN 90 ELSE floor(50 + 40 * (p.pay - 60000) / 30000 + 0.5) END AS compensation,
    CASE WHEN j.employment_type IN ('full_time', 'contract') OR coalesce(j.employment_type, 'unknown') = 'unknown' THEN 75 ELSE 35 END AS preference, j.seniority AS level, p.pay, j.work_mode, j.country
    FROM jobs j LEFT JOIN s ON s.job_id = j.id LEFT JOIN y ON y.job_id = j.id LEFT JOIN p ON p.job_id = j.id),
  long AS (SELECT job_id, factor, weight, score FROM (
    SELECT job_id, 'required_skill' AS factor, 14 AS weight, required_skill AS score FROM f UNION ALL SELECT job_id, 'technical', 18, technical FROM f UNION ALL SELECT job_id, 'experience', 10, experience FROM f UNION ALL
    SELECT job_id, 'seniority', 10, seniority FROM f UNION ALL SELECT job_id, 'location', 10, location FROM f UNION ALL SELECT job_id, 'compensation', 10, compensation FROM f UNION ALL SELECT job_id, 'preference', 5, preference FROM f) WHERE score IS NOT NULL),
  v AS (SELECT job_id, 'junior posting' AS veto FROM f WHERE level IN ('intern', 'junior') UNION ALL SELECT job_id, 'below minimum pay' FROM f WHERE pay < 60000 UNION ALL
    SELECT job_id, 'place not accepted' FROM f WHERE work_mode IN ('hybrid', 'onsite') AND (country IS NULL OR country NOT IN ('Germany', 'Spain', 'Mexico')))"""
ORACLES = {
    "score_factors": _BASE + " SELECT job_id, factor, CAST(score AS INT) AS score FROM long",
    "score_overall": _BASE + """ SELECT l.job_id, floor(sum(score * weight) / sum(weight) * 10 + 0.5) / 10 AS overall,
      floor(sum(score * weight) / sum(weight) * 10 + 0.5) / 10 >= 60 AND l.job_id NOT IN (SELECT job_id FROM v) AS eligible FROM long l GROUP BY l.job_id""",
    "hard_constraints": _BASE + " SELECT job_id, veto FROM v",
}
