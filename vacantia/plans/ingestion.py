"""Feeds to raw postings, and these into a keyed snapshot with versions. Payloads are built from the feeds' tables, one a row, as a capture would hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators import ingest
from vacantia.plans.texts import _company, _norm, _title
from vacantia.sources import feeds
from vacantia.session import table

#: Feed, its table, and the payload's item over the table's columns.
CAPTURED = (
    ("himalayas", "himalayas_jobs", "to_json(named_struct('jobs', array(named_struct('guid', guid, 'title', title, 'companyName', company_name, 'employmentType', employment_type, 'minSalary', min_salary, 'maxSalary', max_salary, 'salaryPeriod', salary_period, 'currency', currency, 'seniority', seniority, 'locationRestrictions', location_restrictions, 'pubDate', pub_date, 'applicationLink', application_link))))"),
    ("remotive", "remotive_jobs", "to_json(named_struct('jobs', array(named_struct('id', id, 'url', url, 'title', title, 'company_name', company_name, 'job_type', job_type, 'publication_date', publication_date, 'candidate_required_location', candidate_required_location, 'salary', salary, 'tags', tags))))"),
    ("workday", "workday_listings", "to_json(named_struct('company', board, 'jobPostings', array(named_struct('title', title, 'externalPath', external_path, 'locationsText', locations_text, 'postedOn', posted_on))))"),
    ("workingnomads", "workingnomads_jobs", "to_json(array(named_struct('url', url, 'title', title, 'company_name', company_name, 'tags', tags, 'location', location, 'pub_date', pub_date)))"),
)


def captured(spark: SparkSession, d: str) -> DataFrame:
    """Raw postings of all feeds, with the row of their capture."""
    out = None
    for k, (key, name, payload) in enumerate(CAPTURED):
        rows = feeds.postings(table(spark, d, name).select("row_id", F.expr(payload).alias("payload")), key).withColumn("source_id", F.lit(k).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out


def feed_postings(spark: SparkSession, d: str) -> DataFrame:
    used = ("external_id", "title", "company_name", "location", "country", "remote_scope", "work_mode", "seniority", "employment_type", "salary_min", "salary_max", "salary_currency", "salary_period")
    return captured(spark, d).select("source_key", "row_id", *used)


def _records(spark: SparkSession, d: str) -> DataFrame:
    raw = captured(spark, d).withColumns({"id": F.col("row_id"), "seq": F.col("row_id"), "language": F.lit(None).cast("string")})
    return ingest.outcomes(ingest.identified(ingest.normalised(raw)))


def ingest_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What each captured record does to the snapshot."""
    return _records(spark, d).select("source_id", "seq", "root", "outcome")


def ingest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return ingest.snapshot(_records(spark, d)).select("source_id", "root", "external_id", "title", "company_name", "country", "remote_scope", "posted_at", "versions", "first_seq", "last_seq")


def ingest_versions(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).filter("version is not null").select("source_id", "root", "version", "seq", "title")


QUERIES = {f.__name__: f for f in (feed_postings, ingest_outcomes, ingest_snapshot, ingest_versions)}


def _steps(text: str, steps: tuple[tuple[str, str], ...]) -> str:
    return "CASE " + " ".join(f"WHEN lower({text}) LIKE '%{word}%' THEN '{value}'" for word, value in steps) + " END"


_NUMBERS = r"[n for n in [CAST(regexp_extract(x, '[0-9.]+') AS DOUBLE) * CASE WHEN lower(x) LIKE '%k' THEN 1000 ELSE 1 END for x in regexp_extract_all(replace(salary, ',', ''), '(?i)(\d+(?:\.\d+)?\s*k?)', 1)] if n >= 1000]"
_SIGN = r"CASE WHEN regexp_matches(salary, '(?i)usd|\$') THEN 'USD' WHEN regexp_matches(salary, '(?i)eur|€') THEN 'EUR' WHEN regexp_matches(salary, '(?i)gbp|£') THEN 'GBP' WHEN regexp_matches(salary, '(?i)mxn') THEN 'MXN' WHEN regexp_matches(salary, '(?i)cad') THEN 'CAD' END"
_EVERY = r"CASE WHEN regexp_matches(salary, '(?i)hour|/h\b|hr\b') THEN 'hour' WHEN regexp_matches(salary, '(?i)month|/m\b|mes') THEN 'month' ELSE 'year' END"
_SCOPE = "coalesce(nullif(array_to_string(location_restrictions, ', '), ''), 'Worldwide')"
_PAID = "greatest(coalesce(min_salary, 0), coalesce(max_salary, 0)) > 0 AND currency <> ''"
ORACLES = {
    "feed_postings": f"""
      SELECT 'himalayas' AS source_key, row_id, coalesce(guid, application_link) AS external_id, title, company_name, 'Remote (' || {_SCOPE} || ')' AS location, CASE WHEN len(location_restrictions) = 1 THEN location_restrictions[1] END AS country, {_SCOPE} AS remote_scope,
        'remote' AS work_mode, {_steps("array_to_string(seniority, ' ')", feeds.STEPS)} AS seniority, {_steps("employment_type", feeds.EMPLOYMENT)} AS employment_type, CASE WHEN {_PAID} THEN min_salary END AS salary_min, CASE WHEN {_PAID} THEN max_salary END AS salary_max,
        CASE WHEN {_PAID} THEN currency END AS salary_currency, CASE WHEN {_PAID} THEN CASE WHEN lower(salary_period) LIKE '%month%' THEN 'month' WHEN lower(salary_period) LIKE '%hour%' THEN 'hour' ELSE 'year' END END AS salary_period
      FROM himalayas_jobs WHERE title <> '' AND coalesce(application_link, guid) <> ''
      UNION ALL SELECT 'remotive', row_id, CAST(id AS VARCHAR), title, company_name, coalesce(nullif(candidate_required_location, ''), 'Remote'), NULL, coalesce(nullif(candidate_required_location, ''), 'Worldwide'), 'remote', NULL,
        {_steps("job_type", (*feeds.EMPLOYMENT, ("freelance", "freelance")))}, CASE WHEN paid THEN list_min(numbers) END, CASE WHEN paid THEN list_max(numbers) END, CASE WHEN paid THEN sign END, CASE WHEN paid THEN every END
      FROM (SELECT *, len(numbers) > 0 AND sign IS NOT NULL AS paid FROM (SELECT *, {_NUMBERS} AS numbers, {_SIGN} AS sign, {_EVERY} AS every FROM remotive_jobs QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id) = 1) a) b
      UNION ALL SELECT 'workday', row_id, external_path, title, board, locations_text, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM workday_listings
      UNION ALL SELECT 'workingnomads', row_id, coalesce(nullif(regexp_extract(url, '/([0-9]+)/?$', 1), ''), url), title, company_name, nullif(location, ''), NULL, nullif(location, ''), 'remote', NULL, NULL, NULL, NULL, NULL, NULL
      FROM workingnomads_jobs WHERE url <> '' AND title <> ''""",
}
#: Content of a captured record, by the normal forms of what its hash is made of and what the inferred enums come from.
_CONTENT = f"concat_ws('~', {_title('title')}, {_norm('title')}, coalesce({_company('company_name')}, '?'), {_norm('location')}, coalesce(work_mode, '?'), coalesce(employment_type, '?'))"
_TOLD = f"""WITH f AS ({ORACLES["feed_postings"]}),
  c AS (SELECT CASE source_key WHEN 'himalayas' THEN 0 WHEN 'remotive' THEN 1 WHEN 'workday' THEN 2 ELSE 3 END AS source_id, row_id AS seq, external_id, title, {_CONTENT} AS content, f.* FROM f),
  o AS (SELECT *, min(seq) OVER w AS root, lag(content) OVER (PARTITION BY source_id, external_id ORDER BY seq) AS before FROM c WINDOW w AS (PARTITION BY source_id, external_id)),
  told AS (SELECT *, CASE WHEN seq = root THEN 'created' WHEN before = content THEN 'unchanged' ELSE 'updated' END AS outcome FROM o)"""
ORACLES |= {
    "ingest_outcomes": _TOLD + " SELECT source_id, seq, root, outcome FROM told",
    "ingest_versions": _TOLD + r" SELECT source_id, root, row_number() OVER (PARTITION BY source_id, root ORDER BY seq) AS version, seq, trim(regexp_replace(title, '[\s\x{00a0}]+', ' ', 'g')) AS title FROM told WHERE outcome <> 'unchanged'",
}
