"""Demand, pay, market and match queries over postings (joins, aggregates, windows, top-k).

Match scores, applications, runs and research have no table of their own in the data; their
bindings are the common table expressions at the head of this module. Every "now" is AS_OF.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators import demand, pay, ranges, search
from vacantia.plans.sqlplan import oracle, plan, run
from vacantia.session import table

AS_OF = "2025-06-01 00:00:00"
PERIOD_START = "2025-03-01 00:00:00"

#: match_scores from events: one row a scored posting, with ties in time.
MATCHES = """matches AS (SELECT event_id AS match_id, user_id AS job_id, least(value, 100) AS score, event_type IN ('purchase', 'signup') AS eligible,
  event_id % 3 AS profile_version, ts AS scored_at FROM events)"""
#: latest match of each posting by id.
LATEST = "latest AS (SELECT * FROM (SELECT m.*, row_number() OVER (PARTITION BY job_id ORDER BY match_id DESC) AS k FROM matches m) x WHERE k = 1)"
#: applications: the last event of each.
APPLICATIONS = """app_events AS (SELECT event_id, user_id AS job_id, ts AS occurred_at, CASE event_type WHEN 'signup' THEN 'MATCHED' WHEN 'view' THEN 'SELECTED'
    WHEN 'click' THEN 'PREPARING' WHEN 'purchase' THEN 'SUBMITTED' ELSE 'FAILED' END AS to_status FROM events),
  applications AS (SELECT job_id, to_status AS status, occurred_at FROM (SELECT e.*, row_number() OVER (PARTITION BY job_id ORDER BY occurred_at DESC, event_id DESC) AS k FROM app_events e) x WHERE k = 1)"""
#: runs: one a month, over its first twenty days.
RUNS = """runs AS (SELECT row_number() OVER (ORDER BY m) AS run_id, m AS started_us, m + 20 * 86400000000 AS ended_us
  FROM (SELECT DISTINCT MICROS(date_trunc('month', discovered_at)) AS m FROM jobs WHERE discovered_at IS NOT NULL) x)"""
LONG_RUNS = RUNS.replace("m + 20 * 86400000000", "m + CASE WHEN MICROS(AS_TS('2000-01-01 00:00:00')) <= m AND floor(m / 86400000000) % 2 = 0 THEN 20 ELSE 45 END * 86400000000")
RESEARCH = "research AS (SELECT company_id, max(MICROS(fetched_at)) AS researched_us FROM documents WHERE kind = 'company_note' AND company_id IS NOT NULL GROUP BY company_id)"
CANONICAL = "duplicate_of_job_id IS NULL"
ROUND1 = "floor({0} * 10 + 0.5) / 10"

SQL = {
    # The top by demand, less what the candidate has
    "skill_gaps": f"""
      WITH demand AS (SELECT s.id, s.name, count(DISTINCT j.id) AS job_count FROM jobs j JOIN job_skills k ON k.job_id = j.id JOIN skills s ON s.id = k.skill_id
        WHERE j.{CANONICAL} AND k.mention_type LIKE 'explicit%' GROUP BY s.id, s.name ORDER BY job_count DESC, name, id LIMIT 200)
      SELECT name, job_count FROM demand d WHERE NOT EXISTS (SELECT 1 FROM skills o WHERE o.id = d.id AND o.id % 7 = 0) ORDER BY job_count DESC, name LIMIT 25""",
    # A13 J07 J08
    "skill_search": """
      SELECT s.slug, s.name, coalesce(c.job_count, 0) AS job_count FROM skills s
      LEFT JOIN (SELECT skill_id, count(DISTINCT job_id) AS job_count FROM job_skills WHERE skill_id IS NOT NULL GROUP BY skill_id) c ON c.skill_id = s.id
      WHERE s.name LIKE '%a%' OR s.slug IN (SELECT slug FROM skills WHERE category = 'practice') ORDER BY job_count DESC, name, slug LIMIT 25""",
    # A07
    "job_counts": f"SELECT count(*) AS total, count(CASE WHEN {CANONICAL} THEN 1 END) AS canonical, count(duplicate_of_job_id) AS duplicates FROM jobs WHERE discovered_at >= AS_TS('2024-01-01 00:00:00')",
    # Duplicates count here
    "source_stats": f"""
      WITH {MATCHES}, {LATEST},
      j AS (SELECT source_id, count(*) AS discovered, count(CASE WHEN {CANONICAL} THEN 1 END) AS canonical, count(duplicate_of_job_id) AS duplicates,
          count(CASE WHEN status = 'active' THEN 1 END) AS active, count(CASE WHEN status = 'expired' THEN 1 END) AS expired FROM jobs WHERE discovered_at >= AS_TS('2024-01-01 00:00:00') GROUP BY source_id),
      m AS (SELECT j.source_id, count(*) AS scored, count(CASE WHEN l.eligible THEN 1 END) AS eligible FROM jobs j JOIN latest l ON l.job_id = j.id WHERE j.discovered_at >= AS_TS('2024-01-01 00:00:00') GROUP BY j.source_id),
      p AS (SELECT j.source_id, count(DISTINCT j.id) AS with_pay FROM jobs j JOIN compensation_observations c ON c.job_id = j.id WHERE c.observation_type = 'explicit' AND j.discovered_at >= AS_TS('2024-01-01 00:00:00') GROUP BY j.source_id)
      SELECT s.source_key, coalesce(j.discovered, 0) AS discovered, coalesce(j.canonical, 0) AS canonical, coalesce(j.duplicates, 0) AS duplicates, coalesce(j.active, 0) AS active,
        coalesce(j.expired, 0) AS expired, coalesce(m.scored, 0) AS scored, coalesce(m.eligible, 0) AS eligible, coalesce(p.with_pay, 0) AS with_pay
      FROM sources s LEFT JOIN j ON j.source_id = s.id LEFT JOIN m ON m.source_id = s.id LEFT JOIN p ON p.source_id = s.id""",
    # A12
    "companies_needing_research": f"""
      WITH {MATCHES}, {LATEST}, {RESEARCH}
      SELECT c.id AS company_id, c.name, max(l.score) AS best_score, count(DISTINCT j.id) AS postings FROM companies c JOIN jobs j ON j.company_id = c.id JOIN latest l ON l.job_id = j.id
      LEFT JOIN research r ON r.company_id = c.id WHERE l.score >= 40
      GROUP BY c.id, c.name HAVING max(r.researched_us) IS NULL OR max(r.researched_us) < MICROS(AS_TS('{AS_OF}')) - 60 * 86400000000 ORDER BY best_score DESC, company_id LIMIT 20""",
    # Ties in time kept
    "latest_match_ts": f"""
      WITH {MATCHES} SELECT job_id, match_id, score FROM (SELECT m.*, rank() OVER (PARTITION BY job_id ORDER BY scored_at DESC) AS k FROM matches m) x WHERE k = 1""",
    # W02
    "latest_match_id": f"WITH {MATCHES}, {LATEST} SELECT job_id, match_id, score, eligible FROM latest",
    # W07
    "match_history": f"""
      WITH {MATCHES} SELECT job_id, match_id, score, row_number() OVER (PARTITION BY job_id ORDER BY scored_at DESC, match_id DESC) AS place,
        score - lag(score) OVER (PARTITION BY job_id ORDER BY scored_at, match_id) AS change FROM matches""",
    # O02 J02 J08 F07
    "matching_jobs": f"""
      WITH {MATCHES}, {LATEST}, {APPLICATIONS},
      top_pay AS (SELECT job_id, max(max_amount * CASE period WHEN 'year' THEN 1 WHEN 'month' THEN 12 WHEN 'week' THEN 52 WHEN 'day' THEN 260 WHEN 'hour' THEN 2080 END) AS pay
        FROM compensation_observations WHERE observation_type = 'explicit' AND job_id IS NOT NULL GROUP BY job_id)
      SELECT j.id AS job_id, l.score, p.pay FROM jobs j JOIN latest l ON l.job_id = j.id LEFT JOIN applications a ON a.job_id = j.id LEFT JOIN top_pay p ON p.job_id = j.id
      WHERE l.eligible AND j.{CANONICAL} AND (a.job_id IS NULL OR a.status IN ('MATCHED', 'SELECTED', 'PREPARING', 'READY', 'FAILED', 'BLOCKED', 'SKIPPED', 'DISCOVERED', 'REQUIRES_USER_INPUT'))
      ORDER BY l.score DESC, p.pay DESC NULLS LAST, MICROS(j.discovered_at) DESC, j.id LIMIT 50""",
    # F02
    "search_text": "SELECT id AS job_id, title FROM jobs WHERE lower(title) LIKE '%engineer%' OR lower(company_name) LIKE '%engineer%' OR lower(location) LIKE '%engineer%' OR lower(description) LIKE '%engineer%'",
    # F03 J06
    "unscored_jobs": f"WITH {MATCHES} SELECT j.id AS job_id FROM jobs j WHERE j.{CANONICAL} AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.job_id = j.id AND m.profile_version = 1)",
    # A16
    "backlog": f"WITH {MATCHES} SELECT count(*) AS backlog FROM jobs j WHERE j.status = 'active' AND j.{CANONICAL} AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.job_id = j.id)",
    # F06
    "pending_evaluation": f"""
      WITH {MATCHES}, {LATEST}, {APPLICATIONS}
      SELECT j.id AS job_id, l.score FROM jobs j JOIN latest l ON l.job_id = j.id WHERE j.status = 'active' AND l.eligible AND l.score >= 10
        AND NOT EXISTS (SELECT 1 FROM applications a WHERE a.job_id = j.id AND a.status NOT IN ('DISCOVERED', 'MATCHED')) ORDER BY l.score DESC, j.id LIMIT 200""",
    # F08
    "stale_expiry": f"SELECT id AS job_id, CASE WHEN status = 'active' AND MICROS(last_seen_at) < MICROS(AS_TS('{AS_OF}')) - 45 * 86400000000 THEN 'expired' ELSE status END AS new_status FROM jobs",
    # A15
    "table_counts": "SELECT 'jobs' AS name, count(*) AS n FROM jobs UNION ALL SELECT 'job_skills', count(*) FROM job_skills UNION ALL SELECT 'companies', count(*) FROM companies UNION ALL SELECT 'sources', count(*) FROM sources UNION ALL SELECT 'skills', count(*) FROM skills UNION ALL SELECT 'compensation_observations', count(*) FROM compensation_observations",
    # Null-safe identity on eight columns; the first observation stands
    "pay_idempotent": """
      SELECT min(id) AS id, count(*) AS copies FROM compensation_observations
      GROUP BY job_id, company_id, observation_type, min_amount, max_amount, currency, period, source""",
    # Versions of a posting as copies of one external id, with what changed
    "version_history": """
      SELECT id, source_id, external_id, row_number() OVER (PARTITION BY source_id, external_id ORDER BY id) AS version,
        coalesce(title, '') <> coalesce(lag(title) OVER (PARTITION BY source_id, external_id ORDER BY id), '') AS changed FROM jobs WHERE external_id IS NOT NULL""",
}


def _dim(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "jobs"), table(spark, d, "job_skills"), table(spark, d, "skills"), table(spark, d, "sources")


def skill_demand(spark: SparkSession, d: str) -> DataFrame:
    return demand.top(demand.demand(*_dim(spark, d)), 50)


FILTER = demand.Filters(start=PERIOD_START, work_mode="remote", title="engineer", mention_types=("explicit_required", "explicit_preferred"))


def skill_demand_filtered(spark: SparkSession, d: str) -> DataFrame:
    return demand.top(demand.demand(*_dim(spark, d), FILTER), 50)


def skill_growth(spark: SparkSession, d: str) -> DataFrame:
    return demand.growth(*_dim(spark, d), start=PERIOD_START, end=AS_OF)


def skill_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    jobs, mentions, skills, _ = _dim(spark, d)
    return demand.cooccurrence(jobs, mentions, skills, skill_id=3, limit=15)


def pay_stats(spark: SparkSession, d: str) -> DataFrame:
    return pay.statistics(table(spark, d, "compensation_observations"), table(spark, d, "jobs"), [], "USD")


def pay_stats_by_seniority(spark: SparkSession, d: str) -> DataFrame:
    return pay.statistics(table(spark, d, "compensation_observations"), table(spark, d, "jobs"), ["seniority"], "EUR")


#: Counts of all dimensions in one pass; countries limited to the 15 largest.
MARKET = """
  WITH g AS (SELECT work_mode, seniority, employment_type, country, count(*) AS n, grouping_id(work_mode, seniority, employment_type, country) AS gid FROM jobs WHERE duplicate_of_job_id IS NULL
    GROUP BY GROUPING SETS ((work_mode), (seniority), (employment_type), (country), ())),
  named AS (SELECT CASE gid WHEN 7 THEN 'work_mode' WHEN 11 THEN 'seniority' WHEN 13 THEN 'employment_type' WHEN 14 THEN 'country' ELSE 'total' END AS section,
    CASE gid WHEN 15 THEN 'all' ELSE coalesce(work_mode, seniority, employment_type, country, 'unknown') END AS k, n FROM g),
  summed AS (SELECT section, k, sum(n) AS n FROM named GROUP BY section, k)
  SELECT section, k, n FROM (SELECT s.*, row_number() OVER (PARTITION BY section ORDER BY n DESC, k) AS place FROM summed s) x WHERE section <> 'country' OR place <= 15"""
#: The first value that is not null stands, by id; the highest confidence wins.
MENTIONS = """SELECT job_id, skill_id, mention_type, max(confidence) AS confidence, min_by(years_required, CASE WHEN years_required IS NOT NULL THEN id END) AS years_required,
    min_by(evidence, CASE WHEN evidence IS NOT NULL THEN id END) AS evidence, min_by(raw_form, CASE WHEN raw_form IS NOT NULL THEN id END) AS raw_form, count(*) AS merged
  FROM job_skills WHERE skill_id IS NOT NULL GROUP BY job_id, skill_id, mention_type"""
#: Places of the same source's copies of a posting, with their country.
PLACES = """SELECT j.id AS job_id, array_join(array_sort(collect_set(concat(coalesce(d.location, ''), coalesce(concat(' / ', d.country), '')))), '|') AS locations
  FROM jobs j JOIN jobs d ON d.duplicate_of_job_id = j.id AND d.source_id = j.source_id AND d.id <> j.id GROUP BY j.id"""
#: Pay a year in dollars by the rate, in euros by the inverse rate from dollars; there are no cross rates.
FX = """SELECT c.id, c.year * f.usd_per_unit AS usd, CASE c.currency WHEN 'EUR' THEN c.year WHEN 'USD' THEN c.year / e.usd_per_unit END AS eur
  FROM (SELECT id, currency, max_amount * CASE period WHEN 'year' THEN 1 WHEN 'month' THEN 12 WHEN 'week' THEN 52 WHEN 'day' THEN 260 WHEN 'hour' THEN 2080 END AS year FROM compensation_observations
    WHERE period IN ('year', 'month', 'week', 'day', 'hour') AND max_amount IS NOT NULL) c
  JOIN fx_rates f ON f.currency = c.currency CROSS JOIN (SELECT max(usd_per_unit) AS usd_per_unit FROM fx_rates WHERE currency = 'EUR') e"""
#: Skills of a posting, firmest mention first, then by name.
RANKED = """SELECT job_id, name, mention_type, row_number() OVER (PARTITION BY job_id ORDER BY rank DESC, name, skill_id) AS place FROM (
    SELECT k.job_id, k.skill_id, s.name, max_by(k.mention_type, k.r) AS mention_type, max(k.r) AS rank FROM (
      SELECT job_id, skill_id, mention_type, CASE mention_type WHEN 'explicit_required' THEN 4 WHEN 'explicit_preferred' THEN 3 WHEN 'mentioned' THEN 2 ELSE 1 END AS r FROM job_skills WHERE skill_id IS NOT NULL) k
    JOIN skills s ON s.id = k.skill_id GROUP BY k.job_id, k.skill_id, s.name) x"""
#: Patches of a run's numbers add up, other values replace.
STATS = """SELECT month AS run, event_type AS k, floor(sum(value) * 100 + 0.5) / 100 AS total, max_by(props, event_id) AS props FROM (SELECT *, CAST(year(ts) * 100 + month(ts) AS INT) AS month FROM events) e GROUP BY month, event_type"""
#: The newest evaluation without error for a posting's present state and question set; no state is a miss.
CACHE = """WITH j AS (SELECT id, sha2(concat(title, '|', coalesce(seniority, '')), 256) AS state FROM jobs),
  e AS (SELECT event_id, user_id AS job_id, event_type, sha2(concat(j.title, '|', CASE WHEN event_id % 3 = 0 THEN 'older' ELSE coalesce(j.seniority, '') END), 256) AS state, CASE WHEN event_id % 2 = 0 THEN 'short' ELSE 'long' END AS questions
    FROM events JOIN jobs j ON j.id = user_id)
  SELECT j.id AS job_id, q.questions, max(e.event_id) AS cached FROM j CROSS JOIN (SELECT 'short' AS questions UNION ALL SELECT 'long') q
  LEFT JOIN e ON e.job_id = j.id AND e.state = j.state AND e.questions = q.questions AND e.event_type <> 'error' GROUP BY j.id, q.questions"""
OWN = {"market_overview": MARKET, "skill_mentions_merged": MENTIONS, "alternate_locations": PLACES, "fx_convert": FX, "job_skills_ranked": RANKED, "run_stat_merge": STATS, "eval_cache_hits": CACHE}


def matches(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d, f"WITH {MATCHES} SELECT match_id, job_id, score, eligible, profile_version FROM matches")


def search_jobs(spark: SparkSession, d: str) -> DataFrame:
    wanted = search.JobSearch(work_mode="remote", offset=5)
    return wanted.run(table(spark, d, "jobs"), table(spark, d, "sources"), matches(spark, d))


def search_jobs_narrow(spark: SparkSession, d: str) -> DataFrame:
    """Every predicate but unscored."""
    wanted = search.JobSearch(canonical_only=False, status="any", work_mode="remote", discovered_after="2024-06-01 00:00:00", text="E", min_score=1.0, eligible_only=True, limit=900)
    return wanted.run(table(spark, d, "jobs"), table(spark, d, "sources"), matches(spark, d))


def search_jobs_unscored(spark: SparkSession, d: str) -> DataFrame:
    wanted = search.JobSearch(unscored_only=True, profile_version=1, limit=500)
    return wanted.run(table(spark, d, "jobs"), table(spark, d, "sources"), matches(spark, d))


def run_asof_backfill(spark: SparkSession, d: str) -> DataFrame:
    """The run started last among those whose window holds the posting's discovery. Runs start monthly, last 20 or 45 days, so they leave gaps and overlap."""
    jobs = table(spark, d, "jobs").select("id", F.unix_micros("discovered_at").alias("at"))
    runs = run(spark, d, f"WITH {LONG_RUNS} SELECT run_id AS window_id, started_us AS start, ended_us AS end FROM runs")
    found = ranges.newest_window(jobs, runs, 30 * 86_400_000_000)
    return found.select(F.col("id").alias("job_id"), F.col("window_id").alias("run_id"), F.concat(F.lit("VAC-"), F.coalesce("window_id", F.lit(0)).cast("string"), F.lit("."), F.col("id").cast("string")).alias("code"))


PAID = pay.PayFilter(start="2024-01-01 00:00:00", end="2026-01-01 00:00:00", role="e", location="a", work_mode="remote")


def pay_stats_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Through the posting to its source."""
    return pay.statistics(table(spark, d, "compensation_observations"), table(spark, d, "jobs"), ["source_key"], "USD", 1, PAID, table(spark, d, "sources"))


QUERIES = {name: plan(sql) for name, sql in (SQL | OWN).items()} | {
    "search_jobs": search_jobs, "search_jobs_narrow": search_jobs_narrow, "search_jobs_unscored": search_jobs_unscored, "run_asof_backfill": run_asof_backfill, "pay_stats_filtered": pay_stats_filtered,
    "skill_demand": skill_demand, "skill_demand_filtered": skill_demand_filtered, "skill_growth": skill_growth,
    "skill_cooccurrence": skill_cooccurrence, "pay_stats": pay_stats, "pay_stats_by_seniority": pay_stats_by_seniority,
}

_KINDS = ("explicit_required", "explicit_preferred", "mentioned", "expected")
_DEMAND = f"""
  WITH f AS (SELECT j.id FROM jobs j WHERE j.{CANONICAL} {{job}}),
  t AS (SELECT count(*) AS total FROM f)
  SELECT s.slug, s.name, count(DISTINCT k.job_id) AS job_count, count(*) AS mention_count, {", ".join(f"count(CASE WHEN k.mention_type = '{x}' THEN 1 END) AS {x}" for x in _KINDS)},
    {ROUND1.format("count(DISTINCT k.job_id) * 100.0 / max(t.total)")} AS share
  FROM f JOIN job_skills k ON k.job_id = f.id JOIN skills s ON s.id = k.skill_id, t {{mention}}
  GROUP BY s.slug, s.name ORDER BY job_count DESC, mention_count DESC, name LIMIT 50"""
_PAY = """
  WITH o AS (SELECT c.observation_type, {col} c.confidence,
      CASE WHEN c.min_amount IS NULL THEN c.max_amount WHEN c.max_amount IS NULL THEN c.min_amount ELSE (c.min_amount + c.max_amount) / 2 END
        * CASE c.period WHEN 'year' THEN 1 WHEN 'month' THEN 12 WHEN 'week' THEN 52 WHEN 'day' THEN 260 WHEN 'hour' THEN 2080 END AS mid
    FROM compensation_observations c LEFT JOIN jobs j ON j.id = c.job_id
    WHERE c.currency = '{cur}' AND c.period IN ('year', 'month', 'week', 'day', 'hour') AND (j.id IS NULL OR j.duplicate_of_job_id IS NULL) AND (c.min_amount IS NOT NULL OR c.max_amount IS NOT NULL))
  SELECT observation_type, {out} count(*) AS sample_size, CASE WHEN count(*) >= 3 THEN floor(min(mid) + 0.5) END AS lowest, CASE WHEN count(*) >= 3 THEN floor(max(mid) + 0.5) END AS highest,
    CASE WHEN count(*) >= 3 THEN floor(quantile_cont(mid, 0.5) + 0.5) END AS median, CASE WHEN count(*) >= 3 THEN floor(quantile_cont(mid, 0.25) + 0.5) END AS p25,
    CASE WHEN count(*) >= 3 THEN floor(quantile_cont(mid, 0.75) + 0.5) END AS p75, floor(avg(confidence) * 100 + 0.5) / 100 AS mean_confidence
  FROM o GROUP BY observation_type {grp}"""
_SEARCH = f"""WITH {MATCHES}, last AS (SELECT job_id, arg_max(score, match_id) AS score, arg_max(eligible, match_id) AS eligible FROM matches GROUP BY job_id)
  SELECT j.id AS job_id, s.source_key, l.score FROM jobs j JOIN sources s ON s.id = j.source_id LEFT JOIN last l ON l.job_id = j.id WHERE {{where}} ORDER BY coalesce(l.score, -1) DESC, j.discovered_at DESC NULLS LAST, j.id LIMIT {{limit}} OFFSET {{offset}}"""
_M = f"WITH {MATCHES}"
ORACLES = {name: oracle(sql) for name, sql in SQL.items()} | {
    "latest_match_ts": _M + " SELECT job_id, match_id, score FROM matches m WHERE scored_at = (SELECT max(scored_at) FROM matches x WHERE x.job_id = m.job_id)",
    "latest_match_id": _M + " SELECT job_id, max(match_id) AS match_id, arg_max(score, match_id) AS score, arg_max(eligible, match_id) AS eligible FROM matches GROUP BY job_id",
    "match_history": _M + """, h AS (SELECT job_id, list({'at': scored_at, 'id': match_id, 'score': score} ORDER BY scored_at, match_id) AS l FROM matches GROUP BY job_id)
      SELECT job_id, l[i].id AS match_id, l[i].score AS score, len(l) - i + 1 AS place, CASE WHEN i > 1 THEN l[i].score - l[i - 1].score END AS change FROM h, generate_series(1, 100000) g(i) WHERE i <= len(l)""",
    "unscored_jobs": _M + " SELECT id AS job_id FROM jobs WHERE duplicate_of_job_id IS NULL EXCEPT SELECT job_id FROM matches WHERE profile_version = 1",
    "backlog": _M + " SELECT count(*) AS backlog FROM (SELECT id FROM jobs WHERE status = 'active' AND duplicate_of_job_id IS NULL EXCEPT SELECT job_id FROM matches)",
    "job_counts": "SELECT count(*) AS total, count(*) FILTER (WHERE duplicate_of_job_id IS NULL) AS canonical, count(*) FILTER (WHERE duplicate_of_job_id IS NOT NULL) AS duplicates FROM jobs WHERE discovered_at >= TIMESTAMPTZ '2024-01-01 00:00:00+00'",
    "skill_gaps": """
      WITH pairs AS (SELECT DISTINCT k.skill_id, k.job_id FROM job_skills k SEMI JOIN (SELECT id FROM jobs WHERE duplicate_of_job_id IS NULL) j ON j.id = k.job_id WHERE starts_with(k.mention_type, 'explicit')),
      top AS (SELECT s.id, s.name, count(*) AS job_count FROM pairs p JOIN skills s ON s.id = p.skill_id GROUP BY ALL ORDER BY job_count DESC, name, id LIMIT 200)
      SELECT name, job_count FROM top ANTI JOIN (SELECT id FROM skills WHERE id % 7 = 0) o USING (id) ORDER BY job_count DESC, name LIMIT 25""",
    "skill_search": """
      SELECT slug, name, (SELECT count(*) FROM (SELECT DISTINCT job_id FROM job_skills k WHERE k.skill_id = s.id AND job_id IS NOT NULL)) AS job_count FROM skills s
      WHERE contains(name, 'a') OR category = 'practice' ORDER BY job_count DESC, name, slug LIMIT 25""",
    "stale_expiry": f"SELECT id AS job_id, CASE WHEN status = 'active' AND last_seen_at < TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 45 DAY THEN 'expired' ELSE status END AS new_status FROM jobs",
    "pay_idempotent": """
      SELECT min(id) AS id, count(*) AS copies FROM (SELECT id, concat_ws('~', coalesce(job_id::VARCHAR, '?'), coalesce(company_id::VARCHAR, '?'), coalesce(observation_type, '?null'), coalesce(min_amount::VARCHAR, '?'), coalesce(max_amount::VARCHAR, '?'),
        coalesce(currency, '?null'), coalesce(period, '?null'), coalesce(source, '?null')) AS same FROM compensation_observations) x GROUP BY same""",
    "version_history": """
      WITH v AS (SELECT id, source_id, external_id, coalesce(title, '') AS t FROM jobs WHERE external_id IS NOT NULL)
      SELECT id, source_id, external_id, (SELECT count(*) FROM v b WHERE b.source_id IS NOT DISTINCT FROM a.source_id AND b.external_id = a.external_id AND b.id <= a.id) AS version,
        t <> coalesce((SELECT arg_max(b.t, b.id) FROM v b WHERE b.source_id IS NOT DISTINCT FROM a.source_id AND b.external_id = a.external_id AND b.id < a.id), '') AS changed FROM v a""",
    "search_text": "SELECT id AS job_id, title FROM jobs WHERE len([x for x in [title, company_name, location, description] if x ILIKE '%engineer%']) > 0",
    "source_stats": _M + """, j AS (SELECT * FROM jobs WHERE discovered_at >= TIMESTAMPTZ '2024-01-01 00:00:00+00'), l AS (SELECT job_id, arg_max(eligible, match_id) AS eligible FROM matches GROUP BY job_id)
      SELECT s.source_key, (SELECT count(*) FROM j WHERE source_id = s.id) AS discovered, (SELECT count(*) FROM j WHERE source_id = s.id AND duplicate_of_job_id IS NULL) AS canonical,
        (SELECT count(*) FROM j WHERE source_id = s.id AND duplicate_of_job_id IS NOT NULL) AS duplicates, (SELECT count(*) FROM j WHERE source_id = s.id AND status = 'active') AS active, (SELECT count(*) FROM j WHERE source_id = s.id AND status = 'expired') AS expired,
        (SELECT count(*) FROM j JOIN l ON l.job_id = j.id WHERE source_id = s.id) AS scored, (SELECT count(*) FROM j JOIN l ON l.job_id = j.id WHERE source_id = s.id AND l.eligible) AS eligible,
        (SELECT count(*) FROM j WHERE source_id = s.id AND id IN (SELECT job_id FROM compensation_observations WHERE observation_type = 'explicit')) AS with_pay FROM sources s""",
    "market_overview": """
      SELECT 'work_mode' AS section, coalesce(work_mode, 'unknown') AS k, count(*) AS n FROM jobs WHERE duplicate_of_job_id IS NULL GROUP BY 2
      UNION ALL SELECT 'seniority', coalesce(seniority, 'unknown'), count(*) FROM jobs WHERE duplicate_of_job_id IS NULL GROUP BY 2
      UNION ALL SELECT 'employment_type', coalesce(employment_type, 'unknown'), count(*) FROM jobs WHERE duplicate_of_job_id IS NULL GROUP BY 2
      UNION ALL (SELECT 'country', coalesce(country, 'unknown') AS k, count(*) AS n FROM jobs WHERE duplicate_of_job_id IS NULL GROUP BY 2 ORDER BY n DESC, k LIMIT 15)
      UNION ALL SELECT 'total', 'all', count(*) FROM jobs WHERE duplicate_of_job_id IS NULL""",
    "skill_mentions_merged": """
      SELECT job_id, skill_id, mention_type, max(confidence) AS confidence, first(years_required ORDER BY id) FILTER (WHERE years_required IS NOT NULL) AS years_required,
        first(evidence ORDER BY id) FILTER (WHERE evidence IS NOT NULL) AS evidence, first(raw_form ORDER BY id) FILTER (WHERE raw_form IS NOT NULL) AS raw_form, count(*) AS merged
      FROM job_skills WHERE skill_id IS NOT NULL GROUP BY ALL""",
    "alternate_locations": """
      SELECT id AS job_id, locations FROM (SELECT j.id, (SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT DISTINCT coalesce(d.location, '') || coalesce(' / ' || d.country, '') AS x FROM jobs d
        WHERE d.duplicate_of_job_id = j.id AND d.source_id = j.source_id AND d.id <> j.id) y) AS locations FROM jobs j) z WHERE locations IS NOT NULL""",
    "fx_convert": """
      WITH y(period, factor) AS (VALUES ('year', 1), ('month', 12), ('week', 52), ('day', 260), ('hour', 2080))
      SELECT c.id, c.max_amount * y.factor * f.usd_per_unit AS usd, CASE WHEN c.currency = 'EUR' THEN c.max_amount * y.factor WHEN c.currency = 'USD' THEN c.max_amount * y.factor / (SELECT usd_per_unit FROM fx_rates WHERE currency = 'EUR') END AS eur
      FROM compensation_observations c JOIN y USING (period) JOIN fx_rates f USING (currency) WHERE c.max_amount IS NOT NULL""",
    "job_skills_ranked": """
      WITH r(mention_type, rank) AS (VALUES ('explicit_required', 4), ('explicit_preferred', 3), ('mentioned', 2), ('expected', 1)),
      best AS (SELECT DISTINCT ON (job_id, skill_id) job_id, skill_id, k.mention_type, rank FROM job_skills k JOIN r USING (mention_type) WHERE skill_id IS NOT NULL ORDER BY job_id, skill_id, rank DESC)
      SELECT job_id, name, mention_type, row_number() OVER (PARTITION BY job_id ORDER BY rank DESC, name, skill_id) AS place FROM best JOIN skills s ON s.id = skill_id""",
    "run_stat_merge": """
      SELECT CAST(strftime(ts, '%Y%m') AS INT) AS run, event_type AS k, floor(sum(value) * 100 + 0.5) / 100 AS total, last(props ORDER BY event_id) AS props FROM events GROUP BY 1, 2""",
    "eval_cache_hits": """
      SELECT j.id AS job_id, q.questions, (SELECT max(event_id) FROM events e WHERE e.user_id = j.id AND j.title IS NOT NULL AND e.event_type <> 'error' AND (e.event_id % 2 = 0) = (q.questions = 'short')
        AND (e.event_id % 3 <> 0 OR j.seniority = 'older')) AS cached FROM jobs j, (VALUES ('short'), ('long')) q(questions)""",
    "run_asof_backfill": oracle(f"""
      WITH {LONG_RUNS}, f AS (SELECT j.id, (SELECT r.run_id FROM runs r WHERE r.started_us <= MICROS(j.discovered_at) AND r.ended_us >= MICROS(j.discovered_at) ORDER BY r.started_us DESC LIMIT 1) AS run_id FROM jobs j)
      SELECT id AS job_id, run_id, 'VAC-' || coalesce(run_id, 0) || '.' || id AS code FROM f"""),
    "search_jobs": _SEARCH.format(where="j.duplicate_of_job_id IS NULL AND j.status = 'active' AND j.work_mode = 'remote'", limit=50, offset=5),
    "search_jobs_narrow": _SEARCH.format(
        where="j.work_mode = 'remote' AND j.discovered_at >= TIMESTAMPTZ '2024-06-01 00:00:00+00' AND (j.title ILIKE '%e%' OR j.company_name ILIKE '%e%' OR j.location ILIKE '%e%' OR j.description ILIKE '%e%') AND l.score >= 1 AND l.eligible", limit=500, offset=0
    ),
    "search_jobs_unscored": _SEARCH.format(where="j.duplicate_of_job_id IS NULL AND j.status = 'active' AND j.id NOT IN (SELECT job_id FROM matches WHERE profile_version = 1 AND job_id IS NOT NULL)", limit=500, offset=0),
    "skill_demand": _DEMAND.format(job="", mention=""),
    "skill_demand_filtered": _DEMAND.format(
        job=f"AND j.discovered_at >= TIMESTAMPTZ '{PERIOD_START}+00' AND j.work_mode = 'remote' AND contains(lower(j.title), 'engineer')",
        mention="WHERE k.mention_type IN ('explicit_required', 'explicit_preferred')",
    ),
    "skill_growth": f"""
      WITH w AS (SELECT epoch_us(TIMESTAMPTZ '{PERIOD_START}+00') AS s, epoch_us(TIMESTAMPTZ '{AS_OF}+00') AS e),
      f AS (SELECT k.skill_id, k.job_id, epoch_us(j.discovered_at) >= w.s AS cur FROM jobs j JOIN job_skills k ON k.job_id = j.id, w
        WHERE j.{CANONICAL} AND epoch_us(j.discovered_at) < w.e AND epoch_us(j.discovered_at) >= 2 * w.s - w.e),
      c AS (SELECT skill_id, count(DISTINCT CASE WHEN cur THEN job_id END) AS n, count(DISTINCT CASE WHEN NOT cur THEN job_id END) AS p FROM f WHERE skill_id IS NOT NULL GROUP BY skill_id)
      SELECT s.slug, n AS job_count, p AS previous_count, CASE WHEN p > 0 THEN floor((n - p) * 1000.0 / p + 0.5) / 10 END AS growth FROM c JOIN skills s ON s.id = c.skill_id WHERE n > 0""",
    "skill_cooccurrence": f"""
      SELECT s.slug, count(DISTINCT a.job_id) AS jobs FROM job_skills a JOIN job_skills b ON b.job_id = a.job_id AND b.skill_id <> a.skill_id JOIN jobs j ON j.id = a.job_id JOIN skills s ON s.id = b.skill_id
      WHERE a.skill_id = 3 AND j.{CANONICAL} GROUP BY s.slug ORDER BY jobs DESC, s.slug LIMIT 15""",
    "pay_stats_filtered": _PAY.replace(">= 3", ">= 1").replace("LEFT JOIN jobs j ON j.id = c.job_id", "LEFT JOIN jobs j ON j.id = c.job_id LEFT JOIN sources s ON s.id = j.source_id").replace(
        "WHERE c.currency", "WHERE c.observed_at >= TIMESTAMPTZ '2024-01-01 00:00:00+00' AND c.observed_at < TIMESTAMPTZ '2026-01-01 00:00:00+00' AND j.title ILIKE '%e%' AND (j.location ILIKE '%a%' OR j.country ILIKE '%a%') AND j.work_mode = 'remote' AND c.currency"
    ).format(col="s.source_key,", out="source_key,", grp=", source_key", cur="USD"),
    "pay_stats": _PAY.format(col="", out="", grp="", cur="USD"),
    "pay_stats_by_seniority": _PAY.format(col="coalesce(c.seniority, j.seniority) AS seniority,", out="seniority,", grp=", seniority", cur="EUR"),
}
