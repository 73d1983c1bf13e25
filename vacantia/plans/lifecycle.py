"""Applications, runs and schedule: transitions, folds, funnels, quotas, slots, and their streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators import transitions
from vacantia.plans.relational import APPLICATIONS, AS_OF, CANONICAL, LATEST, MATCHES, RUNS
from vacantia.plans.sqlplan import oracle, plan
from vacantia.session import table
from vacantia.streaming import streams

SUBMITTED = "('SUBMITTED', 'RESPONSE_RECEIVED', 'INTERVIEW', 'OFFER', 'ACCEPTED', 'DECLINED', 'NO_RESPONSE')"
_EDGES = "edges AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, ends in transitions.EDGES.items() for b in ends) + ") AS v(from_status, to_status))"
_HISTORY = "history AS (SELECT job_id, event_id, occurred_at, lag(to_status) OVER (PARTITION BY job_id ORDER BY occurred_at, event_id) AS from_status, to_status FROM app_events)"

SQL = {
    # W05
    "event_transitions": f"WITH {APPLICATIONS}, {_HISTORY} SELECT coalesce(from_status, 'none') AS from_status, to_status, count(*) AS n FROM history GROUP BY 1, 2",
    # Edges that the table does not allow
    "illegal_transitions": f"""WITH {APPLICATIONS}, {_HISTORY}, {_EDGES} SELECT h.event_id, h.from_status, h.to_status FROM history h
      WHERE h.from_status IS NOT NULL AND h.from_status <> h.to_status AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.from_status = h.from_status AND e.to_status = h.to_status)""",
    # A10
    "apps_by_status": f"WITH {APPLICATIONS} SELECT status, count(*) AS n FROM applications GROUP BY status",
    "apps_by_source": f"""WITH {APPLICATIONS} SELECT s.source_key, count(*) AS n, count(CASE WHEN a.status IN {SUBMITTED} THEN 1 END) AS submitted, count(CASE WHEN a.status = 'FAILED' THEN 1 END) AS failed
      FROM applications a JOIN jobs j ON j.id = a.job_id JOIN sources s ON s.id = j.source_id GROUP BY s.source_key""",
    "funnel": f"""WITH {MATCHES}, {LATEST}, {APPLICATIONS}
      SELECT (SELECT count(*) FROM jobs) AS discovered, (SELECT count(*) FROM jobs WHERE {CANONICAL}) AS canonical, (SELECT count(*) FROM latest) AS scored, (SELECT count(*) FROM latest WHERE eligible) AS eligible,
        (SELECT count(*) FROM applications) AS applications, (SELECT count(*) FROM applications WHERE status NOT IN ('DISCOVERED', 'MATCHED')) AS selected, (SELECT count(*) FROM applications WHERE status IN {SUBMITTED}) AS submitted""",
    # A11
    "submissions_in_run": f"""WITH {APPLICATIONS}, {RUNS} SELECT r.run_id, j.source_id, count(DISTINCT e.job_id) AS n FROM app_events e JOIN jobs j ON j.id = e.job_id
      JOIN runs r ON MICROS(date_trunc('month', j.discovered_at)) = r.started_us WHERE e.to_status = 'SUBMITTED' GROUP BY r.run_id, j.source_id""",
    # U14
    "no_response": f"WITH {APPLICATIONS} SELECT job_id, CASE WHEN status = 'SUBMITTED' AND MICROS(CAST(occurred_at AS TIMESTAMP)) < MICROS(AS_TS('{AS_OF}')) - 30 * 86400000000 THEN 'NO_RESPONSE' ELSE status END AS new_status FROM applications",
    # Reasons that speak against a submission, one row each
    "submit_preflight": f"""WITH {MATCHES}, {LATEST}, {APPLICATIONS}
      SELECT j.id AS job_id, 'not active' AS reason FROM jobs j WHERE coalesce(j.status, '') <> 'active' UNION ALL
      SELECT j.id, 'duplicate' FROM jobs j WHERE j.duplicate_of_job_id IS NOT NULL UNION ALL
      SELECT j.id, 'source disabled' FROM jobs j JOIN sources s ON s.id = j.source_id WHERE NOT s.enabled UNION ALL
      SELECT j.id, 'not eligible' FROM jobs j JOIN latest l ON l.job_id = j.id WHERE NOT l.eligible UNION ALL
      SELECT j.id, 'already submitted' FROM jobs j JOIN applications a ON a.job_id = j.id WHERE a.status IN {SUBMITTED}""",
    # The top of each source, in the custom order of seniority
    "candidates_by_source": f"""WITH {MATCHES}, {LATEST}
      SELECT source_id, job_id, k FROM (SELECT j.source_id, j.id AS job_id, row_number() OVER (PARTITION BY j.source_id ORDER BY l.score DESC,
        CASE j.seniority WHEN 'executive' THEN 7 WHEN 'director' THEN 6 WHEN 'principal' THEN 5 WHEN 'staff' THEN 4 WHEN 'lead' THEN 4 WHEN 'manager' THEN 4 WHEN 'senior' THEN 3 WHEN 'mid' THEN 2 ELSE 1 END DESC,
        MICROS(j.discovered_at) DESC, j.id) AS k FROM jobs j JOIN latest l ON l.job_id = j.id WHERE j.{CANONICAL} AND l.eligible) x WHERE k <= 3""",
}


def status_fold(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("user_id").alias("job_id"), "event_id", "ts", transitions.status_of(F.col("event_type")).alias("to_status"))
    return transitions.fold(events)


def schedule_slots(spark: SparkSession, d: str) -> DataFrame:
    return transitions.slots(table(spark, d, "sources"), "2025-03-06", 14, ("09:00", "13:30"), grace_minutes=90)


def stream_daily_events(spark: SparkSession, d: str) -> DataFrame:
    return streams.daily_events(spark, d)


QUERIES = {name: plan(sql) for name, sql in SQL.items()} | {"status_fold": status_fold, "schedule_slots": schedule_slots, "stream_daily_events": stream_daily_events}
ORACLES = {name: oracle(sql) for name, sql in SQL.items()} | {
    "schedule_slots": """
      SELECT source_key, strftime(d, '%Y-%m-%d') AS day, t AS time, epoch_us((d + CAST(t || ':00' AS TIME)) AT TIME ZONE zone_name) AS slot_us, epoch_us((d + CAST(t || ':00' AS TIME)) AT TIME ZONE zone_name) + 5400000000 AS grace_us
      FROM sources, (SELECT DATE '2025-03-06' + CAST(i AS INT) AS d FROM range(14) r(i)) days, (VALUES ('09:00'), ('13:30')) v(t)""",
    "stream_daily_events": "SELECT CAST(epoch_us(date_trunc('day', ts)) AS BIGINT) AS day_us, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "status_fold": f"""WITH RECURSIVE {APPLICATIONS}, {_EDGES}, n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY occurred_at, event_id) AS k FROM app_events),
      f AS (SELECT job_id, 0::BIGINT AS k, 'DISCOVERED' AS status, 0 AS accepted FROM (SELECT DISTINCT job_id FROM n) UNION ALL
        SELECT f.job_id, n.k, CASE WHEN e.to_status IS NOT NULL THEN n.to_status ELSE f.status END, f.accepted + CASE WHEN e.to_status IS NOT NULL THEN 1 ELSE 0 END
        FROM f JOIN n ON n.job_id = f.job_id AND n.k = f.k + 1 LEFT JOIN edges e ON e.from_status = f.status AND e.to_status = n.to_status)
      SELECT job_id, arg_max(status, k) AS status, max(accepted) AS accepted FROM f GROUP BY job_id""",
}
