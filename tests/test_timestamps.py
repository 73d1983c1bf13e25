"""Brute force: the same values read one by one with zoneinfo."""

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from vacantia.operators import timestamps

SCHEMA = "feed string, record_id long, source_key string, value string, zone string, locale string, fetched_at timestamp, extra int, v string, c int"


def us(text, zone="UTC", fold=0):
    t = datetime.fromisoformat(text).replace(tzinfo=ZoneInfo(zone), fold=fold)
    return round(t.astimezone(UTC).timestamp() * 1_000_000)


CASES = [
    ("1695285318", "UTC", "en-US", us("2023-09-21 08:35:18")),
    ("1695285318632", "Europe/Berlin", "de-DE", us("2023-09-21 08:35:18.632")),
    ("1728637306798309", "UTC", "en-US", 1728637306798309),
    ("1761115360.369", "UTC", "en-US", 1761115360369000),
    ("2025-03-06T17:33:45+09:30", "UTC", "en-US", us("2025-03-06 08:03:45")),
    ("2023-07-11T03:58:46-0400", "UTC", "en-US", us("2023-07-11 07:58:46")),
    ("20250128T070414Z", "Asia/Tokyo", "en-GB", us("2025-01-28 07:04:14")),
    ("03/04/2025", "America/New_York", "en-US", us("2025-03-04", "America/New_York")),
    ("03/04/2025", "Europe/London", "en-GB", us("2025-04-03", "Europe/London")),
    ("12/18/2023 12:30 AM", "America/Chicago", "en-US", us("2023-12-18 00:30", "America/Chicago")),
    ("7/20/2025 4:53pm", "America/Chicago", "en-US", us("2025-07-20 16:53", "America/Chicago")),
    ("30.05.2024 11:58", "Europe/Berlin", "de-DE", us("2024-05-30 11:58", "Europe/Berlin")),
    ("28. September 2023, 05:25 Uhr", "Europe/Berlin", "de-DE", us("2023-09-28 05:25", "Europe/Berlin")),
    ("2 août 2024 à 01h37", "Europe/Paris", "fr-FR", us("2024-08-02 01:37", "Europe/Paris")),
    ("9 de julho de 2025 às 21:59", "America/Sao_Paulo", "pt-BR", us("2025-07-09 21:59", "America/Sao_Paulo")),
    ("October 5, 2024 02:56", "UTC", "en-US", us("2024-10-05 02:56")),
    ("14 Oct 2024 02:09:17 PST", "UTC", "en-US", us("2024-10-14 10:09:17")),
    ("2024-12-22 09:52:38 [America/New_York]", "UTC", "en-US", us("2024-12-22 09:52:38", "America/New_York")),
    # repeated: the earlier instant; skipped: the offset before the change
    ("2024-11-03 01:30:00", "America/New_York", "en-US", us("2024-11-03 01:30", "America/New_York", 0)),
    ("2024-03-10 02:30:00", "America/New_York", "en-US", us("2024-03-10 07:30")),
    ("Posted 3 Days Ago", "America/Los_Angeles", "en-US", us("2025-05-28", "America/Los_Angeles")),
    ("Publié hier ", "Europe/Paris", "fr-FR", us("2025-05-31", "Europe/Paris")),
    ("Posted 30+ Days Ago", "UTC", "en-US", None), ("Publicado hace más de 30 días", "UTC", "es-ES", None), ("13/32/2024", "UTC", "en-US", None), ("2025-02-30T10:00:00Z", "UTC", "en-US", None),
    ("0000-00-00 00:00:00", "UTC", "en-US", None), ("ASAP", "UTC", "en-US", None), ("", "UTC", "en-US", None), (None, "UTC", "en-US", None), ("2024-01-01 10:00", None, "en-US", None), ("x" * 50_000, "UTC", "en-US", None),
]


def test_against_zoneinfo(spark):
    at = datetime(2025, 6, 1, 5, 0) + timedelta()  # still 31 May on the American coast
    rows = [("f", i, "s" + str(loc), v, z, loc, at, 1, "clash", 2) for i, (v, z, loc, _) in enumerate(CASES)]
    got = {r["record_id"]: r for r in timestamps.normalise(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (v, z, _, want) in enumerate(CASES):
        assert got[i]["utc_us"] == want, (v, z, got[i])
    assert len(got) == len(CASES)


def test_unknown_locale_learns_the_order_and_marks_ties(spark):
    sure = [("f", i, "learns", f"{i + 13}/02/2024", "UTC", None, None, 1, "", 1) for i in range(12)]
    rows = [*sure, ("f", 90, "learns", "03/04/2024", "UTC", None, None, 1, "", 1), ("f", 91, "ties", "03/04/2024", "UTC", None, None, 1, "", 1)]
    got = {r["record_id"]: r for r in timestamps.normalise(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[90]["utc_us"] == us("2024-04-03") and got[90]["status"] == "instant"
    assert got[91]["status"] == "ambiguous" and got[91]["posterior"] == pytest.approx(0.5)


def test_empty(spark):
    assert timestamps.normalise(spark.createDataFrame([], SCHEMA)).count() == 0
