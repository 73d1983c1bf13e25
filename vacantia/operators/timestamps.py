"""Mixed timestamp spellings to one UTC instant.

Every value is read under each format that can parse it; values that several formats
can parse are decided by expectation-maximisation over the format mixture of their
source. The E- and M-steps run on counts per (feed, source, set of valid formats),
which is bounded by sources times sets of formats, never by rows.

Defined results: null, blank, placeholder, open-ended ("30+ days ago") and impossible
values get no instant; a bare number is an epoch only within plausible years; a wall time that a zone repeats is the earlier instant, one it
skips is read with the offset before the change; a value whose best format has a
posterior under `threshold` is marked ambiguous and gets no instant.
"""

from __future__ import annotations

import zoneinfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.session import settle

#: Usual fixed offsets of zone abbreviations, in minutes.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120,
    "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "BRT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420,
    "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
#: Month names as displayed in en, de, fr, es, pt and nl, January first.
MONTHS = (
    "january jan januar jänner janvier janv enero ene janeiro januari",
    "february feb februar février févr fevrier febrero fevereiro fev februari",
    "march mar märz mär mrz mars marzo março marco maart mrt",
    "april apr avril avr abril abr",
    "may mai mayo maio mei",
    "june jun juni juin junio junho",
    "july jul juli juillet juil julio julho",
    "august aug août aout agosto ago augustus",
    "september sep sept septembre septiembre setembro set",
    "october oct oktober okt octobre octubre outubro out",
    "november nov novembre noviembre novembro",
    "december dec dezember dez décembre déc decembre diciembre dic dezembro",
)
#: Words for the current day and the day before.
TODAY = "today|just posted|heute|aujourd'hui|aujourd’hui|hoy|hoje|vandaag"
YESTERDAY = "yesterday|gestern|hier|ayer|ontem|gisteren"
DAYS_AGO = r"(?:(?:hace|há|ha|vor|il y a)\s+(\d{1,4})\s+(?:días?|dias?|tage?n?|jours?)|(\d{1,4})\s+(?:days?|dagen|dag)\s+(?:ago|geleden))"
#: Wordings that name no single day.
OPEN_ENDED = r"\d\s*\+|más de|mas de|plus de|mehr als|more than|over \d|mais de|meer dan"
MONTH_FIRST = ("en-US", "en-PH", "en-CA")
DAY_US = 86_400_000_000
#: Years between which a bare number is taken for an epoch; written dates may have any year from 1 to 9999.
_FIRST_YEAR, _LAST_YEAR = 1971, 2099
_SPACE = r"[\s\u00a0\u2007\u202f]+"

_ZONE = r"(?:\s*(Z|z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]{2,5}|\[?[A-Z][A-Za-z]+(?:/[A-Za-z_+-]+){1,2}\]?|\[[A-Za-z]{2,5}\]))?"
_TIME = r"(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([AaPp])\.?[Mm]\.?)?(?:\s+Uhr)?"
_WEEKDAY = r"(?:\p{L}{2,10}\.?,\s+)?"
_MARK = "\u0001"
#: Calendar families: pattern, and the groups that hold year, month, day; time and zone follow from the given group on.
FAMILIES = (
    ("ymd", rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:(?:T|\s+){_TIME}{_ZONE})?$", (1, 3, 4), 5),
    ("numeric", rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}})(?:,?\s+{_TIME}{_ZONE})?$", (4, 1, 3), 5),
    ("named", rf"^{_WEEKDAY}(\d{{1,2}})(?:\.|er|st|nd|rd|th)?\s+(?:de\s+)?(\p{{L}}{{3,12}})\.?,?\s+(?:de\s+)?(\d{{4}})(?:(?:,|\s+à|\s+às|\s+at|\s+um)?\s+{_TIME}{_ZONE})?$", (3, 2, 1), 4),
    ("named", rf"^{_WEEKDAY}(\p{{L}}{{3,12}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:(?:,|\s+at)?\s+{_TIME}{_ZONE})?$", (3, 1, 2), 4),
    ("compact", r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?()(Z|z|[+-]\d{4})?$", (1, 2, 3), 4),
)
_EPOCH = r"^(\d{8,17})(?:\.(\d{1,9}))?$"


def known_zones() -> list[str]:
    """Region names that both the driver's and the JVM's tables are sure to hold."""
    areas = ("Africa", "America", "Antarctica", "Asia", "Atlantic", "Australia", "Europe", "Indian", "Pacific", "Etc")
    newer = {"America/Coyhaique"}
    return sorted({z for z in zoneinfo.available_timezones() if z.split("/")[0] in areas and "/" in z} - newer | {"UTC"})


def _known(zone: Column) -> Column:
    return zone.isin(known_zones())


def to_utc(wall: Column, zone: Column) -> Column:
    """Wall micros in a region's time to UTC micros: earlier instant if repeated, offset before the change if skipped."""
    return F.when(_known(zone), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone)))


def _int(col: Column) -> Column:
    return F.when(col != "", col.cast("int"))


def _family_fields(v: Column) -> Column:
    """One regular expression per family: its name and nine fields, in one marked string."""
    out = F.lit(None).cast("string")
    for name, pattern, date, first in reversed(FAMILIES):
        groups = [*date, *range(first, first + 6)]
        out = F.when(v.rlike(pattern), F.regexp_replace(v, pattern, _MARK.join([name, *[f"${g}" for g in groups]]))).otherwise(out)
    return F.split(out, _MARK, -1)


def parse_candidates(values: DataFrame) -> DataFrame:
    """Adds c: every (format, utc_us) under which value can be read. Formats that a known locale rules out don't count.

    Staged in projections, so that each regular expression runs once a row.
    """
    month_of = F.create_map(*[F.lit(x) for n, names in enumerate(MONTHS, 1) for name in names.split() for x in (name, n)])
    offset_of = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    edge = rf'(?:{_SPACE}|")+'
    v = F.col("v")
    df = values.withColumn("v", F.regexp_replace(F.regexp_replace("value", rf"^{edge}|{edge}$", ""), _SPACE, " "))
    df = df.withColumn("f", _family_fields(v)).withColumn("e", F.when(v.rlike(_EPOCH), F.split(v, r"\.")))
    f = lambda i: F.coalesce(F.col("f")[i], F.lit(""))
    zone, digits = F.regexp_replace(f(9), r"[\[\]]", ""), F.regexp_replace(f(9), "[^0-9]", "")
    hour = F.coalesce(_int(f(4)), F.lit(0))
    df = df.select(
        *values.columns,
        "v",
        "e",
        F.col("f")[0].alias("kind"),
        _int(f(1)).alias("y"),
        F.when(f(2).rlike("^[0-9]+$"), _int(f(2))).otherwise(month_of[F.lower(f(2))]).alias("m"),
        _int(f(3)).alias("d"),
        F.when(f(8) == "", F.when(hour < 24, hour)).when(hour.between(1, 12), F.pmod(hour, F.lit(12)) + F.when(F.lower(f(8)) == "p", 12).otherwise(0)).alias("h"),
        F.coalesce(_int(f(5)), F.lit(0)).alias("mi"),
        F.coalesce(_int(f(6)), F.lit(0)).alias("s"),
        F.rpad(F.substring(f(7), 1, 6), 6, "0").cast("long").alias("us"),
        F.when(f(9).rlike("^[+-]"), F.when(f(9).startswith("-"), -1).otherwise(1) * (F.substring(digits, 1, 2).cast("int") * 60 + F.coalesce(_int(F.substring(digits, 3, 2)), F.lit(0))))
        .when((f(9) != "") & ~f(9).contains("/"), offset_of[F.upper(zone)])
        .alias("offset"),
        F.when(zone.contains("/"), zone).when(f(9) == "", F.col("zone")).alias("region"),
    )
    time = F.when((F.col("mi") < 60) & (F.col("s") < 60), F.col("h").cast("long") * 3_600_000_000 + F.col("mi").cast("long") * 60_000_000 + F.col("s").cast("long") * 1_000_000 + F.col("us"))

    def wall(month: str, day: str) -> Column:
        text = F.format_string("%04d-%02d-%02d", F.col("y"), F.col(month), F.col(day))
        real = F.col("y").between(1, 9999) & F.col(month).between(1, 12) & F.col(day).between(1, 31)
        return F.unix_date(F.when(real, F.try_to_date(text, "yyyy-MM-dd"))).cast("long") * DAY_US + time

    phrase = F.lower("v")
    ago = F.concat(F.regexp_extract(phrase, DAYS_AGO, 1), F.regexp_extract(phrase, DAYS_AGO, 2))
    back = (
        F.when(F.col("kind").isNotNull() | F.col("e").isNotNull() | phrase.rlike(OPEN_ENDED), None)
        .when(ago != "", ago.cast("int"))
        .when(phrase.rlike(rf"(?:^|\s)(?:{TODAY})(?:\s|$)"), 0)
        .when(phrase.rlike(rf"(?:^|\s)(?:{YESTERDAY})(?:\s|$)"), 1)
    )
    df = df.withColumns({"w1": wall("m", "d"), "w2": F.when(F.col("kind") == "numeric", wall("d", "m")), "back": back, "home": F.when(_known(F.col("zone")), F.col("zone"))})

    instant = lambda w: F.when(F.col("offset").isNotNull(), F.when(F.abs("offset") <= 14 * 60, F.col(w) - F.col("offset").cast("long") * 60_000_000)).otherwise(to_utc(F.col(w), F.col("region")))
    day = F.date_sub(F.to_date(F.from_utc_timestamp("fetched_at", F.col("home"))), F.col("back"))
    df = df.withColumns({"i1": instant("w1"), "i2": F.when(F.col("kind") == "numeric", instant("w2")), "relative": to_utc(F.unix_date(day).cast("long") * DAY_US, F.col("home"))})

    whole, part, long = F.col("e")[0].cast("long"), F.rpad(F.substring(F.coalesce(F.get("e", F.lit(1)), F.lit("0")), 1, 6), 6, "0"), F.length(F.col("e")[0])
    epochs = {
        "epoch_s": F.when(long <= 11, whole * 1_000_000 + part.cast("long")),
        "epoch_ms": F.when(long.between(11, 14), whole * 1_000 + F.substring(part, 1, 3).cast("long")),
        "epoch_us": F.when(long >= 14, whole),
    }
    low, high = (_FIRST_YEAR - 1970) * 365 * DAY_US, (_LAST_YEAR - 1969) * 366 * DAY_US
    month_first, numeric = F.col("locale").isin(*MONTH_FIRST), F.col("kind") == "numeric"
    found = {
        **{k: F.when(F.col("kind") == k, F.col("i1")) for k in ("ymd", "named", "compact")},
        "mdy": F.when(numeric & (F.col("locale").isNull() | month_first), F.col("i1")),
        "dmy": F.when(numeric & (F.col("locale").isNull() | ~month_first), F.col("i2")),
        **{k: F.when(x.between(low, high), x) for k, x in epochs.items()},
        "relative": F.col("relative"),
    }
    every = F.array(*[F.struct(F.lit(k).alias("format"), x.alias("utc_us")) for k, x in found.items()])
    return df.select(*values.columns, F.filter(every, lambda x: x["utc_us"].isNotNull()).alias("c"))


def mixture_posteriors(counts: pd.DataFrame, rounds: int = 10_000, smoothing: float = 0.5) -> pd.DataFrame:
    """EM for one source, to convergence: rows are sets of valid formats with their counts; returns the best format of each set."""
    sets = [s.split("|") for s in counts["formats"]]
    names = sorted({f for s in sets for f in s})
    valid = np.array([[f in s for f in names] for s in sets], dtype=float)
    n = counts["n"].to_numpy(dtype=float)
    weight = np.full(len(names), 1.0 / len(names))
    post = valid
    for _ in range(rounds):
        post = valid * weight
        post /= post.sum(axis=1, keepdims=True)
        new = (post * n[:, None]).sum(axis=0) + smoothing / len(names)
        new /= new.sum()
        if np.abs(new - weight).max() < 1e-9:
            break
        weight = new
    best = post.argmax(axis=1)
    return counts[["feed", "source_key", "formats"]].assign(best=[names[i] for i in best], posterior=post[np.arange(len(sets)), best])


def normalise(values: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(feed, record_id, source_key, value, zone, locale, fetched_at) to one row each with format, utc_us, posterior, status.

    status: instant, ambiguous, or none. Nulls in any column give none, except a null
    locale, under which both day orders count as valid parses.
    """
    values = values.select("feed", "record_id", "source_key", "value", "zone", "locale", "fetched_at")
    parsed = parse_candidates(values).select("feed", "record_id", F.coalesce("source_key", F.lit("")).alias("source_key"), "c")
    # read twice, by the counts and by the choice: parsed once, and no filter is pushed into the parsing
    parsed = settle(parsed.withColumn("formats", F.array_join(F.transform("c", lambda x: x["format"]), "|")), "timestamps")
    counts = parsed.filter("formats <> ''").groupBy("feed", "source_key", "formats").agg(F.count(F.lit(1)).alias("n"))
    chosen = counts.groupBy("feed", "source_key").applyInPandas(
        lambda pdf: mixture_posteriors(pdf), "feed string, source_key string, formats string, best string, posterior double"
    )
    # one row per source and set of formats; boards count as sources, so no broadcast is forced
    out = parsed.join(chosen, ["feed", "source_key", "formats"], "left")
    picked = F.get(F.filter("c", lambda x: x["format"] == F.col("best")), F.lit(0))["utc_us"]
    same = F.size(F.array_distinct(F.transform("c", lambda x: x["utc_us"]))) <= 1
    sure = (F.col("posterior") >= threshold) | same
    return out.select(
        "feed",
        "record_id",
        "source_key",
        F.col("best").alias("format"),
        F.when(sure, picked).alias("utc_us"),
        "posterior",
        F.size("c").alias("readings"),
        F.when(F.col("best").isNull(), "none").when(sure, "instant").otherwise("ambiguous").alias("status"),
    )
