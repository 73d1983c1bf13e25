"""What the body of a posting says about place, time zone, office, authorisation and duties, each with its sentence. Columns only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.operators import extract

#: Places that a restriction must name before it is believed.
PLACES = (
    "united states|usa|u\\.s\\.|us|canada|ontario|quebec|british columbia|alberta|mexico|méxico|ireland|united kingdom|uk|england|scotland|germany|france|spain|portugal|netherlands|poland|czechia|"
    "czech republic|romania|italy|sweden|switzerland|austria|belgium|denmark|finland|norway|estonia|croatia|india|brazil|argentina|colombia|chile|peru|australia|new zealand|japan|singapore|philippines|"
    "israel|south africa|europe|eu|european union|emea|apac|latam|latin america|north america|americas|california|new york|texas|washington|massachusetts|new jersey|colorado|east coast|west coast"
)
#: Wordings without any restriction, and words at which a captured place ends.
EVERYWHERE = r"\b(worldwide|anywhere|global(?:ly)?|any country|all countries)\b"
PLACE_ENDS = r"\b(?:and we|we |who |with |to |for |if |so |but |please)\b"
#: How a posting restricts where its people may live, in order; group 1 is the place.
SCOPES = (
    r"\bremotely? (?:only )?for (?:candidates|applicants|people|those) (?:located|based|residing|living) in (?:the )?([^.;\n]{2,70})",
    r"\b(?:must|need to|required to) (?:be )?(?:located|based|reside|residing|live|living) (?:in|within) (?:the )?([^.;\n]{2,60})",
    r"\b(?:be|are) (?:located|based) anywhere (?:in|within|across) (?:the )?([^.;\n]{2,60})",
    r"\blocation:[ \t]*remote[ \t]*[-–,(]?[ \t]*([A-Z][A-Za-z .,&-]{1,50})",
    r"\bremote (?:work )?(?:arrangement|position|role|option)?\s*(?:is )?(?:only )?(?:within|in) the (US|U\.S\.|USA|United States|UK|EU)\b",
    r"\bopen (?:only )?to (?:candidates|applicants) (?:located |based )?in (?:the )?([^.;\n]{2,60}?) only\b",
    r"\b((?:US|U\.S\.|Canada|UK|EU))[- ]based (?:candidates|applicants|employees|residents) only\b",
    r"\bremote\s*\(\s*((?:US|USA|U\.S\.|Canada|UK|EU|Europe)(?:\s*(?:\/|&|and|or)\s*(?:US|USA|Canada|UK|EU|Europe))?)(?:\s*only)?\s*\)",
    r"\b(?:eligib(?:le|ility)|authori[sz](?:ed|ation)) to work in (?:the )?([^.;\n]{2,40}?) (?:is )?required\b",
    r"\bopen to remote (?:work )?(?:with)?in (?:the )?([^.;\n]{2,40}?) only\b",
    r"\bheadquarters:[ \t]*remote(?:,[ \t]*|[ \t]+|-)([A-Z][A-Za-z .,-]{1,50})",
)
#: Standard offsets of the zones postings name, in hours, and how a window around one is worded.
ZONES = {
    "cet": 1, "cest": 1, "eet": 2, "eest": 2, "wet": 0, "gmt": 0, "utc": 0, "bst": 0, "est": -5, "edt": -5, "et": -5, "eastern": -5, "cst": -6, "central": -6, "mst": -7, "mountain": -7,
    "pst": -8, "pdt": -8, "pt": -8, "pacific": -8,
}
ZONE_WINDOW = (
    r"\b(?:located|based|working|work|live|living|reside) (?:with)?in (?:the )?(CET|CEST|EET|EEST|WET|GMT|UTC|BST|EST|EDT|ET|Eastern|CST|Central|MST|Mountain|PST|PDT|PT|Pacific)"
    r"(?: (?:standard )?time)?(?: ?zone)?\s*\(?\s*(?:\+\/-|\+-|±|plus or minus)\s*(\d{1,2})\s*h(?:ours?|rs?)?\)?"
)
REFUSES = r"\b(unable to consider|cannot consider|can't consider|will not consider|won't consider|not able to consider|only consider|only accept|must be)\b"
#: Wordings of a legal entity, of days in the office, of pay for one country, and of the right to work.
ENTITY = r"\b(?:any|every) country where we (?:have|operate|maintain) a (?:legal )?entity\b"
OFFICE = r"\b(?:(?:into|in|at) (?:the|our) office[^.;\n]{0,30}?\b(\d|one|two|three|four|five) days?\b|\b(\d|one|two|three|four|five) days? (?:a|per|each) week (?:in|at) (?:the|our) office)"
COUNTRY_PAY = (
    r"\b(?:(US|U\.S\.|United States|Canada|Canadian|UK|EU)[- ](?:based )?(?:base )?(?:salary|pay|compensation)|(?:for|in) the (United States|US)\b[^.]{0,60}\b(?:pay|compensation|salary)"
    r"|compensation for (US|Canada|UK)[- ]based candidates)"
)
AUTHORISED = (
    r"\b(must be (?:legally )?(?:authorized|authorised|eligible) to work(?: in| within)? ([^.;]{0,60})|work authorization|right to work(?: in)? ([^.;]{0,60})|visa sponsorship (?:is )?(?:not )?"
    r"(?:available|provided|offered)|no sponsorship|we (?:do not|don't) sponsor|(?:us|u\.s\.) citizens? only|eu residency required)"
)


def ascii_words(pattern: str) -> str:
    """A pattern without regard to case, whose word bounds are those of ASCII words."""
    bound = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    return "(?i)" + re.sub(r"\\b", lambda _: bound, pattern)


def collapsed(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[\s ]+", " "), F.lit(" "))


def sentence(text: Column, pattern: str, length: int = 240) -> Column:
    """The sentence or line around the first match, its end included; null without a match."""
    at = F.regexp_instr(text, F.lit(pattern))
    before = F.regexp_extract(F.substring(text, F.lit(1), at - 1), r"[^.\n]*$", 0)
    after = F.regexp_extract(F.substring(text, at, F.length(text)), r"^[^.\n]*[.\n]?", 0)
    return F.when(at > 0, F.substring(collapsed(F.concat(before, after)), 1, length))


def _scopes(text: Column) -> Column:
    """The first wording that restricts to a named place: (value, evidence), else null."""
    found = []
    for raw in SCOPES:
        pattern = ascii_words(raw)
        place = F.element_at(F.split(F.regexp_extract(text, pattern, 1), ascii_words(PLACE_ENDS), 2), 1)
        place = F.btrim(F.regexp_replace(place, r"[\s,;:()-]+$", ""), F.lit(" "))
        named = F.lower(F.concat(F.lit(" "), place, F.lit(" "))).rlike(rf"[^a-z](?:{PLACES})[^a-z]")
        found.append(F.when(named & ~place.rlike(ascii_words(EVERYWHERE)), F.struct(place.alias("value"), sentence(text, pattern).alias("evidence"))))
    return F.coalesce(*found)


def body_signals(texts: DataFrame, keywords: tuple[str, ...] = ()) -> DataFrame:
    """(id, text) to one row a text that says anything: scope, zone window, entity, office, country_pay, authorisation, practice.

    scope and window are structs; window has zone, offset, plus_minus, hard (whether others are
    refused within 220 characters) and evidence; practice is the list of keywords it names. Null
    and empty texts get no row.
    """
    text = F.col("text")
    zone, at = ascii_words(ZONE_WINDOW), F.regexp_instr(text, F.lit(ascii_words(ZONE_WINDOW)))
    name = F.regexp_extract(text, zone, 1)
    window = F.struct(
        F.upper(name).alias("zone"), F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])[F.lower(name)].alias("offset"), F.regexp_extract(text, zone, 2).try_cast("int").alias("plus_minus"),
        F.substring(text, at, F.lit(220)).rlike(ascii_words(REFUSES)).alias("hard"), sentence(text, zone).alias("evidence"),
    )
    right = collapsed(F.regexp_extract(text, ascii_words(AUTHORISED), 0))
    named = F.filter(F.array(*[F.lit(k) for k in keywords if k]).cast("array<string>"), lambda k: F.contains(F.lower(text), F.lower(k)))
    rows = texts.filter(F.length("text") > 0).select(
        "id", _scopes(text).alias("scope"), F.when(at > 0, window).alias("window"), sentence(text, ascii_words(ENTITY)).alias("entity"), sentence(text, ascii_words(OFFICE)).alias("office"),
        sentence(text, ascii_words(COUNTRY_PAY)).alias("country_pay"), F.when(right != "", right).alias("authorisation"), named.alias("practice"),
    )
    return rows.filter("coalesce(scope.value, window.zone, entity, office, country_pay, authorisation) is not null or size(practice) > 0")


def duties(texts: DataFrame, most: int = 12) -> DataFrame:
    """(id, text) to (id, duties): the first lines under responsibilities of more than 12 and fewer than 220 characters."""
    lines = extract.sections(texts).filter("section = 'responsibility'").select("id", "line_no", collapsed(F.col("line")).alias("line")).filter("length(line) > 12 and length(line) < 220")
    # a list holds one text's lines
    return lines.groupBy("id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), 1, most).alias("duties"))


def offset_hours(zone: Column, as_of: Column) -> Column:
    """A region's offset from UTC at an instant, in hours."""
    return (F.unix_micros(F.from_utc_timestamp(as_of, zone)) - F.unix_micros(as_of)) / 3_600_000_000


def analysis(jobs: DataFrame, texts: DataFrame, skills: DataFrame, pay: DataFrame, keywords: tuple[str, ...] = ()) -> DataFrame:
    """One row a posting with all that rules read from it, and what they miss, in a stated order.

    jobs (id, seniority, work_mode, remote_scope, location), texts (id, text), pay (id, low, high,
    currency, period) as observed: it beats pay in the body, as the body's scope beats the feed's.
    """
    text = texts.select("id", "text")
    named = extract.skills_in(text, skills).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("slug", "mention_type"))).alias("skills"))
    spoken = extract.languages_in(text).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("code", "level", "required"))).alias("languages"))
    body_pay = extract.pay_in(text).select("id", F.struct("low", "high", "currency", "period").alias("body_pay"))
    seen = pay.select("id", F.struct("low", "high", "currency", "period").alias("seen_pay"))
    facts = text.select("id", F.length("text").alias("chars"), extract.years_required(F.col("text")).alias("years"), extract.team_size(F.col("text")).alias("team"), F.coalesce(F.col("text").rlike(extract.LEADS), F.lit(False)).alias("leads"))
    out = jobs.select("id", "seniority", "work_mode", "remote_scope", "location")
    for part in (facts, named, spoken, body_pay, seen, body_signals(text, keywords), duties(text)):
        out = out.join(part, "id", "left")
    paid = F.coalesce("seen_pay", "body_pay")
    missing = (
        (F.coalesce("chars", F.lit(0)) == 0, "description"), (F.col("skills").isNull(), "skills"), (F.col("years").isNull(), "years_experience_required"), (paid.isNull(), "compensation"),
        (F.coalesce("seniority", F.lit("unknown")).isin("unknown", ""), "seniority"), (F.col("remote_scope").isNull() & F.col("scope").isNull() & (F.col("work_mode") == "remote"), "remote_scope"),
        (F.col("duties").isNull(), "responsibilities"), (F.lit(True), "rule-extracted"), (F.col("entity").isNotNull(), "legal entity"), (F.col("office").isNotNull(), "office days"), (F.col("country_pay").isNotNull(), "country pay"),
    )
    return out.select(
        "id", "years", "team", "leads", "skills", "languages", paid.alias("pay"), F.coalesce("scope.value", "remote_scope", "location").alias("scope"), "window", "authorisation", "practice", "duties",
        F.array_compact(F.array(*[F.when(test, name) for test, name in missing])).alias("missing"),
    )
