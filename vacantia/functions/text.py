"""Normalisation of names, titles, URLs and words to enums, as columns. One Arrow UDF, for compatibility decomposition."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Legal forms dropped from the end of a company name, up to three times.
COMPANY_FORMS = "inc|llc|ltd|limited|corp|corporation|co|company|gmbh|plc|ag|bv|srl|s a de c v|sa de cv|s de rl de cv|s a|sa|s l|sl|s r l|pty|oy|ab|as|nv|kk|llp|lp"
#: Words that don't belong to a title, and markers of gender.
TITLE_NOISE = "remote|hybrid|on-?site|full[- ]time|part[- ]time|contract|urgent|hiring|now hiring"
GENDER = r"(?i)(?<![A-Za-z0-9_])[mfwdh](?:\s*/\s*[mfwdhx*]){1,3}(?![A-Za-z0-9_])"
#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gh_src", "lever-source", "ref", "source", "src", "fbclid", "gclid", "trk", "trackingid", "refid")
#: What words of a title mean, in order of precedence.
SENIORITY = (
    ("executive", "cto|vp|vice president|chief"), ("director", "director"), ("manager", "engineering manager|manager|head of"), ("principal", "principal"), ("staff", "staff"),
    ("lead", "lead|tech lead|team lead"), ("senior", r"senior|sr\.?|snr"), ("junior", r"junior|jr\.?|entry level|graduate|trainee"), ("intern", "intern|internship|practicante"),
    ("mid", "mid|mid-level|intermediate"),
)
EMPLOYMENT = (("internship", "internship|intern"), ("freelance", "freelance"), ("contract", "contract|contractor|b2b"), ("part_time", "part[- ]time"), ("full_time", "full[- ]time|permanent"))


def word(pattern: str) -> str:
    """A pattern between ASCII word bounds."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+", " "))


@F.pandas_udf(StringType())
def fold(texts: pd.Series) -> pd.Series:
    def one(t):
        if t is None or t.isascii():
            return t
        bare = "".join(c for c in unicodedata.normalize("NFKD", t) if not "\u0300" <= c <= "\u036f")
        return unicodedata.normalize("NFC", bare)

    return texts.map(one, na_action="ignore")


def _plain_table() -> tuple[str, str]:
    """Single characters whose compatibility form without marks is one other character, and that character, by rule."""
    pairs = {}
    for code in (*range(0xA0, 0x3000), *range(0xFF01, 0xFF5F)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not "\u0300" <= c <= "\u036f")
        if len(base) == 1 and base != chr(code):
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


def plain_letters(text: Column) -> Column:
    """Like fold without leaving the JVM, but for characters that fold to several (ligatures), which stay."""
    plain = F.regexp_replace(F.translate(text, *_plain_table()), "[\\u0300-\\u036f]", "")
    return F.when(text.rlike(r"[^\x00-\x7f]"), plain).otherwise(text)


def normalize(text: Column) -> Column:
    """Lower case, accents stripped, only letters, digits, marks, + # and . kept; empty for null."""
    return F.coalesce(collapse(F.regexp_replace(F.lower(fold(text)), r"[^\p{L}\p{N}\p{M}+#.\s]", " ")), F.lit(""))


def company(name: Column) -> Column:
    bare = collapse(F.regexp_replace(normalize(name), "[.,]", " "))
    for _ in range(3):
        bare = F.regexp_replace(bare, rf"\s+(?:{COMPANY_FORMS})$", "")
    return F.when(bare != "", bare)


def title(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, r"\(.*?\)|\[.*?\]", " "), GENDER, " ")
    return collapse(F.regexp_replace(normalize(bare), word(TITLE_NOISE), " "))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(fold(name)), r"\.js(?![a-z0-9])", "js"), "[^a-z0-9+#]+", "-"), "^-+|-+$", "")


def canonical_url(url: Column) -> Column:
    """No fragment, www. or tracking parameter; parameters sorted by key, equal keys in their order; no slash at the end of the whole.

    What isn't a URL is only trimmed. A slash before a query stays, but for the root alone.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), r"^www\.", "")
    scheme, path = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.regexp_extract(bare, r"^[^:]*://[^/?]*([^?]*)", 1)
    query = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    own = F.filter(query, lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    keyed = F.array_sort(F.transform(own, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p"))))
    asked = F.when(F.size(own) > 0, F.concat(F.lit("?"), F.array_join(F.transform(keyed, lambda x: x["p"]), "&"))).otherwise("")
    whole = F.concat(scheme, F.lit("://"), host, F.when((path == "") & (asked != ""), "/").otherwise(path), asked)
    return F.when(host != "", F.regexp_replace(whole, "/$", "")).otherwise(F.trim(url))


def _ladder(text: Column, steps: tuple[tuple[str, str], ...], default: Column) -> Column:
    out = default
    for name, pattern in reversed(steps):
        out = F.when(text.rlike(word(pattern)), name).otherwise(out)
    return out


def seniority(normal_title: Column, normal_description: Column) -> Column:
    years = F.regexp_extract(F.substring(normal_description, 1, 3000), r"(\d{1,4})\+?\s*(?:years|yrs|anos)", 1).try_cast("int")
    return _ladder(normal_title, SENIORITY, F.when(years >= 8, "senior").when(years >= 4, "mid").when(years >= 1, "junior").otherwise("unknown"))


def employment(normal: Column) -> Column:
    return _ladder(normal, EMPLOYMENT, F.lit("unknown"))


#: Words of the ways to work.
MODE_WORDS = {"hybrid": "hybrid|hibrido", "remote": "remote|remoto|work from home|wfh|distributed", "wholly": "remote first|fully remote", "office": "on[- ]?site|in[- ]?office", "onsite": "presencial"}


def work_mode(normal: Column) -> Column:
    """A posting that names both home and office is hybrid, unless it is remote all through; one that names neither is unknown."""
    said = {k: normal.rlike(word(p)) for k, p in MODE_WORDS.items()}
    both = said["hybrid"] | (said["remote"] & said["office"] & ~said["wholly"])
    return F.when(both, "hybrid").when(said["remote"], "remote").when(said["office"] | said["onsite"], "onsite").otherwise("unknown")


def dedup_key(normal_company: Column, normal_title: Column, url: Column) -> Column:
    named = normal_company.isNotNull() & (normal_title != "")
    return F.sha2(F.when(named, F.concat_ws("|", normal_company, normal_title)).otherwise(F.concat(F.lit("url|"), F.coalesce(url, F.lit("")))), 256)


#: What a skill's name tells of its kind, in order.
CATEGORIES = (
    ("language", r"^(?:javascript|typescript|python|java|go|c\+\+|c#|rust|ruby|php|kotlin|swift|scala|sql)$"), ("framework", r"react|vue|angular|next|node|\.net|spring|django|rails|express"),
    ("database", "postgres|mysql|mongo|redis|sql server|dynamo|cassandra|elasticsearch"), ("cloud", "^(?:aws|gcp|azure)$"), ("devops", "kubernetes|docker|terraform|ci/cd|ansible|helm"),
    ("infrastructure", "kafka|rabbitmq"), ("architecture", "microservices|distributed|system design|rest|graphql"), ("ai", "machine learning|language model|context protocol|claude|agents"),
    ("practice", "testing|agile|git"), ("soft", "leadership"), ("domain", "english|spanish"),
)
#: Codes that sources send in place of country names.
COUNTRY_CODES = {
    "mx": "mexico", "mex": "mexico", "us": "united states", "usa": "united states", "ca": "canada", "br": "brazil", "co": "colombia", "ar": "argentina", "cl": "chile", "pe": "peru", "uy": "uruguay",
    "gb": "united kingdom", "uk": "united kingdom", "ie": "ireland", "de": "germany", "es": "spain", "fr": "france", "pt": "portugal", "nl": "netherlands", "pl": "poland", "in": "india",
}


def skill_category(name: Column) -> Column:
    out = F.lit("other")
    for kind, pattern in reversed(CATEGORIES):
        out = F.when(F.lower(name).rlike(pattern), kind).otherwise(out)
    return out


def website_domain(website: Column) -> Column:
    """The host without www.; null where there is none."""
    full = F.when(website.startswith("http"), website).otherwise(F.concat(F.lit("https://"), website))
    host = F.lower(F.try_parse_url(full, F.lit("HOST")))
    return F.regexp_replace(host, r"^www\.", "")


def pay_period(period: Column) -> Column:
    """hour, day, week, month or year; what is not known counts as a year."""
    p = F.lower(period)
    return F.when(p.startswith("hour"), "hour").when(p.startswith("da"), "day").when(p.startswith("week"), "week").when(p.startswith("month"), "month").otherwise("year")


def country_name(raw: Column) -> Column:
    """Lower case, without accents, codes spelled out; null for null and empty."""
    plain = F.lower(fold(F.trim(raw)))
    return F.when(raw != "", F.coalesce(F.create_map(*[F.lit(x) for kv in COUNTRY_CODES.items() for x in kv])[plain], plain))


def content_hash(title: Column, company_: Column, location: Column, mode: Column, body: Column, pay: Column, employment_: Column) -> Column:
    """Names the content of a posting: equal only where all parts are, nulls included."""
    parts = F.struct(title.alias("title"), company_.alias("company"), location.alias("location"), mode.alias("mode"), F.sha2(body, 256).alias("body"), pay.alias("pay"), employment_.alias("employment"))
    return F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256)


def unix_or_iso(value: Column) -> Column:
    """An instant from what feeds send: a number below 1e12 is seconds since 1970, any other milliseconds; else a written instant; null where it is neither."""
    number = F.when(value.rlike(r"^\s*\d+(?:\.\d+)?\s*$"), F.trim(value).try_cast("double"))
    seconds = F.when(number < 1e12, number).otherwise(number / 1000)
    return F.coalesce(F.when(seconds < 2.5e11, F.timestamp_micros(F.round(seconds * 1e6).cast("long"))), F.when(number.isNull(), F.trim(value).try_cast("timestamp")))
