"""Captured payloads of posting feeds to one raw record, each feed as a declaration: payload schema, list of postings, columns.

Payloads are read as files of text (one payload a line or a file); there is no network here. A
payload that does not parse gives one row with its text under `_corrupt` and nothing else, so
that a broken capture is seen and stops no other.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from vacantia.functions.html import decode_entities

RAW = (
    "external_id", "url", "title", "company_name", "location", "country", "description", "posted_at", "remote_scope", "work_mode", "seniority", "employment_type",
    "salary_min", "salary_max", "salary_currency", "salary_period", "salary_text", "tags",
)
#: How feeds word kinds of employment and steps of seniority, in order.
EMPLOYMENT = (("full", "full_time"), ("part", "part_time"), ("contract", "contract"), ("temporary", "contract"), ("intern", "internship"))
STEPS = (("staff", "staff"), ("principal", "principal"), ("lead", "lead"), ("senior", "senior"), ("mid", "mid"), ("entry", "junior"), ("junior", "junior"))
#: Currencies by what a salary text holds, in order, and its periods.
SALARY_CURRENCIES = (("USD", r"usd|\$"), ("EUR", "eur|€"), ("GBP", "gbp|£"), ("MXN", "mxn"), ("CAD", "cad"))
SALARY_PERIODS = (("hour", r"hour|/h(?![A-Za-z0-9_])|hr(?![A-Za-z0-9_])"), ("month", r"month|/m(?![A-Za-z0-9_])|mes"))
#: Countries of a site's codes.
SITE_COUNTRIES = {"mx": "Mexico", "br": "Brazil", "ar": "Argentina", "co": "Colombia", "cl": "Chile", "gt": "Guatemala", "us": "United States", "ca": "Canada"}


def _first_of(text: str, steps: tuple[tuple[str, str], ...]) -> str:
    """SQL: the value of the first word that a text holds, whatever the case."""
    return "case " + " ".join(f"when contains(lower({text}), '{word}') then '{value}'" for word, value in steps) + " end"


def _period(text: str, others: str = "'year'") -> str:
    return f"case when contains(lower({text}), 'month') then 'month' when contains(lower({text}), 'hour') then 'hour' else {others} end"


def parse_salary(text: Column) -> Column:
    """A free salary text as (low, high, currency, period): its smallest and largest number from a thousand on; null without a currency or number."""
    t = F.regexp_replace(text, ",", "")
    number = lambda x: F.regexp_extract(x, r"\d+(?:\.\d+)?", 0).cast("double") * F.when(F.lower(x).endswith("k"), 1000).otherwise(1)
    found = F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"(?i)\d+(?:\.\d+)?\s*k?"), F.lit(0)), lambda x: number(F.trim(x))), lambda n: n >= 1000)
    currency = F.coalesce(*[F.when(t.rlike(f"(?i){p}"), c) for c, p in SALARY_CURRENCIES])
    period = F.coalesce(*[F.when(t.rlike(f"(?i){p}"), c) for c, p in SALARY_PERIODS], F.lit("year"))
    return F.when(currency.isNotNull() & (F.size(found) > 0), F.struct(F.array_min(found).alias("low"), F.array_max(found).alias("high"), currency.alias("currency"), period.alias("period")))


def body_mode(text: Column) -> Column:
    """The arrangement a Spanish body states ("Modalidad de trabajo: ...")."""
    said = F.lower(F.regexp_extract(text, r"(?i)modalidad(?: de trabajo)?\s*:\s*(h[ií]brid|presencial|remot)", 1))
    return F.when(said.startswith("h"), "hybrid").when(said.startswith("p"), "onsite").when(said.startswith("r"), "remote")


@dataclass(frozen=True)
class Feed:
    """schema: DDL of the payload. items: SQL for its array of postings. columns: SQL of each raw column over item i and payload p.

    once: SQL of what names a posting; of several with one name the first stays, in the order of
    their place in the payload. twice: bodies are encoded twice. salary: SQL of a free salary text.
    """

    key: str
    schema: str
    items: str
    columns: dict[str, str] = field(default_factory=dict)
    once: str = ""
    twice: bool = False
    salary: str = ""
    body_mode: bool = False


_PLACES = "array_join(filter(transform(filter(i.locations, l -> not coalesce(l.hidden, false)), l -> concat_ws(', ', nullif(l.city, ''), nullif(l.region, ''), nullif(l.country, ''))), x -> x <> ''), '; ')"
_BAMBOO_MODE = "case when coalesce(i.isRemote, false) or i.locationType = '1' then 'remote' when i.locationType = '2' then 'hybrid' when i.locationType = '0' then 'onsite' end"
#: A requisition is indexed once a language, under the same reference.
_REF = "split(coalesce(i.ref, i.id), '-')[0]"
_SITE_COUNTRY = "coalesce(" + ", ".join(f"case when array_contains(split(lower(coalesce(i.country_code, p.site)), '-'), '{k}') then '{v}' end" for k, v in SITE_COUNTRIES.items()) + ")"
#: S01-S16 but the ones read as XML or comments below. Field names are those of the public payloads.
FEEDS = {
    f.key: f
    for f in (
        Feed("remotive", "jobs array<struct<id:long,url:string,title:string,company_name:string,job_type:string,publication_date:string,candidate_required_location:string,salary:string,tags:array<string>,description:string>>", "p.jobs",
             {"external_id": "cast(i.id as string)", "url": "i.url", "title": "i.title", "company_name": "i.company_name", "description": "i.description", "posted_at": "i.publication_date", "location": "coalesce(nullif(i.candidate_required_location, ''), 'Remote')", "remote_scope": "coalesce(nullif(i.candidate_required_location, ''), 'Worldwide')", "work_mode": "'remote'", "employment_type": _first_of("i.job_type", (*EMPLOYMENT, ("freelance", "freelance"))), "salary_text": "i.salary", "tags": "array_join(i.tags, ',')"}, once="i.id", salary="i.salary"),
        Feed("remoteok", "list array<struct<id:string,url:string,position:string,company:string,location:string,date:string,description:string,legal:string>>", "filter(p.list, x -> x.legal is null)",
             {"external_id": "i.id", "url": "i.url", "title": "i.position", "company_name": "i.company", "description": "i.description", "posted_at": "i.date", "work_mode": "'remote'", "remote_scope": "coalesce(nullif(i.location, ''), 'Worldwide')"}),
        Feed("arbeitnow", "data array<struct<slug:string,url:string,title:string,company_name:string,location:string,remote:boolean,job_types:array<string>,created_at:long,description:string>>", "p.data",
             {"external_id": "i.slug", "url": "i.url", "title": "i.title", "company_name": "i.company_name", "location": "i.location", "description": "i.description", "work_mode": "case when i.remote then 'remote' end", "posted_at": "cast(i.created_at as string)", "employment_type": _first_of("array_join(i.job_types, ' ')", (("full", "full_time"), ("part", "part_time"), ("intern", "internship")))}),
        Feed("greenhouse", "company string, jobs array<struct<id:long,absolute_url:string,title:string,updated_at:string,first_published:string,content:string,location:struct<name:string>>>", "p.jobs",
             {"external_id": "cast(i.id as string)", "url": "i.absolute_url", "title": "i.title", "company_name": "p.company", "location": "i.location.name", "description": "i.content", "work_mode": "case when contains(lower(i.location.name), 'remote') then 'remote' end", "posted_at": "coalesce(i.first_published, i.updated_at)"}, twice=True),
        Feed("lever", "company string, postings array<struct<id:string,hostedUrl:string,text:string,createdAt:long,descriptionPlain:string,additionalPlain:string,categories:struct<location:string,commitment:string>,lists:array<struct<text:string,content:string>>>>", "p.postings",
             {"external_id": "i.id", "url": "i.hostedUrl", "title": "i.text", "company_name": "p.company", "location": "i.categories.location", "employment_type": "i.categories.commitment", "posted_at": "cast(i.createdAt as string)",
              "description": "concat_ws('\\n', nullif(i.descriptionPlain, ''), array_join(transform(i.lists, l -> concat_ws('\\n', l.text, l.content)), '\\n'), nullif(i.additionalPlain, ''))"}),
        Feed("ashby", "company string, jobs array<struct<id:string,jobUrl:string,title:string,location:string,employmentType:string,publishedAt:string,descriptionHtml:string,descriptionPlain:string,isRemote:boolean,compensation:struct<compensationTierSummary:string,summaryComponents:array<struct<compensationType:string,minValue:double,maxValue:double,currencyCode:string,interval:string>>>>>", "p.jobs",
             {"external_id": "i.id", "url": "i.jobUrl", "title": "i.title", "company_name": "p.company", "location": "i.location", "employment_type": _first_of("i.employmentType", EMPLOYMENT), "posted_at": "i.publishedAt", "description": "coalesce(i.descriptionPlain, i.descriptionHtml)", "work_mode": "case when i.isRemote then 'remote' end",
              "salary_text": "i.compensation.compensationTierSummary", **{f"salary_{k}": f"get(filter(i.compensation.summaryComponents, c -> c.compensationType = 'Salary'), 0).{v}" for k, v in (("min", "minValue"), ("max", "maxValue"), ("currency", "currencyCode"))},
              "salary_period": "case when exists(i.compensation.summaryComponents, c -> c.compensationType = 'Salary') then " + _period("get(filter(i.compensation.summaryComponents, c -> c.compensationType = 'Salary'), 0).interval") + " end"}),
        Feed("himalayas", "jobs array<struct<guid:string,title:string,companyName:string,applicationLink:string,pubDate:string,employmentType:string,description:string,excerpt:string,minSalary:double,maxSalary:double,currency:string,salaryPeriod:string,seniority:array<string>,locationRestrictions:array<string>>>", "filter(p.jobs, x -> x.title <> '' and coalesce(x.applicationLink, x.guid) <> '')",
             {"external_id": "coalesce(i.guid, i.applicationLink)", "url": "coalesce(i.applicationLink, i.guid)", "title": "i.title", "company_name": "i.companyName", "posted_at": "i.pubDate", "employment_type": _first_of("i.employmentType", EMPLOYMENT), "description": "coalesce(i.description, i.excerpt)", "work_mode": "'remote'",
              "country": "case when size(i.locationRestrictions) = 1 then i.locationRestrictions[0] end", "remote_scope": "coalesce(nullif(array_join(i.locationRestrictions, ', '), ''), 'Worldwide')", "location": "concat('Remote (', coalesce(nullif(array_join(i.locationRestrictions, ', '), ''), 'Worldwide'), ')')",
              "seniority": _first_of("array_join(i.seniority, ' ')", STEPS), **{f"salary_{k}": f"case when greatest(coalesce(i.minSalary, 0), coalesce(i.maxSalary, 0)) > 0 and i.currency <> '' then {v} end" for k, v in (("min", "i.minSalary"), ("max", "i.maxSalary"), ("currency", "i.currency"), ("period", _period("i.salaryPeriod")))}}),
        Feed("jobicy", "jobs array<struct<id:long,url:string,jobTitle:string,companyName:string,jobGeo:string,jobType:array<string>,pubDate:string,jobDescription:string>>", "p.jobs",
             {"external_id": "cast(i.id as string)", "url": "i.url", "title": "i.jobTitle", "company_name": "i.companyName", "remote_scope": "i.jobGeo", "work_mode": "'remote'", "employment_type": _first_of("array_join(i.jobType, ' ')", EMPLOYMENT), "posted_at": "i.pubDate", "description": "i.jobDescription"}, once="i.id"),
        Feed("workingnomads", "list array<struct<url:string,title:string,company_name:string,tags:string,location:string,pub_date:string,description:string>>", "filter(p.list, x -> x.url <> '' and x.title <> '')",
             {"external_id": "coalesce(nullif(regexp_extract(i.url, '/([0-9]+)/?$', 1), ''), i.url)", "work_mode": "'remote'", "location": "nullif(i.location, '')", "tags": "array_join(filter(transform(split(i.tags, ','), t -> trim(t)), t -> t <> ''), ',')", "url": "i.url", "title": "i.title", "company_name": "i.company_name", "remote_scope": "nullif(i.location, '')", "posted_at": "i.pub_date", "description": "i.description"}),
        Feed("workable", "name string, jobs array<struct<shortcode:string,url:string,title:string,country:string,city:string,telecommuting:boolean,published_on:string,created_at:string,employment_type:string,description:string,locations:array<struct<city:string,region:string,country:string,hidden:boolean>>>>", "p.jobs",
             {"external_id": "i.shortcode", "url": "i.url", "title": "i.title", "company_name": "p.name", "location": f"case when not coalesce(i.telecommuting, false) then coalesce(nullif({_PLACES}, ''), nullif(concat_ws(', ', nullif(i.city, ''), nullif(i.country, '')), '')) when size(filter(i.locations, l -> not coalesce(l.hidden, false))) > 1 then {_PLACES} else 'Remote' end",
              "country": "case when not coalesce(i.telecommuting, false) then i.country end", "work_mode": "case when i.telecommuting then 'remote' end", "employment_type": _first_of("i.employment_type", EMPLOYMENT), "posted_at": "coalesce(i.published_on, i.created_at)", "description": "i.description"}),
        Feed("bamboohr", "company string, result array<struct<id:string,jobOpeningName:string,employmentStatusLabel:string,locationType:string,isRemote:boolean,datePosted:string,location:struct<city:string,state:string,addressCountry:string>,atsLocation:struct<city:string,state:string,country:string>,description:string>>", "p.result",
             {"external_id": "i.id", "title": "i.jobOpeningName", "company_name": "p.company", "employment_type": _first_of("i.employmentStatusLabel", EMPLOYMENT), "work_mode": _BAMBOO_MODE, "posted_at": "i.datePosted", "country": f"case when coalesce({_BAMBOO_MODE}, '') <> 'remote' then coalesce(i.atsLocation.country, i.location.addressCountry) end",
              "location": f"coalesce(nullif(concat_ws(', ', nullif(coalesce(i.location.city, i.atsLocation.city), ''), nullif(coalesce(i.location.state, i.atsLocation.state), ''), nullif(coalesce(i.atsLocation.country, i.location.addressCountry), '')), ''), case when {_BAMBOO_MODE} = 'remote' then 'Remote' end)", "description": "i.description"}),
        Feed("workday", "company string, jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string>>", "p.jobPostings",
             {"external_id": "i.externalPath", "url": "i.externalPath", "title": "i.title", "company_name": "p.company", "location": "i.locationsText", "posted_at": "i.postedOn"}),
        Feed("capgemini", "site string, data array<struct<id:string,ref:string,status:string,deleted_at:string,brand:string,title:string,location:string,country_code:string,description:string,indexed_at:string,apply_job_url:string>>", "filter(p.data, x -> x.deleted_at is null and coalesce(x.status, '1') in ('', '1'))",
             {"external_id": f"concat_ws(':', p.site, {_REF})", "url": f"coalesce(regexp_replace(i.apply_job_url, '[?].*$', ''), {_REF})", "title": "i.title", "company_name": "coalesce(nullif(i.brand, ''), 'Capgemini')", "country": _SITE_COUNTRY, "location": f"nullif(concat_ws(', ', nullif(i.location, ''), {_SITE_COUNTRY}), '')", "posted_at": "i.indexed_at", "description": "i.description"}, once=f"concat_ws(':', p.site, {_REF})", body_mode=True),
    )
}


def postings(payloads: DataFrame, key: str) -> DataFrame:
    """(payload, ...) to raw postings of one feed; other columns of payloads are kept. A payload that is a bare list is wrapped first."""
    feed = FEEDS[key]
    others = [c for c in payloads.columns if c != "payload"]
    text = F.when(F.trim("payload").startswith("["), F.concat(F.lit('{"list":'), "payload", F.lit("}"))).otherwise(F.col("payload"))
    read = payloads.withColumn("p", F.from_json(text, feed.schema)).withColumn("items", F.expr(feed.items))
    rows = read.select(*others, "p", F.when(F.col("items").isNull(), F.col("payload")).alias("_corrupt"), F.posexplode_outer("items").alias("place", "i")).filter("i is not null or _corrupt is not null")
    if feed.once:
        first = Window.partitionBy(F.expr(feed.once), F.col("_corrupt")).orderBy("place", *others)
        rows = rows.withColumn("k", F.row_number().over(first)).filter("k = 1 or _corrupt is not null").drop("k")
    made = {c: F.expr(sql) for c, sql in feed.columns.items()}
    if feed.twice:
        made["description"] = decode_entities(made["description"])
    if feed.salary:
        pay = parse_salary(F.expr(feed.salary))
        made |= {"salary_min": pay["low"], "salary_max": pay["high"], "salary_currency": pay["currency"], "salary_period": pay["period"]}
    if feed.body_mode:
        made["work_mode"] = body_mode(made["description"])
    types = {"salary_min": "double", "salary_max": "double"}
    return rows.select(*others, F.lit(key).alias("source_key"), *[made.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c) for c in RAW], "_corrupt")


def rss(payloads: DataFrame, key: str) -> DataFrame:
    """Items of an RSS payload: "Company: Title" at one feed, "Title - Company - Place", split from its end, at another."""
    item = F.explode(F.regexp_extract_all("payload", F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1)))
    tag = lambda name: F.trim(F.regexp_replace(F.regexp_extract("item", rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"))
    rows = payloads.select(item.alias("item")).select(tag("title").alias("t"), tag("link").alias("url"), tag("guid").alias("guid"), tag("region").alias("region"), tag("pubDate").alias("posted_at"), tag("description").alias("description"))
    if key == "weworkremotely":
        company, title, place = F.trim(F.substring_index("t", ":", 1)), F.trim(F.expr("substring(t, locate(':', t) + 1)")), F.lit(None).cast("string")
    else:
        company, title, place = F.regexp_extract("t", r"^.* - (.*?) - [^-]*$", 1), F.regexp_extract("t", r"^(.*) - .*? - [^-]*$", 1), F.regexp_extract("t", r" - ([^-]*)$", 1)
    values = {"external_id": F.when(F.col("guid") != "", F.col("guid")).otherwise(F.col("url")), "url": F.col("url"), "title": title, "company_name": company, "location": place, "description": F.col("description"), "posted_at": F.col("posted_at"), "remote_scope": F.nullif("region", F.lit(""))}
    return rows.select(F.lit(key).alias("source_key"), *[values.get(c, F.lit(None).cast("string")).alias(c) for c in RAW])


#: Words of a role and of an arrangement, ends of a title's pitch, abbreviations whose dot ends no sentence, and addresses.
ROLE_WORDS = r"(?i)(?<![A-Za-z0-9_])(?:engineer|engineering|developer|dev|architect|lead|cto|founder|founding|scientist|manager|head of|director|programmer|sre|devops|designer|analyst|product|staff|principal|swe|full[- ]?stack|backend|frontend|back-end|front-end|ml|ai)s?(?![A-Za-z0-9_])"
MODES = r"(?i)^(?:remote|onsite|on-site|hybrid|in[- ]office|full[- ]time|part[- ]time|contract|contractor|freelance|intern(?:ship)?|visa|equity|salary|\$|€|£)"
PITCH = r"(?i)\s(?:we’?'?re|we|our|i|i’?'?m|about|founded|apply|looking for|https?:\/\/|@)"
ABBREVIATIONS = "sr|jr|dr|mr|ms|mrs|st|inc|ltd|co|corp|vs|etc|sen|assoc"
FULL_ADDRESS, DOMAIN = r"(?i)^(?:https?://|www\.)", r"(?i)^[a-z0-9.-]+\.(?:com|io|ai|dev|co|org|net|fm|app)(?:/|$)"
SUMS = r"(?i)[$€£]\s?\d|\d+\s?k(?![A-Za-z0-9_])"
LONGEST_TITLE = 120


def _tidy(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"\s+", " "), "^[\\s\\-–—:,]+|[\\s\\-–—:,]+$", "")


def title_of_segment(segment: Column) -> Column:
    """A segment as (rescued, size, title): a pattern is unwrapped, and only what is too long for a title is cut, at its first sentence or pitch."""
    inner = F.regexp_extract(segment, "^\\s*/(.+)/[gimsuy]*\\s*$", 1)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, "[$^]", ""), r"\\(.)", "$1"), "[?]", ""), r"[()\[\]{}|*+]", " ")
    s = _tidy(F.when(inner != "", bare).otherwise(segment))
    sentence = F.regexp_extract(s, rf"(?i)^(.{{12,}}?)(?:(?<!(?:{ABBREVIATIONS}))[.]|[!?])(?=\s|$)", 1)
    short = F.when(sentence != "", sentence).otherwise(s)
    pitch = F.regexp_instr(short, F.lit(PITCH))
    short = _tidy(F.when(pitch > 12, F.substring(short, F.lit(1), pitch - 1)).otherwise(short))
    short = F.when(F.length(short) > LONGEST_TITLE, _tidy(F.regexp_extract(short, rf"^(.{{0,{LONGEST_TITLE}}})\s", 1))).otherwise(short)
    long = F.length(s) > LONGEST_TITLE
    title = F.when(long, short).otherwise(s)
    return F.struct(long.alias("rescued"), F.length(title).alias("size"), title.alias("title"))


def hiring_comments(comments: DataFrame) -> DataFrame:
    """(id, text) of comments with a header of segments ("Company | Title | Place | ...", in any order but the company) to raw postings.

    Each segment is judged by what it says. Of several titles an uncut one wins, then the shorter,
    then the earlier; comments without a company or title give no row.
    """
    line = F.get(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    parts = F.transform(F.filter(F.transform(F.split(line, r"\|"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.substring(x, 1, 140))
    address = lambda x: x.rlike(FULL_ADDRESS) | x.rlike(DOMAIN)
    rows = comments.filter(F.trim("text") != "").select("id", "text", line.alias("line"), parts.alias("x")).filter("size(x) > 0")
    company = F.when(~F.get("x", F.lit(0)).rlike(FULL_ADDRESS), F.get("x", F.lit(0))).otherwise(F.get(F.filter("x", lambda p: ~address(p)), F.lit(0)))
    rows = rows.withColumn("company", company).withColumn("x", F.filter("x", lambda p: p != F.coalesce("company", F.lit(""))))
    roles = F.filter("x", lambda p: ~address(p) & p.rlike(ROLE_WORDS) & ~p.rlike(MODES))
    titles = F.filter(F.transform(roles, lambda p, k: F.struct(title_of_segment(p).alias("t"), k.alias("k"))), lambda t: t["t"]["title"].rlike(ROLE_WORDS))
    best = F.array_min(F.transform(titles, lambda t: F.struct(t["t"]["rescued"].alias("rescued"), t["t"]["size"].alias("size"), t["k"].alias("k"), t["t"]["title"].alias("title"))))["title"]
    rows = rows.withColumns({"title": best, "remote": F.col("line").rlike(r"(?i)(?<![A-Za-z0-9_])remote(?![A-Za-z0-9_])")})
    place = F.get(F.filter("x", lambda p: (p != F.col("title")) & ~address(p) & ~p.rlike(MODES) & ~p.rlike(ROLE_WORDS) & (F.length(p) <= 60) & ~p.rlike(SUMS)), F.lit(0))
    values = {
        "external_id": F.col("id").cast("string"), "company_name": F.col("company"), "title": F.col("title"), "location": F.coalesce(place, F.when(F.col("remote"), "Remote")), "description": F.col("text"),
        "work_mode": F.when(F.col("remote"), "remote"), "salary_text": F.get(F.filter("x", lambda p: p.rlike(SUMS)), F.lit(0)),
    }
    return rows.filter("company is not null and title is not null").select(F.lit("hn_hiring").alias("source_key"), *[values.get(c, F.lit(None).cast("string")).alias(c) for c in RAW])


def country_facets(facets: Column, country: str, country_id: str = "") -> Column:
    """(JSON of a board's facets) to "parameter=id" of those that keep one country; empty where the board offers none.

    The country's own facet wins, by its id; else every place that names the country stands, but
    not where "new " goes before the name. Facets nest to any depth.
    """
    named = re.compile(rf"(?<!new )\b{re.escape(country)}\b", re.I)

    def one(text: str | None) -> list[str]:
        try:
            open_ = [(f.get("facetParameter"), f.get("values") or []) for f in json.loads(text or "[]")]
        except (ValueError, AttributeError):
            return []
        places: list[str] = []
        while open_:
            parameter, values = open_.pop(0)
            nested = [(v["facetParameter"], v.get("values") or []) for v in values if v.get("facetParameter")]
            for v in values:
                if not v.get("facetParameter") and country_id and parameter and v.get("id") == country_id:
                    return [f"{parameter}={country_id}"]
            places += [f"locations={v['id']}" for v in values if parameter == "locations" and not v.get("facetParameter") and v.get("id") and named.search(v.get("descriptor") or "")]
            open_ = nested + open_
        return places

    return F.pandas_udf(lambda x: x.map(one), ArrayType(StringType()))(facets)


def matches_terms(df: DataFrame, terms: list[str], *columns: str) -> DataFrame:
    """Rows whose joined columns hold any term, whatever the case; no terms pass all."""
    text = F.lower(F.concat_ws(" ", *columns))
    return df.filter(F.exists(F.array(*map(F.lit, [t.lower() for t in terms])), lambda t: text.contains(t))) if terms else df


def read(spark: SparkSession, path: str, key: str, whole_file: bool = True) -> DataFrame:
    return postings(spark.read.text(path, wholetext=whole_file).withColumnRenamed("value", "payload"), key)
