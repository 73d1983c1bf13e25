"""Queries of text normalisation, inference, extraction and identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import html
from vacantia.functions import text as T
from vacantia.operators import extract, ingest, resolve, signals
from vacantia.session import table


def _jobs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "jobs").select("id", *columns)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d, "description").select("id", extract.plain(F.col("description")).alias("text"))


def text_normalize(spark, d):
    return _jobs(spark, d, "title").select("id", T.normalize(F.col("title")).alias("normal"))


def company_normalize(spark, d):
    return _jobs(spark, d, "company_name").select("id", T.company(F.col("company_name")).alias("normal"))


def title_normalize(spark, d):
    return _jobs(spark, d, "title").select("id", T.title(F.col("title")).alias("normal"))


def slug(spark, d):
    return table(spark, d, "skills").select("id", T.slug(F.col("name")).alias("slug"))


def url_canonical(spark, d):
    return _jobs(spark, d, "url").select("id", T.canonical_url(F.col("url")).alias("canonical"))


def url_variants(spark, d):
    """The same URLs with a slash before a query, keys out of order, equal keys, and tracking."""
    bare = F.regexp_extract(F.col("url"), "^[^?#]*", 0)
    return _jobs(spark, d, "url").select("id", T.canonical_url(F.concat(bare, F.lit("/?b=2&a=1&b=0&Ref=x&A=3&utm_source=y#frag"))).alias("with_query"), T.canonical_url(F.concat(bare, F.lit("/#frag"))).alias("with_slash"))


def html_to_text(spark, d):
    return _texts(spark, d)


def infer_enums(spark, d):
    rows = _jobs(spark, d, "title", "location", "description").select("id", "location", T.normalize(F.col("title")).alias("t"), T.normalize(F.concat_ws(" ", "location", "title")).alias("place"), T.normalize(F.col("description")).alias("body"))
    return rows.select("id", T.seniority(F.col("t"), F.col("body")).alias("seniority"), T.work_mode(F.col("place")).alias("work_mode"), T.employment(F.col("t")).alias("employment_type"))


def _keys(spark, d):
    rows = table(spark, d, "jobs").select("id", "source_id", "status", F.unix_micros("discovered_at").alias("at"), T.canonical_url(F.col("url")).alias("url"), T.company(F.col("company_name")).alias("c"), T.title(F.col("title")).alias("t"))
    return rows.withColumn("key", T.dedup_key(F.col("c"), F.col("t"), F.col("url")))


def dedup_groups(spark, d):
    return _keys(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def duplicate_links(spark, d):
    rows = _keys(spark, d).select("id", "at", "source_id", "url", "key", (F.coalesce("status", F.lit("")) == "active").alias("active"))
    return resolve.duplicate_links(rows)


def section_counts(spark, d):
    return extract.sections(_texts(spark, d)).groupBy("section").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


def skill_extract(spark, d):
    return extract.skills_in(_texts(spark, d), table(spark, d, "skills"))


def years_team(spark, d):
    text = F.col("text")
    return _texts(spark, d).select("id", extract.years_required(text).alias("years"), extract.team_size(text).alias("team"), F.coalesce(text.rlike(extract.LEADS), F.lit(False)).alias("leads"))


def languages_required(spark, d):
    return extract.languages_in(_texts(spark, d))


def salary_parse(spark, d):
    rows = table(spark, d, "compensation_observations").select("id", F.col("evidence").alias("text"))
    return extract.pay_in(rows.filter("text is not null"))


KEYWORDS = ("evaluation", "specification", "acceptance criteria", "automation", "audit trail")


def job_signals(spark, d):
    """What bodies say of place, zone, office, entity, pay by country, authorisation and practice: one row each with its sentence."""
    rows = signals.body_signals(_texts(spark, d), KEYWORDS)
    each = {
        "scope": (F.col("scope.value"), F.col("scope.evidence")), "window": (F.col("window.zone"), F.col("window.evidence")), "entity": (F.lit("yes"), F.col("entity")), "office": (F.lit("yes"), F.col("office")),
        "country_pay": (F.lit("yes"), F.col("country_pay")), "authorisation": (F.col("authorisation"), F.col("authorisation")), "practice": (F.array_join("practice", "|"), F.nullif(F.array_join("practice", "|"), F.lit(""))),
    }
    long = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value"), e.alias("evidence")) for k, (v, e) in each.items()])
    return rows.select("id", F.explode(long).alias("x")).select("id", "x.*").filter("evidence is not null")


def duty_lines(spark, d):
    return signals.duties(_texts(spark, d)).select("id", F.posexplode("duties").alias("k", "line"))


def job_analysis(spark, d):
    """All that rules read from each posting, with the explicit pay of the smallest id."""
    pay = table(spark, d, "compensation_observations").filter("observation_type = 'explicit' and job_id is not null")
    pay = pay.groupBy(F.col("job_id").alias("id")).agg(F.min_by(F.struct(F.col("min_amount").alias("low"), F.col("max_amount").alias("high"), "currency", "period"), "id").alias("p")).select("id", "p.*")
    found = signals.analysis(_jobs(spark, d, "seniority", "work_mode", "remote_scope", "location"), _texts(spark, d), table(spark, d, "skills"), pay, KEYWORDS)
    return found.select("id", "years", "team", "leads", F.coalesce(F.size("skills"), F.lit(0)).alias("skills"), F.coalesce(F.size("languages"), F.lit(0)).alias("languages"), F.col("pay.low").alias("low"), F.col("pay.high").alias("high"), "scope", F.array_join("missing", "|").alias("missing"))


def normalized_jobs(spark, d):
    raw = table(spark, d, "jobs").withColumns({c: F.lit(None).cast("string") for c in ("work_mode", "seniority", "employment_type")})
    return ingest.normalised(raw).select("id", "title", "normal_title", "normal_company", "canonical_url", "work_mode", "seniority", "employment_type", "dedup_key")


def skill_categories(spark, d):
    return table(spark, d, "skills").select("id", T.skill_category(F.col("name")).alias("category"))


def company_domains(spark, d):
    return table(spark, d, "companies").select("id", T.website_domain(F.col("website")).alias("domain"))


def country_names(spark, d):
    return _jobs(spark, d, "country").select("id", T.country_name(F.col("country")).alias("name"))


QUERIES = {
    f.__name__: f
    for f in (url_variants, job_signals, duty_lines, job_analysis, normalized_jobs, skill_categories, company_domains, country_names, text_normalize, company_normalize, title_normalize, slug, url_canonical, html_to_text, infer_enums, dedup_groups, duplicate_links, section_counts, skill_extract, years_team, languages_required, salary_parse)
}


def _norm(x: str) -> str:
    spaced = rf"regexp_replace(lower(strip_accents({x})), '[^\pL\pN\pM+#.\s]', ' ', 'g')"
    return rf"coalesce(trim(regexp_replace({spaced}, '[\s\x{{00a0}}]+', ' ', 'g')), '')"


def _word(p: str) -> str:
    return rf"\b(?:{p})\b"


def _title(x: str) -> str:
    bare = rf"regexp_replace(regexp_replace({x}, '\(.*?\)|\[.*?\]', ' ', 'g'), '(?i)\b[mfwdh](?:\s*/\s*[mfwdhx*]){{1,3}}\b', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({_norm(bare)}, '{_word(T.TITLE_NOISE)}', ' ', 'g'), '\s+', ' ', 'g'))"


def _company(x: str) -> str:
    out = rf"trim(regexp_replace(regexp_replace({_norm(x)}, '[.,]', ' ', 'g'), '\s+', ' ', 'g'))"
    for _ in range(3):
        out = rf"regexp_replace({out}, '\s+(?:{T.COMPANY_FORMS})$', '')"
    return f"nullif({out}, '')"


def _url(x: str) -> str:
    base = f"regexp_replace(trim({x}), '#.*$', '')"
    asked = f"[p for p in string_split(regexp_extract({base}, '\\?(.*)$', 1), '&') if p <> '' AND lower(split_part(p, '=', 1)) NOT IN ({', '.join(repr(t) for t in T.TRACKING)})]"
    # keys in order; of equal keys the earlier first, by its place in front of the value
    ordered = f"[y.p for y in list_sort([{{'k': split_part(x, '=', 1), 'i': i, 'p': x}} for x, i in {asked}])]"
    host = f"regexp_replace(lower(regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www\\.', '')"
    path = f"regexp_extract({base}, '^[^:]*://[^/?]*([^?]*)', 1)"
    whole = f"lower(regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || {host} || CASE WHEN {path} = '' AND len({asked}) > 0 THEN '/' ELSE {path} END || CASE WHEN len({asked}) > 0 THEN '?' || array_to_string({ordered}, '&') ELSE '' END"
    return f"CASE WHEN {host} <> '' THEN regexp_replace({whole}, '/$', '') ELSE trim({x}) END"


_URL = f"SELECT id, {_url('url')} AS canonical FROM jobs"


def _plain(x: str) -> str:
    """A description as lines, with the references that feeds use."""
    out = rf"regexp_replace(regexp_replace({x}, '(?i)</?(?:{html.BLOCK_TAGS})(?:\s[^<>]*)?/?>', chr(10), 'g'), '(?s)<!--.*?-->|</?[A-Za-z][^<>]*>', '', 'g')"
    for name, char in html.ENTITIES.items():
        out = f"replace({out}, '&{name};', chr({ord(char)}))"
    for code in (34, 38, 39, 60, 62, 160, 8211, 8217, 8226):
        out = f"replace(replace({out}, '&#{code};', chr({code})), '&#x{code:x};', chr({code}))"
    out = rf"regexp_replace(regexp_replace(replace({out}, '&amp;', '&'), '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({out}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g')"


def _quoted(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _has(name: str) -> str:
    return f"len([c for c in {_quoted(extract.CUES[name])} if contains(head, c)]) > 0"


#: Lines with their section: the last cue so far.
_LINES = rf"""texts AS (SELECT id, {_plain("description")} AS text FROM jobs),
  cut AS (SELECT id, generate_subscripts(l, 1) AS n, trim(unnest(l)) AS line FROM (SELECT id, regexp_split_to_array(regexp_replace(text, '([.;:])\s{{2,}}', '\1' || chr(1), 'g'), '\r?\n|[•·]|\x01') AS l FROM texts) x),
  cued AS (SELECT *, CASE WHEN length(line) <= 60 AND {_has("benefits")} THEN 'benefits' WHEN {_has("preferred")} OR (regexp_matches(head, '^plus\b') AND NOT regexp_matches(head, '^plus\s+(?:stock|equity|bonus)')) THEN 'preferred'
    WHEN {_has("required")} THEN 'required' WHEN {_has("responsibility")} THEN 'responsibility' END AS cue FROM (SELECT *, substr(lower(line), 1, 80) AS head FROM cut WHERE line <> '') y),
  lines AS (SELECT id, n, line, coalesce(last_value(cue IGNORE NULLS) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'other') AS section FROM cued)"""
_BARE = lambda p: p.replace(r"(?<![A-Za-z0-9_])", r"\b").replace(r"(?![A-Za-z0-9_])", r"\b")


def _years(x: str) -> str:
    each = [f"try_cast(nullif(regexp_extract({x}, '{_BARE(p)}', 1), '') AS INT)" for p in extract.YEARS]
    return "CASE " + " ".join(f"WHEN {n} > 0 AND {n} < 40 THEN {n}" for n in each) + " END"


_MARK = f"(?:{extract.CODES})"
_SUM = r"(\d{1,3}(?:[.,  \x{202f}]\d{3})+|\d+(?:\.\d+)?)\s*([kK])?"
_RANGE = rf"(?:\b({extract.CODES})\s*)?([$€£])?\s?{_SUM}\s*(?:{_MARK})?\s*(?:-|–|—|to)\s*(?:\b({extract.CODES})\s*)?([$€£])?\s?{_SUM}(?:\s*({extract.CODES})\b)?"


def _value(n: str, own: str, other: str) -> str:
    bare = f"CASE WHEN regexp_full_match({n}, '\\d{{1,3}}(?:[.,  \\x{{202f}}]\\d{{3}})+') THEN CAST(regexp_replace({n}, '[^0-9]', '', 'g') AS DOUBLE) ELSE try_cast({n} AS DOUBLE) END"
    return f"CASE WHEN {own} <> '' OR ({other} <> '' AND {bare} < 1000) THEN {bare} * 1000 ELSE {bare} END"


def _language(names: str) -> str:
    each = names.split("|")
    latin, other = [n for n in each if n[0] < "ɐ"], [n for n in each if n[0] >= "ɐ"]
    return "(?:" + "|".join([*[rf"\b(?:{'|'.join(latin)})\b"] * bool(latin), *other]) + ")"


def _spoken(names: str) -> str:
    n, before, after = _language(names), rf"(?:\b(?:{extract.FLUENT[0]})\b|{extract.FLUENT[1]})", rf"(?:\b(?:{extract.LEVEL[0].replace('[a-z0-9_]*', 'X')})\b|{extract.LEVEL[1]})".replace("X", "[a-z0-9_]*")
    return f"CASE WHEN regexp_matches(l, '{before}[^.;:。\\n]{{0,60}}{n}|{n}[^.;:。\\n]{{0,30}}{after}') THEN 5 WHEN section IN ('required', 'preferred') AND regexp_matches(l, '{n}') THEN 4 END"


_CASES = lambda x, steps: " ".join(rf"WHEN regexp_matches({x}, '{_word(p)}') THEN '{n}'" for n, p in steps)
_YEARS = r"try_cast(regexp_extract(body, '(\d{1,4})\+?\s*(?:years|yrs|anos)', 1) AS INT)"
ORACLES = {
    "text_normalize": f"SELECT id, {_norm('title')} AS normal FROM jobs",
    "company_normalize": f"SELECT id, {_company('company_name')} AS normal FROM jobs",
    "title_normalize": f"SELECT id, {_title('title')} AS normal FROM jobs",
    "slug": "SELECT id, slug FROM skills",
    "url_canonical": _URL,
    "url_variants": f"SELECT id, {_url("bare || '/?b=2&a=1&b=0&Ref=x&A=3&utm_source=y#frag'")} AS with_query, {_url("bare || '/#frag'")} AS with_slash FROM (SELECT id, regexp_extract(url, '^[^?#]*') AS bare FROM jobs) u",
    "html_to_text": f"SELECT id, {_plain('description')} AS text FROM jobs",
    "section_counts": f"WITH {_LINES} SELECT section, count(*) AS lines, sum(length(line)) AS chars FROM lines GROUP BY section",
    "duty_lines": f"""WITH {_LINES}, kept AS (SELECT id, n, trim(regexp_replace(line, '[\\s\\x{{00a0}}]+', ' ', 'g')) AS line FROM lines WHERE section = 'responsibility')
      SELECT id, k, line FROM (SELECT id, line, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS k FROM kept WHERE length(line) > 12 AND length(line) < 220) z WHERE k < 12""",
    "years_team": f"""SELECT id, {_years("text")} AS years, try_cast(nullif(concat(regexp_extract(text, '{_BARE(extract.TEAM)}', 1), regexp_extract(text, '{_BARE(extract.TEAM)}', 2)), '') AS INT) AS team,
      coalesce(regexp_matches(text, '{_BARE(extract.LEADS)}'), false) AS leads FROM (SELECT id, {_plain("description")} AS text FROM jobs) t""",
    "skill_extract": f"""WITH {_LINES},
      w AS (SELECT id, CASE section WHEN 'required' THEN 3 WHEN 'preferred' THEN 2 ELSE 1 END AS rank, [x for x in regexp_split_to_array(regexp_replace(lower(line), '[^\\pL\\pN+#./ -]+', ' ', 'g'), '\\s+') if x <> ''] AS words FROM lines),
      t AS (SELECT id, rank, array_to_string(words[i:i + k], ' ') AS term FROM w, range(1, 200) r(i), range(0, 3) q(k) WHERE i + k <= len(words)),
      e AS (SELECT DISTINCT id, rank, unnest([term, regexp_replace(term, '[.,;:/-]+$', '')]) AS term FROM t),
      f AS (SELECT id, rank, regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(term)), '\\.js\\b', 'js', 'g'), '[^a-z0-9+#]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM e)
      SELECT f.id, s.slug, CASE max(rank) WHEN 3 THEN 'explicit_required' WHEN 2 THEN 'explicit_preferred' ELSE 'mentioned' END AS mention_type FROM f JOIN skills s USING (slug) GROUP BY f.id, s.slug""",
    "languages_required": f"""WITH {_LINES}, l AS (SELECT id, section, lower(line) AS l FROM lines WHERE section <> 'benefits'),
      r AS ({" UNION ALL ".join(f"SELECT id, '{c}' AS code, section, {_spoken(n)} AS rank FROM l" for c, n in extract.LANGUAGES.items())})
      SELECT id, code, CASE max(rank) WHEN 5 THEN 'c1' ELSE 'b2' END AS level, bool_or(section <> 'preferred') AS required FROM r WHERE rank IS NOT NULL GROUP BY id, code""",
    "salary_parse": f"""WITH m AS (SELECT id, evidence AS t, regexp_extract(evidence, '{_RANGE}', ['c1', 's1', 'a', 'ka', 'c2', 's2', 'b', 'kb', 'c3']) AS g, regexp_extract(evidence, '{_RANGE}') AS m FROM compensation_observations WHERE regexp_matches(evidence, '{_RANGE}')),
      v AS (SELECT id, t, m, coalesce(nullif(g.c1, ''), nullif(g.c2, ''), nullif(g.c3, ''), CASE coalesce(nullif(g.s1, ''), nullif(g.s2, '')) WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' END) AS currency,
        {_value("g.a", "g.ka", "g.kb")} AS x, {_value("g.b", "g.kb", "g.ka")} AS y, substr(t, greatest(1, strpos(t, m) - 70), least(70, strpos(t, m) - 1) + length(m) + 60) AS near, substr(t, strpos(t, m) + length(m)) AS rest FROM m)
      SELECT id, least(x, y) AS low, greatest(x, y) AS high, currency, {"CASE " + " ".join(f"WHEN regexp_matches(near, '(?i)\\b(?:{w})\\b') THEN '{p}'" for p, w in extract.PERIOD_WORDS.items())} WHEN greatest(x, y) < 500 THEN 'hour' WHEN greatest(x, y) < 20000 THEN 'month' ELSE 'year' END AS period
      FROM v WHERE currency IS NOT NULL AND x > 0 AND y > 0 AND NOT regexp_matches(rest, '{_BARE(extract.NOT_PAY)}')""",
    "skill_categories": "SELECT id, CASE " + " ".join(f"WHEN regexp_matches(lower(name), '{p}') THEN '{k}'" for k, p in T.CATEGORIES) + " ELSE 'other' END AS category FROM skills",
    "company_domains": r"SELECT id, nullif(regexp_replace(lower(regexp_extract(website, '^(?:https?://)?([^/?#:]+)', 1)), '^www\.', ''), '') AS domain FROM companies",
    "country_names": "SELECT j.id, CASE WHEN j.country <> '' THEN coalesce(c.name, lower(strip_accents(trim(j.country)))) END AS name FROM jobs j LEFT JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in T.COUNTRY_CODES.items()) + ") c(code, name) ON c.code = lower(trim(j.country))",
    "normalized_jobs": rf"""WITH n AS (SELECT id, trim(regexp_replace(title, '[\s\x{{00a0}}]+', ' ', 'g')) AS title, company_name, location, url, {_plain("description")} AS text FROM jobs),
      k AS (SELECT *, {_norm("title")} AS t, {_norm("text")} AS body, concat_ws(' ', {_norm("location")}, {_norm("substr(concat_ws(' ', title, coalesce(text, '')), 1, 4000)")}) AS place, {_norm("substr(concat_ws(' ', title, coalesce(text, '')), 1, 4000)")} AS head FROM n)
      SELECT id, title, {_title("title")} AS normal_title, {_company("company_name")} AS normal_company, {_url("url")} AS canonical_url,
        CASE WHEN regexp_matches(place, '\b(?:hybrid|hibrido)\b') THEN 'hybrid' WHEN regexp_matches(place, '\b(?:remote|remoto|work from home|wfh|distributed)\b') THEN
          CASE WHEN regexp_matches(place, '\b(?:on[- ]?site|in[- ]?office)\b') AND NOT regexp_matches(place, '\b(?:remote first|fully remote)\b') THEN 'hybrid' ELSE 'remote' END
          WHEN regexp_matches(place, '\b(?:on[- ]?site|in[- ]?office|presencial)\b') THEN 'onsite' ELSE 'unknown' END AS work_mode,
        CASE {_CASES("t", T.SENIORITY)} WHEN {_YEARS.replace("body", "substr(body, 1, 3000)")} >= 8 THEN 'senior' WHEN {_YEARS.replace("body", "substr(body, 1, 3000)")} >= 4 THEN 'mid' WHEN {_YEARS.replace("body", "substr(body, 1, 3000)")} >= 1 THEN 'junior' ELSE 'unknown' END AS seniority,
        CASE {_CASES("head", T.EMPLOYMENT)} ELSE 'unknown' END AS employment_type,
        CASE WHEN {_company("company_name")} IS NOT NULL AND {_title("title")} <> '' THEN sha256({_company("company_name")} || '|' || {_title("title")}) ELSE sha256('url|' || coalesce({_url("url")}, '')) END AS dedup_key FROM k""",
    "infer_enums": rf"""SELECT id, CASE {_CASES("t", T.SENIORITY)} WHEN {_YEARS} >= 8 THEN 'senior' WHEN {_YEARS} >= 4 THEN 'mid' WHEN {_YEARS} >= 1 THEN 'junior' ELSE 'unknown' END AS seniority,
      CASE WHEN regexp_matches(place, '\b(?:hybrid|hibrido)\b') THEN 'hybrid' WHEN regexp_matches(place, '\b(?:remote|remoto|work from home|wfh|distributed)\b') THEN
        CASE WHEN regexp_matches(place, '\b(?:on[- ]?site|in[- ]?office)\b') AND NOT regexp_matches(place, '\b(?:remote first|fully remote)\b') THEN 'hybrid' ELSE 'remote' END
        WHEN regexp_matches(place, '\b(?:on[- ]?site|in[- ]?office|presencial)\b') THEN 'onsite' ELSE 'unknown' END AS work_mode,
      CASE {_CASES("t", T.EMPLOYMENT)} ELSE 'unknown' END AS employment_type
      FROM (SELECT id, {_norm("title")} AS t, {_norm("concat_ws(' ', location, title)")} AS place, substr({_norm("description")}, 1, 3000) AS body FROM jobs)""",
    "dedup_groups": f"""WITH k AS (SELECT j.id, CASE WHEN {_company("company_name")} IS NOT NULL AND {_title("title")} <> '' THEN sha256({_company("company_name")} || '|' || {_title("title")}) ELSE sha256('url|' || coalesce(u.canonical, '')) END AS key
      FROM jobs j JOIN ({_URL}) u ON u.id = j.id) SELECT key, count(*) AS n, min(id) AS first_id FROM k GROUP BY key HAVING count(*) > 1""",
}
