import random

from pyspark.sql import functions as F

from tests.conftest import SMALL
from vacantia.functions import html, text
from vacantia.operators import extract, resolve, transitions
from vacantia.sources import feeds
from vacantia.streaming import streams


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_displayed(spark):
    assert one(spark, html.displayed, "<p>a&nbsp;&amp;lt; &#39;b&#x27;</p><b>c</b>") == "\n\na &lt; 'b'\n\nc"
    assert one(spark, html.displayed, None) is None and one(spark, html.displayed, "") == ""


def test_names(spark):
    assert one(spark, text.company, "Ámbar Labs, Inc.") == "ambar labs" and one(spark, text.title, "Senior Dév (m/f/d) [x] remote") == "senior dev"
    assert one(spark, text.canonical_url, "https://www.Ex.com/a/?b=2&utm_source=x&a=1#f") == "https://ex.com/a/?a=1&b=2" and one(spark, text.canonical_url, " not a url ") == "not a url"
    urls = {"https://ex.com/": "https://ex.com", "https://ex.com/a/": "https://ex.com/a", "https://ex.com/?a=1": "https://ex.com/?a=1", "https://ex.com/a?b=1&a=2&b=0": "https://ex.com/a?a=2&b=1&b=0", "https://ex.com/x?q=a/": "https://ex.com/x?q=a"}
    assert {u: one(spark, text.canonical_url, u) for u in urls} == urls and one(spark, text.canonical_url, None) is None
    assert one(spark, text.slug, "Node.js") == "nodejs" and one(spark, text.country_name, "MX") == "mexico" and one(spark, text.country_name, "México") == "mexico" and one(spark, text.country_name, "") is None
    assert one(spark, text.skill_category, "Next.js") == "framework" and one(spark, text.skill_category, "Go") == "language" and one(spark, text.pay_period, "Hourly") == "hour" and one(spark, text.pay_period, None) == "year"
    assert one(spark, text.website_domain, "www.Ex.com/a") == "ex.com" and one(spark, text.website_domain, "https://x y") is None


def test_feed_instants(spark):
    at = {"1700000000": 1_700_000_000_000_000, "1700000000123": 1_700_000_000_123_000, "2024-01-02T03:04:05Z": 1_704_164_645_000_000, "2024-01-02": 1_704_153_600_000_000, "soon": None, "": None, None: None, "9" * 30: None}
    assert {x: one(spark, lambda c: F.unix_micros(text.unix_or_iso(c)), x) for x in at} == at


def test_extraction(spark):
    pay = {
        "We pay $150 - 210K per year": (150000.0, 210000.0, "USD", "year"), "raised $5-10 million": None, None: None, "": None, "5 - 10 years": None, "EUR 3.500 – 4.200 monthly": (3500.0, 4200.0, "EUR", "month"),
        "60 to 80 USD": (60.0, 80.0, "USD", "hour"), "£90,000-£70,000": (70000.0, 90000.0, "GBP", "year"), "$1-2 million raised. Pay: $100k to $120k": (100000.0, 120000.0, "USD", "year"), "$0 - 10": None, "x" * 50_000: None,
    }
    found = extract.pay_in(spark.createDataFrame([(i, x, "clash") for i, x in enumerate(pay)], "id long, text string, low string"))
    got = {r["id"]: (r["low"], r["high"], r["currency"], r["period"]) for r in found.collect()}
    assert {x: got.get(i) for i, x in enumerate(pay)} == pay
    df = spark.createDataFrame([(1, "Requirements\nGo and Rust\nNice to have\nKotlin\nPerks\nfruit"), (2, None)], "id long, text string")
    assert {r["line"]: r["section"] for r in extract.sections(df).collect()}["Kotlin"] == "preferred"
    skills = spark.createDataFrame([("go", "Go"), ("kotlin", "Kotlin"), ("c", "C")], "slug string, name string")
    assert {(r["slug"], r["mention_type"]) for r in extract.skills_in(df, skills).collect()} == {("go", "explicit_required"), ("kotlin", "explicit_preferred")}
    more = spark.createDataFrame([(1, "Requirements\nk8s, CI/CD and Node.js (plus Málaga) . / Go-lang. C#"), (2, ""), (3, "Go " * 3000)], "id long, text string")
    names = spark.createDataFrame([("kubernetes",), ("ci-cd",), ("nodejs",), ("malaga",), ("c#",), ("go",), ("c",), ("node",)], "slug string")
    other = spark.createDataFrame([("k8s", "kubernetes"), ("c#", "c")], "normal_alias string, slug string")
    found = {(r["id"], r["slug"]) for r in extract.skills_in(more, names, other).collect()}
    assert found == {(1, x) for x in ("kubernetes", "ci-cd", "nodejs", "malaga", "c#")} | {(3, "go")}
    assert one(spark, extract.years_required, "at least 7 years") == 7


def test_languages_as_in_the_reference(spark):
    names = "en english,es spanish,es español,es castellano,pt portuguese,pt português,pl polish,de german,de deutsch,fr french,fr français,nl dutch,it italian,sv swedish,cs czech,ro romanian,ru russian,uk ukrainian,tr turkish,ar arabic,he hebrew,hi hindi,ja japanese,ja 日本語,ko korean,ko 한국어,zh mandarin,zh chinese,zh 中文"
    rows, want = [], {}
    for code, name in (x.split() for x in names.split(",")):
        for text, level in ((f"Strong {name.upper()}", "c1"), (f"{name} at N2", "c1"), (f"Requirements\n{name}", "b2"), (f"We like {name}", None), (f"Perks\nfluent {name}", None)):
            rows.append((len(rows), text))
            want |= {(rows[-1][0], code): (level, True)} if level else {}
    for text, found in (
        ("Nice to have\nprofessional Turkish", {"tr": ("c1", False)}), ("ネイティブの日本語", {"ja": ("c1", True)}), ("日本語ビジネスレベル", {"ja": ("c1", True)}), ("流暢な中文", {"zh": ("c1", True)}), ("Business level Korean", {"ko": ("c1", True)}),
        ("fluent. English", {}), ("native " + "x" * 70 + " English", {}), ("Dutch " + "x" * 40 + " native", {}), ("Fluency in Polish and English (minimum C1 level)", {"pl": ("c1", True), "en": ("c1", True)}), ("strong englishman", {}),
    ):
        rows.append((len(rows), text))
        want |= {(rows[-1][0], c): v for c, v in found.items()}
    got = extract.languages_in(spark.createDataFrame(rows, "id long, text string")).collect()
    assert {(r["id"], r["code"]): (r["level"], r["required"]) for r in got} == want


def test_leads_by_every_wording(spark, tmp_path):
    from vacantia.plans import texts

    said = ["leading a team", "Head of Engineering", "a Staff+ role", "staff", "principal engineer", "tech lead", "staffing", "principal engineers"]
    spark.createDataFrame(list(enumerate(said)), "id long, description string").write.parquet(f"{tmp_path}/jobs.parquet")
    assert {r["id"] for r in texts.years_team(spark, str(tmp_path)).collect() if r["leads"]} == set(range(6))


def sequential(rows):
    """The rule one row at a time."""
    canonical, out = [], {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        hit = [c for c in canonical if c[5] and ((c[3] == r[3] and c[2] != r[2]) or c[4] == r[4])]
        if hit:
            out[r[0]] = hit[0][0]
        else:
            canonical.append(r)
            out[r[0]] = None
    return out


def test_duplicate_links_equal_the_sequential_rule(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(9), rng.randrange(3), f"u{rng.randrange(8)}", f"k{rng.randrange(9)}", rng.random() < 0.8) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, at long, source_id long, url string, key string, active boolean")
    assert {r["id"]: r["canonical_id"] for r in resolve.duplicate_links(df).collect()} == sequential(rows)


def test_fold_takes_only_allowed_edges(spark):
    rows = [(1, 1, "2024-01-01", "MATCHED"), (1, 2, "2024-01-02", "READY"), (1, 3, "2024-01-03", "SELECTED"), (2, 4, "2024-01-01", "OFFER")]
    df = spark.createDataFrame(rows, "job_id long, event_id long, ts string, to_status string")
    assert {r["job_id"]: (r["status"], r["accepted"]) for r in transitions.fold(df).collect()} == {1: ("SELECTED", 2), 2: ("DISCOVERED", 0)}


def test_feeds(spark):
    payload = lambda *t: spark.createDataFrame([(x,) for x in t], "payload string")
    r = feeds.postings(payload('[{"legal":"notice"},{"id":"7","position":"Dev","company":"A","location":""}]'), "remoteok").collect()
    assert [(x["external_id"], x["remote_scope"]) for x in r] == [("7", "Worldwide")]
    broken = feeds.postings(payload("not json", '{"company":"A","jobs":[]}', '{"company":"A","jobs":[{"id":1,"title":"Dev","location":{"name":"Remote, EU"},"content":"&lt;p&gt;a&amp;amp;b&lt;/p&gt;"}]}'), "greenhouse").collect()
    assert {(x["_corrupt"], x["title"], x["work_mode"], x["description"]) for x in broken} == {("not json", None, None, None), (None, "Dev", "remote", "<p>a&amp;b</p>")}
    x = feeds.rss(payload("<rss><item><title><![CDATA[Acme: Dev]]></title><link>u</link><guid>g</guid></item></rss>"), "weworkremotely").first()
    assert (x["company_name"], x["title"], x["external_id"]) == ("Acme", "Dev", "g")
    ashby = '{"company":"A","jobs":[{"id":"1","title":"T","employmentType":"FullTime","isRemote":true,"compensation":{"summaryComponents":[{"compensationType":"Equity"},{"compensationType":"Salary","minValue":10,"maxValue":20,"currencyCode":"EUR","interval":"1 MONTH"}]}}]}'
    x = feeds.postings(payload(ashby), "ashby").first()
    assert (x["salary_min"], x["salary_currency"], x["salary_period"], x["employment_type"], x["work_mode"]) == (10.0, "EUR", "month", "full_time", "remote")
    places = '{"name":"W","jobs":[{"shortcode":"a","title":"T","telecommuting":true,"country":"US","locations":[{"city":"X","country":"US"}]},{"shortcode":"b","title":"T","telecommuting":true,"locations":[{"country":"US"},{"country":"CA"}]},{"shortcode":"c","title":"T","telecommuting":false,"city":"Q","country":"MX"}]}'
    assert [(x["location"], x["country"]) for x in feeds.postings(payload(places), "workable").orderBy("external_id").collect()] == [("Remote", None), ("US; CA", None), ("Q, MX", "MX")]
    bamboo = '{"company":"B","result":[{"id":"1","jobOpeningName":"T","locationType":"1","atsLocation":{"country":"US"}},{"id":"2","jobOpeningName":"T","locationType":"2","location":{"city":"X","addressCountry":"MX"}}]}'
    assert [(x["work_mode"], x["country"], x["location"]) for x in feeds.postings(payload(bamboo), "bamboohr").orderBy("external_id").collect()] == [("remote", None, "US"), ("hybrid", "MX", "X, MX")]
    twice = '{"site":"mx-es","data":[{"ref":"9-en_GB","title":"first","description":"Modalidad de trabajo: Híbrido"},{"ref":"9-en_US","title":"second"},{"ref":"8-en","title":"gone","deleted_at":"x"}]}'
    assert [(x["external_id"], x["title"], x["country"], x["work_mode"]) for x in feeds.postings(payload(twice), "capgemini").collect()] == [("mx-es:9", "first", "Mexico", "hybrid")]


def test_salary_texts(spark):
    want = {"$90,000 - $120,000": (90000.0, 120000.0, "USD", "year"), "EUR 4k-5.5k / month": (4000.0, 5500.0, "EUR", "month"), "competitive": None, "100-200 USD": None, None: None, "": None}
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(want)], "i int, x string").select("i", feeds.parse_salary(F.col("x")).alias("p")).orderBy("i").collect()
    assert [tuple(r["p"]) if r["p"] else None for r in rows] == list(want.values())


def test_hiring_comments(spark):
    texts = {
        "Acme | Dev | Remote\nmore": ("Acme", "Dev", "Remote"), "no header": None, "Acme | Berlin | Sr. Backend Engineer | $100k | ONSITE": ("Acme", "Sr. Backend Engineer", "Berlin"), "Stack | https://s.io | /^Full-?stack Engineer$/i": ("Stack", "Full-stack Engineer", None),
        "Acme | Engineer, Data. We build things " + "x " * 80 + " | Remote": ("Acme", "Engineer, Data", "Remote"), "\n  \nAcme | A lead engineer of many words | Lead": ("Acme", "Lead", None), None: None, "": None, "https://a.com": None,
    }
    got = {r["external_id"]: (r["company_name"], r["title"], r["location"]) for r in feeds.hiring_comments(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    assert {x: got.get(str(i)) for i, x in enumerate(texts)} == texts


def test_country_facets(spark):
    facets = '[{"facetParameter":"locationMainGroup","values":[{"facetParameter":"locations","values":[{"id":"1","descriptor":"Apodaca-Mexico"},{"id":"2","descriptor":"Santa Fe, New Mexico"}]},{"facetParameter":"country","values":[{"id":"c1","descriptor":"Mexico"}]}]}]'
    df = spark.createDataFrame([(facets,), ("broken",), (None,)], "x string")
    assert [r["y"] for r in df.select(feeds.country_facets(F.col("x"), "Mexico").alias("y")).collect()] == [["locations=1"], [], []]
    assert df.select(feeds.country_facets(F.col("x"), "Mexico", "c1").alias("y")).first()["y"] == ["country=c1"]


def sequential_ingest(records):
    """The rule one record at a time: which posting each belongs to, and what it does there."""
    rows, out = [], {}
    for seq, source, ext, url, content in sorted(records):
        hit = next((r for r in rows if ext and r["source"] == source and r["ext"] == ext), None)
        hit = hit or next((r for r in rows if r["source"] == source and url in r["urls"] and (r["ext"] is None or ext is None)), None)
        if hit is None:
            rows.append({"source": source, "ext": ext, "urls": {url}, "root": seq, "content": content})
            out[seq] = (seq, "created")
        else:
            out[seq] = (hit["root"], "unchanged" if hit["content"] == content else "updated")
            hit["content"] = content
    return out


def test_ingest_equals_the_sequential_rule(spark):
    from vacantia.operators import ingest

    rng = random.Random(8)
    for _ in range(4):
        records, url_of = [], {}
        for i in range(60):
            ext = rng.choice([None, *"abcdef"])
            url = url_of.setdefault(ext, f"u{rng.randrange(5)}") if ext else f"u{rng.randrange(5)}"
            records.append((i, rng.randrange(2), ext, url, f"c{rng.randrange(3)}"))
        df = spark.createDataFrame(records, "seq long, source_id long, external_id string, canonical_url string, content_hash string")
        got = {r["seq"]: (r["root"], r["outcome"]) for r in ingest.outcomes(ingest.identified(df)).collect()}
        assert got == sequential_ingest(records)
    # the same numbers in another source are other records
    both = df.unionByName(df.withColumn("source_id", F.col("source_id") + 7))
    again = ingest.outcomes(ingest.identified(both)).groupBy("seq", "root", "outcome").count().collect()
    assert {r["seq"]: (r["root"], r["outcome"]) for r in again} == sequential_ingest(records) and {r["count"] for r in again} == {2}


def test_signals(spark):
    from vacantia.operators import signals

    texts = {
        "This role can be performed remotely for candidates located in Ontario, Canada. More.": ("Ontario, Canada", "This role can be performed remotely for candidates located in Ontario, Canada."),
        "Candidates must be located in the United States and we pay well": ("United States", "Candidates must be located in the United States and we pay well"),
        "You must be located in Anywhere land": None, "Location: Remote\nIreland is nice": None, "Location: Remote - US": ("US", "Location: Remote - US"), "must reside in Gondor. US-based candidates only": ("US", "US-based candidates only"), None: None, "": None, "y" * 20_000: None,
    }
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)], "id long, text string, scope string")
    got = {r["id"]: (r["scope"]["value"], r["scope"]["evidence"]) for r in signals.body_signals(df).filter("scope is not null").collect()}
    assert {x: got.get(i) for i, x in enumerate(texts)} == texts
    said = "We work in CET +/- 3 hours, we are unable to consider others. 2 days a week in our office. Right to work in Mexico. Any country where we have a legal entity."
    r = signals.body_signals(spark.createDataFrame([(1, said)], "id long, text string"), ("LEGAL entity", "none")).first()
    assert (r["window"]["zone"], r["window"]["offset"], r["window"]["plus_minus"], r["window"]["hard"]) == ("CET", 1, 3, True)
    assert r["office"] == "2 days a week in our office." and r["authorisation"] == "Right to work in Mexico" and r["entity"].startswith("Any country") and r["practice"] == ["LEGAL entity"]
    d = signals.duties(spark.createDataFrame([(1, "Responsibilities\nshort\nBuild  the thing well\nPerks\nfruit every single day")], "id long, text string")).first()
    assert d["duties"] == ["Responsibilities", "Build the thing well"]


def test_stream_equals_batch(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    assert streams.daily_events(spark, SMALL).agg(F.sum("n")).first()[0] == events.count()
    assert streams.accepted_events(spark, SMALL).count() == events.count()


def test_core_does_not_name_the_subpackage():
    from pathlib import Path

    import __spark_entry__ as e

    core = [p for p in Path(e.__file__).with_name("vacantia").rglob("*.py") if p.parent.name != "llm"]
    assert len(core) > 20 and not [p.name for p in core if "vacantia.llm" in p.read_text()]

    assert len(e.queries()) > 60 and set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
