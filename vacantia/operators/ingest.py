"""Raw postings to normalised ones, and their upsert into a keyed snapshot with versions, in one pass over a batch.

A batch is taken in order of arrival (`seq`, unique within a source). Within a source a posting is known by its external
id; a record without one, or one that meets a posting stored without one, is known by its URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions import text as T
from vacantia.operators.extract import plain

#: Columns that an update overwrites, and those that keep their value where the update has none.
OVERWRITTEN = ("url", "canonical_url", "title", "normal_title", "location", "work_mode", "content_hash", "dedup_key", "seniority", "employment_type")
KEPT = ("company_name", "country", "remote_scope", "description", "posted_at", "language")


def _given(column: str, inferred: Column) -> Column:
    return F.when(F.coalesce(F.col(column), F.lit("unknown")).isin("unknown", ""), inferred).otherwise(F.col(column))


def normalised(raw: DataFrame) -> DataFrame:
    """Raw postings with their normal forms, inferred enums, content hash and dedup key. Given values beat inferred ones.

    Wants id, source_id, external_id, url, title, company_name, location, country, description,
    posted_at, work_mode, seniority, employment_type, remote_scope, language; null titles count as empty.
    """
    shown = raw.withColumns({
        "external_id": F.when(F.col("external_id") != "", F.col("external_id")), "title": F.coalesce(T.collapse(F.col("title")), F.lit("")), "company_name": T.collapse(F.col("company_name")),
        "location": T.collapse(F.col("location")), "country": T.collapse(F.col("country")), "description": plain(F.col("description")), "canonical_url": T.canonical_url(F.col("url")), "url": F.trim("url"),
    })
    # the folds are one Arrow pass; each is used several times below
    folded = shown.withColumns({
        "normal_title": T.title(F.col("title")), "normal_company": T.company(F.col("company_name")), "normal_location": T.normalize(F.col("location")), "n_title": T.normalize(F.col("title")),
        "n_body": T.normalize(F.col("description")), "n_head": T.normalize(F.substring(F.concat_ws(" ", "title", F.coalesce("description", F.lit(""))), 1, 4000)),
    })
    modes = T.work_mode(F.concat_ws(" ", "normal_location", "n_head"))
    out = folded.withColumns({"work_mode": _given("work_mode", modes), "seniority": _given("seniority", T.seniority(F.col("n_title"), F.col("n_body"))), "employment_type": _given("employment_type", T.employment(F.col("n_head")))})
    body = F.when(F.col("description") != "", F.sha2(F.col("n_body"), 256))
    none = F.lit(None).cast("string")
    hashed = T.content_hash(F.col("normal_title"), F.col("normal_company"), F.col("normal_location"), F.col("work_mode"), body, none, F.col("employment_type"))
    return out.withColumns({"content_hash": hashed, "dedup_key": T.dedup_key(F.col("normal_company"), F.col("normal_title"), F.col("canonical_url"))}).drop("n_title", "n_body", "n_head", "normal_location")


def identified(records: DataFrame) -> DataFrame:
    """(seq, source_id, external_id, canonical_url, ...) with `root`: the seq of the record that created the posting it belongs to.

    A URL whose first record has no external id belongs to that record's posting, for all later
    records whose own id has no posting yet; a record without an id joins the first at its URL.
    """
    by_url, by_id = Window.partitionBy("source_id", "canonical_url").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.partitionBy("source_id", "external_id")
    first = records.withColumns({"url_first": F.first("seq").over(by_url), "url_open": F.first(F.col("external_id").isNull()).over(by_url)})
    adopted = F.col("url_open") & (F.col("url_first") < F.col("seq"))
    own = first.filter("external_id is not null").withColumn("created", F.min(F.when(~adopted, F.col("seq"))).over(by_id))
    own = own.withColumn("root", F.when(F.col("created") <= F.col("seq"), F.col("created")).otherwise(F.col("url_first"))).drop("created")
    bare = first.filter("external_id is null")
    # who owns the first record at the URL owns the bare ones that follow
    roots = own.filter("seq = url_first").select("source_id", "url_first", F.col("root").alias("owner"))
    bare = bare.join(roots, ["source_id", "url_first"], "left").withColumn("root", F.coalesce("owner", "url_first")).drop("owner")
    return own.unionByName(bare).drop("url_first", "url_open")


def outcomes(records: DataFrame) -> DataFrame:
    """Identified records with `outcome`: created, unchanged (same content as before) or updated, and the version it makes."""
    order = Window.partitionBy("source_id", "root").orderBy("seq")
    before = F.lag("content_hash").over(order)
    out = records.withColumn("outcome", F.when(F.col("seq") == F.col("root"), "created").when(before == F.col("content_hash"), "unchanged").otherwise("updated"))
    return out.withColumn("version", F.when(F.col("outcome") != "unchanged", F.sum((F.col("outcome") != "unchanged").cast("int")).over(order)))


def snapshot(records: DataFrame) -> DataFrame:
    """Outcomes to one row a posting: its id is its root, columns as the updates left them, first and last seen."""
    changed = F.col("outcome") != "unchanged"
    last = [F.max_by(c, F.when(changed, F.col("seq"))).alias(c) for c in OVERWRITTEN]
    kept = [F.max_by(c, F.when(changed & F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in KEPT]
    return records.groupBy("source_id", "root").agg(F.min_by("external_id", "seq").alias("external_id"), *last, *kept, F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max("version").alias("versions"))


def pay_of(records: DataFrame, raw_pay: DataFrame) -> DataFrame:
    """Explicit pay of records, (source_id, seq, low, high, currency, period), with a bound and a currency: by posting, each once."""
    priced = raw_pay.filter("coalesce(low, high) is not null and currency is not null and currency <> ''").withColumn("period", T.pay_period(F.col("period")))
    rows = priced.join(records.select("source_id", "seq", "root"), ["source_id", "seq"])
    return rows.groupBy("source_id", "root", "low", "high", "currency", "period").agg(F.min("seq").alias("seq"))
