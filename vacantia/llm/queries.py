"""Queries of the operators for training text (problems 2, 3, 4, 6, 8, 9 and 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions.html import with_displayed
from vacantia.llm import canonical, language, lookalike, neardup, packing, survivor, tokens
from vacantia.session import settle, table


def _languages(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs").select("id", language.label_code(F.col("language")).alias("code"), "description")
    # read by the count, the sample and the scoring: the texts are displayed and cut once
    cut = settle(language.paragraphs(jobs, "description").select("id", "code", "parts"), "paragraphs")
    found = language.identify(cut, language.train(cut))
    return found.join(cut.select("id", F.col("code").alias("stored")), "id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _languages(spark, d)
    mixed = F.size(F.array_distinct("langs")) > 1
    wrong = ~F.coalesce(F.col("stored") == F.col("lang"), F.lit(False))
    whole = F.when(wrong, F.array(F.struct(F.lit(0).cast("long").alias("seg_no"), F.col("lang").alias("lang"))))
    each = F.when(mixed, F.transform("langs", lambda x, i: F.struct((i + 1).cast("long").alias("seg_no"), x.alias("lang"))))
    none = F.array().cast("array<struct<seg_no:bigint,lang:string>>")
    out = rows.select(F.col("id").alias("job_id"), F.explode(F.concat(F.coalesce(whole, none), F.coalesce(each, none))).alias("x"))
    return out.select("job_id", "x.seg_no", "x.lang")


def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    """The language of each posting and of its paragraphs, with confidences."""
    return _languages(spark, d).select(F.col("id").alias("job_id"), "stored", "lang", "confidence", "langs", "sure")


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("id", F.concat_ws(" ", "title", "company_name").alias("head"), F.col("description").alias("body"))


#: Words to a sequence, words that a description needs, and the similarity asked for.
_P3 = {"width": 3, "min_words": 40, "threshold": 0.6, "shown": lambda texts: with_displayed(texts, "body")}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = neardup.link(_postings(spark, d), **_P3)
    return neardup.all_pairs(members, links).select(F.col("x").alias("job_id_a"), F.col("y").alias("job_id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each posting with its group of near-duplicates and its number of links."""
    members, links = neardup.link(_postings(spark, d), **_P3)
    return neardup.groups(members, settle(links, "links")).withColumnRenamed("id", "job_id")


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """Links of the postings whose id is divisible by 20, by brute force against all rows, and how many of them are found: one row."""
    texts = _postings(spark, d)
    members, links = neardup.link(texts, **_P3)
    found = neardup.all_pairs(members, links).select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p")).select("p.*").filter("x % 20 = 0")
    true = neardup.brute_force(texts, texts.filter("id % 20 = 0"), **_P3)
    both = true.join(found.withColumn("hit", F.lit(1)), ["x", "y"], "left")
    return both.agg(F.count(F.lit(1)).alias("links"), F.count("hit").alias("found"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "job_skills").filter("skill_id is null and raw_form is not null").select(F.col("id").alias("job_skill_id"), F.col("raw_form").alias("value"))
    entries = table(spark, d, "skills").select(F.col("id").alias("entry_id"), "name")
    found = canonical.match(rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).select("value"), entries)
    return rows.join(found, "value").select("job_skill_id", F.col("entry_id").alias("skill_id"))


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Typed values that mean no entry, by anti-join, with how often they occur."""
    rows = table(spark, d, "job_skills").filter("skill_id is null and raw_form is not null").groupBy(F.col("raw_form").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    found = canonical.match(rows.select("value"), table(spark, d, "skills").select(F.col("id").alias("entry_id"), "name"))
    blank = r"^[\s\u00a0\u3000\u200b\ufeff]*$"
    return rows.filter(~F.col("value").rlike(blank)).join(found.filter("entry_id <> -1"), "value", "left_anti").select("value", "n")


_P4 = canonical.match_oracle("SELECT DISTINCT raw_form AS value FROM job_skills WHERE skill_id IS NULL AND raw_form IS NOT NULL", "SELECT id AS entry_id, name FROM skills")
_P4_ORACLES = {
    "p4_found": f"SELECT j.id AS job_skill_id, f.entry_id AS skill_id FROM job_skills j JOIN ({_P4}) f ON j.raw_form = f.value WHERE j.skill_id IS NULL",
    "p4_unmatched": f"SELECT f.value, count(*) AS n FROM job_skills j JOIN ({_P4}) f ON j.raw_form = f.value WHERE j.skill_id IS NULL AND f.entry_id = -1 GROUP BY f.value",
}


def _survivors(spark: SparkSession, d: str, prior: str) -> DataFrame:
    used = ["id", "source_id", "duplicate_of_job_id", "last_seen_at", *survivor.FIELDS]
    return survivor.survivors(table(spark, d, "jobs").select(*used), table(spark, d, "sources"), prior)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d, "stated").select("group_id", F.col("field").alias("field_name"), F.col("id").alias("job_id"))


def p6_fused(spark: SparkSession, d: str) -> DataFrame:
    """The member the fused votes alone would choose, with its posterior."""
    return _survivors(spark, d, "votes").select("group_id", F.col("field").alias("field_name"), F.col("id").alias("job_id"), "posterior")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(_documents(spark, d)).withColumnRenamed("id", "doc_id")


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and characters by source and kind."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "kind", "n_chars")
    counts = tokens.encoded(_documents(spark, d), count_only=True)
    return counts.join(docs, "id").groupBy("source", "kind").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_chars").alias("n_chars"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of each document, or of each piece of one above 2,048 tokens."""
    sizes = settle(tokens.encoded(_documents(spark, d), count_only=True), "sizes")
    out = packing.packed(sizes.withColumnRenamed("n_tokens", "size"))
    return out.select(F.col("id").alias("doc_id"), F.col("part").alias("piece_no"), F.col("size").alias("n_tokens"), F.col("container").alias("container_id"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are: one row."""
    per = p9_containers(spark, d).groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), (F.sum("used") / (F.count(F.lit(1)) * 2048)).alias("fill"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).filter("text is not null")
    named = settle(lookalike.normalise(docs, lookalike.learn(docs), full=False), "looks")
    # only looks that come in more than one spelling; min and max differ exactly then
    several = named.groupBy("c1", "c2").agg(F.min(F.struct("r1", "r2")).alias("lo"), F.max(F.struct("r1", "r2")).alias("hi")).filter("lo <> hi").select("c1", "c2")
    rows = named.join(several, ["c1", "c2"])
    other = rows.select("c1", "c2", F.col("id").alias("doc_id_b"), F.col("r1").alias("q1"), F.col("r2").alias("q2"))
    pairs = rows.join(other, ["c1", "c2"]).filter("id < doc_id_b and (r1 <> q1 or r2 <> q2)")
    return pairs.select(F.col("id").alias("doc_id_a"), "doc_id_b")


def p10_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each document with visible text: the smallest id among those that look the same, and how many there are."""
    docs = _documents(spark, d).filter("text is not null")
    named = settle(lookalike.normalise(docs, lookalike.learn(docs), full=False), "looks")
    classes = named.groupBy("c1", "c2").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("documents"))
    return named.join(classes, ["c1", "c2"]).select(F.col("id").alias("doc_id"), "group_id", "documents")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """By script: words that hold look-alike letters, and how many of them the search finds again from their looks alone."""
    docs = _documents(spark, d)
    return lookalike.restored(docs, lookalike.learn(docs))


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    """Each document's text in its consistent form."""
    docs = _documents(spark, d)
    return lookalike.normalise(docs, lookalike.learn(docs)).select(F.col("id").alias("doc_id"), "canonical")


QUERIES = {"p8_ids": p8_ids, "p8_counts": p8_counts, "p9_containers": p9_containers, "p9_fill": p9_fill, "p10_found": p10_found, "p10_forms": p10_forms, "p10_groups": p10_groups, "p10_restored": p10_restored, "p6_found": p6_found, "p6_fused": p6_fused, "p4_found": p4_found, "p4_unmatched": p4_unmatched, "p3_found": p3_found, "p3_groups": p3_groups, "p3_recall": p3_recall, "p2_found": p2_found, "p2_languages": p2_languages}
ORACLES: dict[str, str] = {**_P4_ORACLES, "p6_found": survivor.survivors_oracle()}
