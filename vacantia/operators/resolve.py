"""Identity of postings: dedup keys and duplicate links to the earliest canonical posting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.session import cut


def _earliest(rows: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Active rows to the earliest place by key, and by URL the earliest with the earliest of any other source."""
    by_key = rows.groupBy("key").agg(F.min("place").alias(f"{prefix}_key"))
    per_source = rows.groupBy("url", "source_id").agg(F.min("place").alias("place"))
    # two of the sources of a URL: the list holds one entry a source
    two = per_source.groupBy("url").agg(F.slice(F.array_sort(F.collect_list(F.struct("place", "source_id"))), 1, 2).alias(f"{prefix}_url"))
    return by_key, two


def _before(prefix: str) -> Column:
    """The earliest such place that may attract the row, whether by key or by URL; null if none comes before it."""
    other = F.get(F.filter(f"{prefix}_url", lambda x: ~x["source_id"].eqNullSafe(F.col("source_id"))), F.lit(0))["place"]
    best = F.least(F.col(f"{prefix}_key"), other)
    return F.when(best < F.col("place"), best)


def duplicate_links(postings: DataFrame) -> DataFrame:
    """(id, at, source_id, url, key, active) to (id, canonical_id), null for canonical postings.

    In order of (at, id) a posting is canonical unless an earlier active canonical one shares its
    URL (but not one of the same source, which has another id there) or its key. That is a greedy
    independent set. No pairs are formed: each round takes the earliest decided and undecided
    place of every key and URL, which a hot key pre-aggregates, and decides what these allow. The
    first undecided posting is decided in every round, so the rounds end.
    """
    p = postings.select("id", "source_id", "url", "key", "active", F.struct(F.col("at"), F.col("id")).alias("place"))
    state = cut(p.withColumn("canonical", F.lit(None).cast("boolean")))
    while True:
        rows = state
        for prefix, which in (("c", "canonical"), ("u", "canonical is null")):
            by_key, by_url = _earliest(state.filter("active").filter(which), prefix)
            rows = rows.join(by_key, "key", "left").join(by_url, "url", "left")
        if not state.filter("canonical is null").limit(1).count():
            return rows.select("id", F.when(~F.col("canonical"), _before("c")["id"]).alias("canonical_id"))
        found = F.when(_before("c").isNotNull(), False).when(_before("u").isNull(), True)
        state = cut(rows.select("id", "source_id", "url", "key", "active", "place", F.coalesce("canonical", found).alias("canonical")))
