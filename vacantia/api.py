"""One method a read query, each returning a DataFrame; keyword-only, so that an unknown argument is an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacantia.operators import demand, packed, pay, search, signals, timestamps, units
from vacantia.plans import general_tasks, ingestion, lifecycle, relational, scoring, texts
from vacantia.session import table


class Engine:
    def __init__(self, spark: SparkSession, tables: str):
        self.spark, self.tables = spark, tables
        self._plans = {name: q for m in (relational, texts, ingestion, scoring, lifecycle, general_tasks) for name, q in m.QUERIES.items()}

    def _t(self, name: str) -> DataFrame:
        return table(self.spark, self.tables, name)

    def query(self, name: str) -> DataFrame:
        """A named plan with its standing parameters."""
        return self._plans[name](self.spark, self.tables)

    def names(self) -> list[str]:
        return sorted(self._plans)

    def skill_demand(self, *, filters: demand.Filters = demand.Filters(), limit: int = 50) -> DataFrame:
        return demand.top(demand.demand(self._t("jobs"), self._t("job_skills"), self._t("skills"), self._t("sources"), filters), limit)

    def skill_growth(self, *, start: str, end: str) -> DataFrame:
        return demand.growth(self._t("jobs"), self._t("job_skills"), self._t("skills"), self._t("sources"), start=start, end=end)

    def skill_cooccurrence(self, *, skill_id: int, limit: int = 15) -> DataFrame:
        return demand.cooccurrence(self._t("jobs"), self._t("job_skills"), self._t("skills"), skill_id, limit)

    def pay_statistics(self, *, currency: str, by: tuple[str, ...] = (), min_sample: int = 3, wanted: pay.PayFilter = pay.PayFilter()) -> DataFrame:
        return pay.statistics(self._t("compensation_observations"), self._t("jobs"), list(by), currency, min_sample, wanted, self._t("sources"))

    def search_jobs(self, *, wanted: search.JobSearch = search.JobSearch()) -> DataFrame:
        return wanted.run(self._t("jobs"), self._t("sources"), relational.matches(self.spark, self.tables))

    def body_signals(self, *, keywords: tuple[str, ...] = ()) -> DataFrame:
        return signals.body_signals(texts.html_to_text(self.spark, self.tables), keywords)

    def ingested(self) -> DataFrame:
        return ingestion.ingest_snapshot(self.spark, self.tables)

    def timestamps(self, *, threshold: float = 0.9) -> DataFrame:
        return timestamps.normalise(general_tasks.feed_values(self.spark, self.tables), threshold)

    def unpacked(self) -> DataFrame:
        return packed.unpack(general_tasks.packed_fields(self.spark, self.tables))

    def pay_in_dollars(self, *, confident: float = 0.9) -> DataFrame:
        return units.convert(self._t("compensation_observations"), self._t("fx_rates"), confident)
