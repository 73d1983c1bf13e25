"""Relational plans as SQL over named tables: one statement, Spark's dialect and the checking engine's from the same text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vacantia.session import TABLES, table

def _spark(sql: str) -> str:
    sql = re.sub(r"JOIN_SORTED\((.*?)\)JOINED", r"concat_ws('|', sort_array(\1))", sql)
    sql = sql.replace("PERCENTILE(", "percentile(").replace("MICROS(", "unix_micros(").replace("LIST(", "collect_list(")
    return re.sub(r"AS_TS\('([^']*)'\)", r"timestamp'\1 UTC'", sql)


def _duckdb(sql: str) -> str:
    sql = re.sub(r"JOIN_SORTED\((.*?)\)JOINED", r"array_to_string(list_sort(\1), '|')", sql)
    sql = sql.replace("PERCENTILE(", "quantile_cont(").replace("MICROS(", "epoch_us(").replace("LIST(", "list(")
    return re.sub(r"AS_TS\('([^']*)'\)", r"TIMESTAMPTZ '\1+00'", sql)


def run(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """Run a statement with the tables of d in place of their names; nothing is registered in the session."""
    used = {t: table(spark, d, t) for t in TABLES if re.search(rf"(?<![\w.']){t}(?![\w.('])", sql)}
    text = _spark(sql)
    for t in used:
        text = re.sub(rf"(?<![\w.']){t}(?![\w.('])", f"{{{t}}}", text)
    return spark.sql(text, **used)


def plan(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return run(spark, d, sql)

    return query


def oracle(sql: str) -> str:
    return _duckdb(sql)
