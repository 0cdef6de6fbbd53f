"""All registered queries of the panel library, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import data_queries, explain_queries, geo_queries, model_queries, panel_queries, reshape_queries, rule_queries, stream_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (panel_queries, reshape_queries, data_queries, model_queries, stream_queries, rule_queries, geo_queries, explain_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship_tiers"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
