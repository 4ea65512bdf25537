"""All registered queries outside the llm subpackage, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import corpus, evidence, flows, links, markup, nested, packets, ranges, routes, search, stores, views, walks  # noqa: F401  the plan modules register their queries on import
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["r2_bm25"](spark, d)
