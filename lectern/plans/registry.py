"""The core's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.plans import queries_corpus, queries_findings, queries_rules, queries_text

_MODULES = (queries_text, queries_findings, queries_corpus, queries_rules)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity summary of all findings by source: the whole lint plan."""
    return queries_findings.lint_summary(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
