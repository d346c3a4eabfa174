"""Every registered query of the library, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.plans import answers, bundles, closures, derivations, feeds, gold, ledgers, reviews, scores, texts, times

FLAGSHIP = "macro_mean_nested"
MODULES = (scores, times, ledgers, texts, feeds, derivations, reviews, bundles, gold, answers, closures)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
