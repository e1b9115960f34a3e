"""All registered queries of the core operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarryline.operators import history
from quarryline.plans import base, corpus, evaluation, governance, retrieval, serving, tuning  # noqa: F401  (they register their queries)
from quarryline.session import table
from quarryline.streaming import streams  # noqa: F401


@base.query(history.P3_SQL)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every version of every document with its period of validity."""
    return history.p3_found(table(spark, d, "registry_snapshots"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Answers to all escalated questions from all chunks."""
    return serving.answers(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
