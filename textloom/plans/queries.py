"""All queries over the reference's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import lint_queries, more_queries, report_queries, segment_queries, text_queries  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to line segments to findings of the Swiss rules to scores by language: penalties, scores and the worst verdict."""
    return QUERIES["locale_score"](spark, sf_dir).join(QUERIES["locale_verdict"](spark, sf_dir), "lang")
