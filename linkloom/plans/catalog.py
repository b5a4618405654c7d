"""All registered queries of the core with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..streaming import incremental
from . import build, fixture, records, tracing

QUERIES = records.QUERIES | tracing.QUERIES | build.QUERIES | fixture.QUERIES | incremental.QUERIES
SQL = records.SQL | tracing.SQL | fixture.SQL | incremental.SQL


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["trace_result"](spark, sf_dir)
