"""The registered queries and their SQL, in the order of the operator groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FLAGSHIP = "coverage_stats"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of ``Tables`` under its name, with the SQL that gives the same rows."""

    def register(build: Callable[[Tables], DataFrame]):
        _QUERIES[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            _SQL[build.__name__] = sql
        return build

    return register


def six(c: Column | str) -> Column:
    """A float to six digits, as the SQL side rounds it."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


def _load() -> None:
    from tarnwick.plans import cluster_queries, feature_queries, genome_queries, level_queries, outcome_queries, relational_queries, report_queries, sequence_queries, stats_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
