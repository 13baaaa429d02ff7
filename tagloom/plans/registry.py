"""Where queries and the SQL that says the same are registered."""

from __future__ import annotations

from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import view, with_views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, build, sql: str = "", views: tuple[str, ...] = ()) -> None:
    """Registers a query over views: `build` gets them as DataFrames, in this order. SQL may begin with further common tables (", x AS (...) SELECT")."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(*(view(spark, sf_dir, v) for v in views))

    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = f"{with_views(*views)} {dedent(sql).strip()}"
