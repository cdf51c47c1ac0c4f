"""Queries over the synthetic tables, each with its equivalent SQL.

A query is registered with ``query(name, sql)``; ``sql`` is what another engine
runs on the same tables, or None where SQL can't say it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same_sql(name: str, sql: str) -> None:
    """A query whose text both engines take as it is, through the metadata SQL gate."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from lakelens.plans.sqlgate import bind_views, parse

        parsed = parse(spark, sql)
        return bind_views(spark, parsed, {r: read(spark, sf_dir, r[-1]) for r in parsed.relations})

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = sql
