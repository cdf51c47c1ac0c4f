"""All queries of the library with their equivalent SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakelens.queries import ORACLES, QUERIES

FLAGSHIP = "sql_three_way_join"
_MODULES = ("sql", "state", "rules", "stream", "more", "surface")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"lakelens.queries.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
