"""Executable data-quality checks.

All simple checks of a table run in one aggregation pass; uniqueness needs one
shuffle on its columns and custom SQL its own query.  A result row says what was
observed and whether it passed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelens.plans.sqlgate import bind_views, parse

RESULT = "name string, kind string, severity string, phase string, observed double, passed boolean"


@dataclass(frozen=True)
class Check:
    """phase: pre or post materialization; severity: info, warning, error or critical."""

    name: str
    severity: str = "error"
    phase: str = "post"


@dataclass(frozen=True)
class RowCount(Check):
    """Rows between bounds; ``min_ratio`` compares with the rows of the run before."""

    minimum: int | None = None
    maximum: int | None = None
    min_ratio: float | None = None


@dataclass(frozen=True)
class NotNull(Check):
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Unique(Check):
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Freshness(Check):
    """Hours from the newest value of ``column`` (a timestamp) to ``now``."""

    column: str = ""
    max_age_hours: float = 24.0


@dataclass(frozen=True)
class CustomSql(Check):
    """A query over ``{table}`` whose single number must be 0."""

    sql: str = ""


def run_checks(df: DataFrame, checks: Sequence[Check], previous_rows: int | None = None, now: str | None = None, phase: str | None = None) -> DataFrame:
    """A row per check.  ``now`` is a timestamp literal; checks never read the clock."""
    todo = [c for c in checks if phase is None or c.phase == phase]
    cols: list[Column] = [F.count("*").cast("double").alias("_rows")]
    for i, c in enumerate(todo):
        if isinstance(c, NotNull):
            bad = F.lit(False)
            for name in c.columns:
                bad = bad | F.col(name).isNull()
            cols.append(F.count_if(bad).cast("double").alias(f"c{i}"))
        elif isinstance(c, Freshness):
            age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.max(c.column).cast("timestamp"))
            cols.append((age / 3_600_000_000).cast("double").alias(f"c{i}"))
    agg = df.agg(*cols)
    parts = []
    for i, c in enumerate(todo):
        kind = type(c).__name__
        if isinstance(c, RowCount):
            seen = F.col("_rows")
            ok = F.lit(True)
            if c.minimum is not None:
                ok = ok & (seen >= c.minimum)
            if c.maximum is not None:
                ok = ok & (seen <= c.maximum)
            if c.min_ratio is not None and previous_rows:
                ok = ok & (seen >= c.min_ratio * previous_rows)
            parts.append((c, kind, agg, seen, ok))
        elif isinstance(c, NotNull):
            parts.append((c, kind, agg, F.col(f"c{i}"), F.col(f"c{i}") == 0))
        elif isinstance(c, Freshness):
            parts.append((c, kind, agg, F.col(f"c{i}"), F.coalesce(F.col(f"c{i}") <= c.max_age_hours, F.lit(False))))
        elif isinstance(c, Unique):
            twice = df.groupBy(*c.columns).count().where("count > 1").agg(F.count("*").cast("double").alias("n"))
            parts.append((c, kind, twice, F.col("n"), F.col("n") == 0))
        elif isinstance(c, CustomSql):
            parsed = parse(df.sparkSession, c.sql.replace("{table}", "checked"))
            if set(parsed.relations) != {("checked",)}:
                raise ValueError(f"check {c.name} may read {{table}} only")
            own = bind_views(df.sparkSession, parsed, {("checked",): df})
            own = own.select(F.col(own.columns[0]).cast("double").alias("n"))
            parts.append((c, kind, own, F.col("n"), F.coalesce(F.col("n") == 0, F.lit(False))))
        else:
            raise TypeError(f"unknown check {c}")
    out = None
    # checks on the same pass share one row: they are read off it by a generator
    shared = [p for p in parts if p[2] is agg]
    if shared:
        rows = F.array(*(_result(c, kind, seen, ok) for c, kind, _, seen, ok in shared))
        out = agg.select(F.explode(rows).alias("r")).select("r.*")
    for c, kind, source, seen, ok in (p for p in parts if p[2] is not agg):
        one = source.select(_result(c, kind, seen, ok).alias("r")).select("r.*")
        out = one if out is None else out.union(one)
    return out if out is not None else df.sparkSession.createDataFrame([], RESULT)


def _result(c: Check, kind: str, seen: Column, ok: Column) -> Column:
    values = {"name": F.lit(c.name), "kind": F.lit(kind), "severity": F.lit(c.severity), "phase": F.lit(c.phase), "observed": seen, "passed": ok}
    return F.struct(*(v.alias(k) for k, v in values.items()))
