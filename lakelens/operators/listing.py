"""Lists of state rows as callers page through them: filters, order, limits.

Each list is a set of filters and a keyset order over one state table; pages go
through ``windows.keyset_page``, so a page reads what its filters and cursor leave.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelens.operators.windows import Key, cursor, keyset_page, page_size, read_cursor


@dataclass(frozen=True)
class Listing:
    """Order and limits of a list; ``equal`` are columns a caller may filter by value."""

    order: tuple[Key, ...]
    kinds: tuple[type, ...]
    equal: tuple[str, ...] = ()
    default: int = 50
    most: int = 200


#: The lists and their orders.
LISTS = {
    "runs": Listing((("triggered_at", False), ("run_id", True)), (int, str), ("state",)),
    "backfills": Listing((("created_at", False), ("backfill_id", True)), (int, str), ("state",)),
    "chunks": Listing((("chunk_index", True), ("chunk_id", True)), (int, str), ("backfill_id", "state")),
    "partitions": Listing((("asset_key", True), ("partition_key", True)), (str, str), ("asset_key",)),
    "sensors": Listing((("sensor_id", True),), (str,), ("status",)),
    "ticks": Listing((("scheduled_for", False), ("tick_id", True)), (int, str), ("schedule_id", "status")),
    "evals": Listing((("evaluated_at", False), ("eval_id", True)), (int, str), ("sensor_id", "status")),
    "catalog": Listing((("name", True), ("id", True)), (str, str), (), 100, 500),
}


def between(column: str, low: Any = None, high: Any = None) -> Column:
    """A range with both ends in it; an end that is None is open."""
    out = F.lit(True)
    if low is not None:
        out = out & (F.col(column) >= F.lit(low))
    if high is not None:
        out = out & (F.col(column) <= F.lit(high))
    return out


def select_rows(rows: DataFrame, name: str, stale_only: bool = False, times: tuple[str, Any, Any] | None = None, **equal: Any) -> DataFrame:
    """Rows that match: values by column, only stale partitions, an inclusive time range."""
    spec = LISTS[name]
    for column, value in equal.items():
        if column not in spec.equal:
            raise ValueError(f"{name} cannot be filtered by {column}")
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    if stale_only:
        rows = rows.where(F.col("stale_since").isNotNull())
    return rows if times is None else rows.where(between(*times))


def page(rows: DataFrame, name: str, token: str | None = None, limit: int | None = None, **filters: Any) -> tuple[list, str | None]:
    """(rows, token of the next page or None).  An all-digit token is a legacy offset."""
    spec = LISTS[name]
    n = page_size(limit, spec.default, spec.most)
    chosen = select_rows(rows, name, **filters)
    after = read_cursor(token, spec.kinds) if token else None
    if isinstance(after, int):
        order = [F.col(k).asc() if up else F.col(k).desc() for k, up in spec.order]
        got = chosen.orderBy(*order).offset(after).limit(n + 1).collect()
    else:
        got = keyset_page(chosen, spec.order, after, n).collect()
    more = cursor([got[n - 1][k] for k, _ in spec.order]) if len(got) > n else None
    return got[:n], more


def offset_page(rows: DataFrame, order: Sequence[str], token: str | None, limit: int) -> tuple[DataFrame, str]:
    """Pages by numeric offset, as some callers have them."""
    at = int(token) if token else 0
    return rows.orderBy(*order).offset(at).limit(limit), str(at + limit)


def distinct_on(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def ready_list(tasks: DataFrame, slots: int) -> DataFrame:
    """READY tasks by priority, then place in the plan, as many as there are slots."""
    return tasks.where(F.col("state") == "READY").orderBy("priority", "position", "task_key").limit(slots)


# -- schedules, declaratively ------------------------------------------------------


def schedule_definitions(events: DataFrame) -> DataFrame:
    """Definitions from upserts: of each idempotency key the first counts, the latest of a
    schedule stands, and it was created when the first came."""
    first = events.groupBy("idempotency_key").agg(F.min_by(F.struct(*[c for c in events.columns if c != "idempotency_key"]), "event_id").alias("e"))
    rest = [c for c in events.columns if c not in ("schedule_id", "event_id", "ts", "idempotency_key")]
    each = first.select("e.*")
    return each.groupBy("schedule_id").agg(
        F.max_by(F.struct(*rest), "event_id").alias("d"), F.min_by("ts", "event_id").alias("created_at"), F.max("event_id").alias("row_version")
    ).select("schedule_id", "d.*", "created_at", "row_version")


def schedule_state(ticks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, ticks): each schedule's last tick and every tick's latest row, by event id."""
    rest = [c for c in ticks.columns if c not in ("tick_id", "event_id")]
    rows = ticks.groupBy("tick_id").agg(F.max_by(F.struct(*rest), "event_id").alias("t"), F.max("event_id").alias("row_version"))
    rows = rows.select("tick_id", "t.*", "row_version")
    last = ticks.groupBy("schedule_id").agg(
        F.max_by(F.struct("scheduled_for", "tick_id", "run_key"), "event_id").alias("s"), F.max("event_id").alias("row_version")
    )
    state = last.select(
        "schedule_id", F.col("s.scheduled_for").alias("last_scheduled_for"), F.col("s.tick_id").alias("last_tick_id"),
        F.col("s.run_key").alias("last_run_key"), "row_version",
    )
    return state, rows


# -- the head of a catalog -----------------------------------------------------------


def head_issues(heads: DataFrame) -> DataFrame:
    """(domain, issue_type, severity, repairable) of catalog heads: (domain, has_manifest,
    version, mirror_version, has_commit_record)."""
    mirror = F.col("mirror_version")
    tests = [
        (~F.col("has_manifest"), "missing_manifest", "critical", False),
        (F.col("has_manifest") & mirror.isNull(), "missing_current_head_legacy_mirror", "warning", True),
        (F.col("has_manifest") & (mirror < F.col("version")), "stale_current_head_legacy_mirror", "warning", True),
        (F.col("has_manifest") & ~F.col("has_commit_record"), "missing_current_head_commit_record", "warning", True),
    ]
    each = [F.when(t, F.struct(F.lit(k).alias("issue_type"), F.lit(s).alias("severity"), F.lit(r).alias("repairable"))) for t, k, s, r in tests]
    return heads.select("domain", F.explode(F.array_compact(F.array(*each))).alias("i")).select("domain", "i.*")


def tombstones(changes: DataFrame, now: int, days: int = 7) -> DataFrame:
    """(doc_id, expires_at, reindex) from object changes (doc_id, change, at): deletes hide
    postings until they are rebuilt, renames and moves also ask for a new index entry."""
    last = changes.groupBy("doc_id").agg(F.max_by(F.struct("change", "at"), "at").alias("c"))
    rows = last.where(F.col("c.change").isin("deleted", "renamed", "moved"))
    expires = F.col("c.at") + F.lit(days * 86_400_000)
    return rows.select("doc_id", expires.alias("expires_at"), (F.col("c.change") != "deleted").alias("reindex")).where(F.col("expires_at") > now)
