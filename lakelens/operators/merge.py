"""Merging versioned rows: base and deltas, tombstones, watermarks, late events.

Everything is one aggregation per key with map-side combine: the winner of a key
is ``max_by`` over an order struct, so a hot key costs a row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelens.operators.fold import TASK_RANK


def task_rank(state: Column | str) -> Column:
    """How far a task state is on its way; -1 for unknown ones."""
    s = F.col(state) if isinstance(state, str) else state
    table = F.create_map(*(F.lit(x) for pair in TASK_RANK.items() for x in pair))
    return F.coalesce(F.element_at(table, s), F.lit(-1))


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row of each key that comes last in ``order``; nulls come first."""
    rest = [c for c in rows.columns if c not in key]
    win = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*key).agg(win).select(*key, "_row.*").select(*rows.columns)


def first_write(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row of each key that comes first in ``order``."""
    rest = [c for c in rows.columns if c not in key]
    win = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*key).agg(win).select(*key, "_row.*").select(*rows.columns)


#: Columns that decide between versions of a table's rows, before the delta's ordinal.
VERSION_ORDER: dict[str, tuple[str, ...]] = {"tasks": ("row_version", "_rank"), "backfills": ("state_version", "row_version")}


def merge_layers(
    layers: DataFrame, key: Sequence[str], table: str = "", tombstones: DataFrame | None = None, ordinal: str = "delta_ordinal"
) -> DataFrame:
    """Current rows from a base (ordinal 0) and its deltas: the latest version of each key,
    the later delta on ties.  ``tombstones`` (key, ordinal) delete what their own and
    earlier layers hold; a later delta may bring a key back."""
    rows = layers
    if tombstones is not None:
        gone = tombstones.groupBy(*key).agg(F.max(ordinal).alias("_gone"))
        rows = rows.join(gone, list(key), "left").where(F.col("_gone").isNull() | (F.col(ordinal) > F.col("_gone"))).drop("_gone")
    order = VERSION_ORDER.get(table, ("row_version",))
    if "_rank" in order:
        rows = rows.withColumn("_rank", task_rank("state"))
    return latest(rows, key, [*order, ordinal]).drop("_rank", ordinal)


def state_diff(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows that changed or appeared, with ``_change`` UPSERT, and keys that went, DELETE.
    Comparison is null-safe over all columns."""
    values = [c for c in new.columns if c not in key]
    a = old.select(*key, F.struct(*values).alias("_old"))
    b = new.select(*key, F.struct(*values).alias("_new"))
    both = a.join(b, list(key), "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    change = F.when(F.col("_new").isNull(), "DELETE").otherwise("UPSERT")
    return both.select(*key, *(F.col(f"_new.{c}").alias(c) for c in values), change.alias("_change"))


def compaction_due(deltas: DataFrame, now_ms: int, count: int = 10, rows: int = 100_000, age_s: int = 300) -> DataFrame:
    """One row: deltas, their rows and deletions, the oldest age, and whether to merge."""
    agg = deltas.agg(
        F.count("*").alias("deltas"),
        F.coalesce(F.sum(F.col("rows") + F.col("deletions")), F.lit(0)).alias("changes"),
        F.max((F.lit(now_ms) - F.col("created_at")) / 1000).alias("oldest_s"),
    )
    due = (F.col("deltas") >= count) | (F.col("changes") >= rows) | F.coalesce(F.col("oldest_s") >= age_s, F.lit(False))
    return agg.withColumn("due", due)


def upsert_by_sequence(rows: DataFrame, key: str, sequence: str = "sequence", order: str = "event_id") -> DataFrame:
    """Upserts taken in ``order``: a repeated idempotency key counts once (its first), and a
    row with a sequence yields only to one at least as high; one without yields to any.
    So a key's last row in order of (sequence, order), nulls first, is the one that stays."""
    once = rows
    if "idempotency_key" in rows.columns and key != "idempotency_key":
        named = rows.where(F.col("idempotency_key").isNotNull())
        once = first_write(named, ["idempotency_key"], [order]).unionByName(rows.where(F.col("idempotency_key").isNull()))
    return latest(once, [key], [sequence, order])


def after_watermark(events: DataFrame, watermark: str | None) -> DataFrame:
    """Events whose id comes after the watermark; all of them without one."""
    return events if watermark is None else events.where(F.col("event_id") > F.lit(watermark))


def is_fresh(last_processed_ms: Column | str, now_ms: int, max_lag_ms: int) -> Column:
    c = F.col(last_processed_ms) if isinstance(last_processed_ms, str) else last_processed_ms
    return F.lit(now_ms) - c <= max_lag_ms


def advance_watermarks(old: dict[str, str | None], new: dict[str, str | None]) -> dict[str, str | None]:
    """Watermarks are event ids and only ever move forward."""
    return {k: max((x for x in (old.get(k), new.get(k)) if x is not None), default=None) for k in {**old, **new}}


LATE_POLICIES = ("skip", "log", "process", "quarantine")


def split_late(
    events: DataFrame, watermark: str | int, compacted_at, policy: str = "log", modified: str = "ts"
) -> tuple[DataFrame, DataFrame]:
    """(events to process, late events set aside).  An event is late if its id is not past
    the watermark though it was written after the last compaction.  Old events that are
    not late were folded before."""
    if policy not in LATE_POLICIES:
        raise ValueError(f"policy must be one of {LATE_POLICIES}")
    past = F.col("event_id") > F.lit(watermark)
    late = ~past & (F.col(modified) > F.lit(compacted_at))
    aside = events.where(late)
    if policy == "process":
        return events.where(past | late), aside.limit(0)
    return events.where(past), aside if policy != "skip" else aside.limit(0)


def split_invalid(raw: DataFrame, schema: str, known: Sequence[str], column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(valid events with a parsed ``event``, rejected ones with a ``reason``)."""
    parsed = raw.withColumn("event", F.from_json(column, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    kind = F.col("event.event_type")
    reason = (
        F.when(F.col("event").isNull() | F.col("event._corrupt").isNotNull(), "malformed")
        .when(kind.isNull(), "missing event_type")
        .when(~kind.isin(*known), "unknown event_type")
    )
    told = parsed.withColumn("reason", reason)
    return told.where("reason is null").drop("reason"), told.where("reason is not null").drop("event")


def rebuild(events: DataFrame, visible: str | None = None, processed: str | None = None, committed: str | None = None) -> DataFrame:
    """Events a rebuild has to fold: each id once, past the first floor that is set."""
    floor = next((x for x in (visible, processed, committed) if x is not None), None)
    return after_watermark(events, floor).dropDuplicates(["event_id"])


def missed(events: DataFrame, watermark: str | None, compacted_at_ms: int, cursor: str | None = None, page: int = 1000) -> DataFrame:
    """A page of events that a compaction may have missed, after the durable cursor."""
    seen = F.lit(True) if watermark is None else (F.col("event_id") > watermark) | (F.col("modified_at") > compacted_at_ms)
    rows = events.where(seen) if cursor is None else events.where(seen & (F.col("path") > cursor))
    return rows.orderBy("path").limit(page)


def expired(id_ms: Column | str, now_ms: int, days: int) -> Column:
    c = F.col(id_ms) if isinstance(id_ms, str) else id_ms
    return c < F.lit(now_ms - days * 86_400_000)


def prune_runs(runs: DataFrame, dependants: dict[str, DataFrame], now_ms: int, days: int = 90) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Terminal runs past retention go, and with them the rows of every dependent table
    that carry their run_id."""
    from lakelens.functions.scalars import ulid_millis

    old = runs.where(F.col("state").isin("SUCCEEDED", "FAILED", "CANCELLED") & expired(ulid_millis("row_version"), now_ms, days))
    gone = old.select("run_id")
    kept = runs.join(gone, "run_id", "left_anti")
    return kept, {name: df.join(gone, "run_id", "left_anti") for name, df in dependants.items()}


def append_once(ledger: DataFrame, incoming: DataFrame, body: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(new events, conflicts): an id already in the ledger is a replay if its bytes are the
    same and a conflict if they aren't; ids repeated in the batch are held to that too.

    Only the ledger's rows with an id of the batch are hashed, and those between its least
    and greatest id are all that a store with statistics needs to read."""
    hashed = incoming.withColumn("_h", F.sha2(F.col(body).cast("string"), 256))
    kinds = hashed.groupBy("event_id").agg(F.count_distinct("_h").alias("_kinds"))
    ends = incoming.agg(F.min("event_id"), F.max("event_id")).first()
    hits = ledger.where(F.col("event_id").between(*ends)) if ends[0] is not None else ledger.limit(0)
    hits = hits.join(kinds.select("event_id"), "event_id", "left_semi")
    known = hits.select("event_id", F.sha2(F.col(body).cast("string"), 256).alias("_known")).distinct()
    told = hashed.join(kinds, "event_id").join(known, "event_id", "left")
    bad = (F.col("_kinds") > 1) | (F.col("_known").isNotNull() & (F.col("_known") != F.col("_h")))
    conflicts = told.where(bad).select(*incoming.columns)
    fresh = told.where(~bad & F.col("_known").isNull()).select(*incoming.columns).dropDuplicates(["event_id"])
    return fresh, conflicts
