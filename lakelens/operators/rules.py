"""Reconciliation rules: state tables in, action rows out.

Every rule is a pure function of DataFrames and a ``now`` in epoch milliseconds;
none reads a clock.  Freshness guards take the lag of the last compaction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelens.functions import scalars as S
from lakelens.operators.aggregates import TERMINAL

LAG_MS = 30_000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ready_dispatch(tasks: DataFrame, runs: DataFrame, outbox: DataFrame, lag_ms: int = 0, queue: str = "default-queue", most_lag_ms: int = LAG_MS) -> DataFrame:
    """An action for every READY task: EMIT with its dispatch, or SKIP with the reason."""
    ready = tasks.where(F.col("state") == "READY").select("run_id", "task_key", F.greatest("attempt", F.lit(1)).alias("attempt"))
    ready = ready.withColumn("dispatch_id", S.dispatch_id("run_id", "task_key", "attempt"))
    wide = ready.join(runs.select("run_id", "cancel_requested"), "run_id", "left").join(
        outbox.select("dispatch_id", F.col("status").alias("_status")), "dispatch_id", "left"
    )
    reason = (
        F.when(F.lit(lag_ms > most_lag_ms), "compaction_lag")
        .when(F.col("cancel_requested"), "run_cancel_requested")
        .when(F.col("_status").isNotNull(), F.concat(F.lit("existing_dispatch:"), F.initcap("_status")))
    )
    out = wide.withColumn("reason", reason).withColumn("action", F.when(F.col("reason").isNull(), "EMIT").otherwise("SKIP"))
    emit = F.col("action") == "EMIT"
    return out.select(
        "run_id", "task_key", "action", "reason", F.when(emit, F.col("attempt")).alias("attempt"),
        F.when(emit, F.col("dispatch_id")).alias("dispatch_id"),
        F.when(emit, S.attempt_id("run_id", "task_key", "attempt")).alias("attempt_id"), F.when(emit, F.lit(queue)).alias("worker_queue"),
    )


def dispatcher(outbox: DataFrame, lag_ms: int = 0, most_lag_ms: int = LAG_MS) -> DataFrame:
    """CREATE for pending rows, SKIP for others; with too much lag only pending ones show."""
    stale = lag_ms > most_lag_ms
    rows = outbox.where(F.col("status") == "PENDING") if stale else outbox
    reason = F.when(F.lit(stale), "compaction_lag").when(F.col("status") == "CREATED", "already_created")
    return rows.withColumn("reason", reason).withColumn("action", F.when(F.col("reason").isNull(), "CREATE").otherwise("SKIP"))


def timer_outbox(timers: DataFrame, lag_ms: int = 0, most_lag_ms: int = LAG_MS) -> DataFrame:
    stale = lag_ms > most_lag_ms
    waiting = (F.col("state") == "SCHEDULED") & F.col("cloud_task_id").isNull()
    rows = timers.where(waiting) if stale else timers
    reason = (
        F.when(F.lit(stale), "compaction_lag")
        .when(F.col("state") == "FIRED", "already_fired")
        .when(F.col("state") == "CANCELLED", "cancelled")
        .when(F.col("cloud_task_id").isNotNull(), "already_has_cloud_task_id")
    )
    return rows.withColumn("reason", reason).withColumn("action", F.when(F.col("reason").isNull(), "CREATE").otherwise("SKIP"))


def heartbeat_check(tasks: DataFrame, now: int, lag_ms: int = 0, grace_s: int = 30, most_lag_ms: int = LAG_MS) -> DataFrame:
    """(run_id, task_key, action, delay_s, reason) for heartbeat timers that fire."""
    age = (F.lit(now) - F.col("last_heartbeat_at")) / 1000
    left = F.col("heartbeat_timeout_sec") - age + grace_s
    over = age > F.col("heartbeat_timeout_sec") + grace_s
    case = [
        (F.col("state").isin(*TERMINAL), "NOOP", None, "terminal"),
        (F.col("state") != "RUNNING", "NOOP", None, "not_running"),
        (F.lit(lag_ms > most_lag_ms), "RESCHEDULE", F.lit(10.0), "compaction_lag_guard"),
        (F.col("last_heartbeat_at").isNull(), "RESCHEDULE", F.lit(30.0), "no_heartbeat_yet"),
        (over & F.col("attempt_id").isNull(), "RESCHEDULE", F.lit(10.0), "missing_attempt_id"),
        (over, "FAIL", None, "heartbeat_timeout"),
        (F.lit(True), "RESCHEDULE", F.greatest(left, F.lit(10.0)), "task_healthy"),
    ]
    return _decided(tasks, case)


def _decided(tasks: DataFrame, case: list) -> DataFrame:
    pick = None
    for when, action, delay, reason in case:
        value = F.struct(F.lit(action).alias("action"), (F.lit(None) if delay is None else delay).cast("double").alias("delay_s"), F.lit(reason).alias("reason"))
        pick = F.when(when, value) if pick is None else pick.when(when, value)
    return tasks.withColumn("_d", pick).select("run_id", "task_key", "_d.*")


def retry_fire(tasks: DataFrame, lag_ms: int = 0, most_lag_ms: int = LAG_MS) -> DataFrame:
    """What a retry timer does to its task."""
    case = [
        (F.col("state").isin(*TERMINAL), "NOOP", None, "terminal"),
        (F.col("state") != "RETRY_WAIT", "NOOP", None, "not_in_retry_wait"),
        (F.lit(lag_ms > most_lag_ms), "RESCHEDULE", F.lit(10.0), "compaction_lag_guard"),
        (F.col("attempt") >= F.col("max_attempts"), "NOOP", None, "max_attempts_reached"),
        (F.lit(True), "INCREMENT", None, None),
    ]
    return _decided(tasks, case)


def anti_entropy(
    tasks: DataFrame, outbox: DataFrame, now: int, lag_ms: int = 0, ledger: str = "UNCHECKED", ready_s: int = 300,
    dispatch_s: int = 600, stale_grace_s: int = 60, most_lag_ms: int = LAG_MS,
) -> DataFrame:
    """Repairs for stuck tasks: (run_id, task_key, repair, attempt, reason).  Failing a task
    that stopped its heartbeat is the one destructive repair; with lag, or a ledger known
    to be ahead (STALE), it is put off.  A ledger known to be CURRENT lets the others
    through in spite of lag."""
    lagging = lag_ms > most_lag_ms
    t = tasks.select("run_id", "task_key", "state", "attempt", "attempt_id", "max_attempts", "ready_at", "retry_not_before", "last_heartbeat_at", "started_at", "heartbeat_timeout_sec")
    target = F.when(F.col("state") == "READY", F.greatest("attempt", F.lit(1))).when(F.col("state") == "RETRY_WAIT", F.col("attempt") + 1).otherwise(F.col("attempt"))
    t = t.withColumn("target", target)
    o = outbox.select("run_id", "task_key", F.col("attempt").alias("target"), F.col("status").alias("_status"), F.col("created_at").alias("_created"))
    wide = t.join(o, ["run_id", "task_key", "target"], "left")
    has = F.coalesce(F.col("_status").isin("PENDING", "CREATED"), F.lit(False))
    waited = F.lit(now) - F.col("ready_at") > ready_s * 1000
    due = (F.col("attempt") < F.col("max_attempts")) & F.coalesce(F.lit(now) >= F.col("retry_not_before"), F.lit(True))
    beat = F.coalesce("last_heartbeat_at", "started_at")
    dead = F.lit(now) - beat > (F.col("heartbeat_timeout_sec") + stale_grace_s) * 1000
    if lagging and ledger != "CURRENT":
        need = ((F.col("state") == "READY") & waited) | ((F.col("state") == "RETRY_WAIT") & due) | ((F.col("state") == "RUNNING") & dead)
        return wide.where(need).select("run_id", "task_key", F.lit("SKIPPED_DUE_TO_LAG").alias("repair"), F.lit(None).cast("int").alias("attempt"), F.lit("compaction_lag").alias("reason"))
    seconds = lambda a: F.floor((F.lit(now) - a) / 1000).cast("string")
    row = lambda repair, attempt, reason: F.struct(F.lit(repair).alias("repair"), _c(attempt).cast("int").alias("attempt"), reason.alias("reason"))
    repair = (
        F.when((F.col("state") == "READY") & waited & ~has, row("CREATE_DISPATCH_OUTBOX", "target", F.concat(F.lit("stuck_ready_"), seconds(F.col("ready_at")), F.lit("s"))))
        .when((F.col("state") == "DISPATCHED") & F.col("_created").isNull(), row("CREATE_DISPATCH_OUTBOX", "target", F.lit("missing_dispatch_outbox")))
        .when((F.col("state") == "DISPATCHED") & (F.lit(now) - F.col("_created") > dispatch_s * 1000), row("REDISPATCH_STUCK_TASK", "target", F.concat(F.lit("stuck_dispatched_"), seconds(F.col("_created")), F.lit("s"))))
        .when((F.col("state") == "RETRY_WAIT") & due & ~has, row("CREATE_DISPATCH_OUTBOX", "target", F.lit("retry_wait_bootstrap")))
    )
    stale = (F.col("state") == "RUNNING") & dead & F.col("attempt_id").isNotNull()
    if lagging or ledger == "STALE":
        repair = repair.when(stale, row("SKIPPED_DUE_TO_LAG", F.lit(None), F.lit("compaction_lag")))
    else:
        repair = repair.when(stale, row("FAIL_STALE_RUNNING_TASK", "attempt", F.lit("heartbeat_timeout_anti_entropy")))
    return wide.withColumn("_r", repair).where("_r is not null").select("run_id", "task_key", "_r.*")


def staleness(partitions: DataFrame, upstreams: DataFrame | None, now: int, code_version: str | None = None, lag_minutes: int = 1440) -> DataFrame:
    """Partitions with ``is_stale``, ``stale_reason`` and ``stale_at``.  Reasons in order:
    never materialized, code changed, an upstream never materialized, an upstream newer,
    older than the policy allows.  ``upstreams`` are (asset_key, partition_key,
    upstream_key, upstream_at); of several newer ones the smallest key tells the time."""
    rows, at = partitions, F.col("last_materialization_at")
    if upstreams is not None:
        own = partitions.select("asset_key", "partition_key", at.alias("_own"))
        newer = F.when(F.col("upstream_at") > F.col("_own"), F.col("upstream_key"))
        agg = upstreams.join(own, ["asset_key", "partition_key"]).groupBy("asset_key", "partition_key").agg(
            F.bool_or(F.col("upstream_at").isNull()).alias("_never"), F.min_by("upstream_at", newer).alias("_newer")
        )
        rows = rows.join(agg, ["asset_key", "partition_key"], "left")
    else:
        rows = rows.withColumn("_never", F.lit(False)).withColumn("_newer", F.lit(None).cast("long"))
    deadline = at + lag_minutes * 60_000
    changed = F.lit(False) if code_version is None else F.coalesce(F.col("last_materialization_code_version") != code_version, F.lit(False))
    case = [
        (at.isNull(), "NEVER_MATERIALIZED", F.lit(None)),
        (changed, "CODE_CHANGED", F.lit(now)),
        (F.coalesce("_never", F.lit(False)), "UPSTREAM_NEVER_MATERIALIZED", F.lit(None)),
        (F.col("_newer").isNotNull(), "UPSTREAM_CHANGED", F.col("_newer")),
        (F.lit(now) > deadline, "FRESHNESS_POLICY", deadline),
    ]
    reason = since = None
    for when, name, when_since in case:
        reason = F.when(when, name) if reason is None else reason.when(when, name)
        since = F.when(when, when_since.cast("long")) if since is None else since.when(when, when_since.cast("long"))
    out = rows.withColumn("stale_reason", reason).withColumn("stale_at", since)
    return out.withColumn("is_stale", F.col("stale_reason").isNotNull()).drop("_never", "_newer")


def backfill_plan(backfills: DataFrame, chunks: DataFrame, runs: DataFrame, keys: DataFrame) -> DataFrame:
    """Next chunks of running backfills: (backfill_id, chunk_index, chunk_id, keys, run_key,
    request_fingerprint).  Free slots are what active chunks leave of
    ``max_concurrent_runs``; a chunk is active while planned or running or while its run
    is.  ``keys`` are (backfill_id, position, key)."""
    live = backfills.where("state = 'RUNNING' and chunk_size > 0 and max_concurrent_runs > 0")
    open_runs = runs.where(~F.col("state").isin("SUCCEEDED", "FAILED", "CANCELLED")).select("run_id", F.lit(True).alias("_open"))
    busy = chunks.join(open_runs, "run_id", "left").where(F.col("state").isin("PLANNED", "RUNNING") | F.col("_open"))
    active = busy.groupBy("backfill_id").agg(F.count("*").alias("_active"))
    total = F.ceil(F.col("total_partitions") / F.col("chunk_size")).cast("int")
    room = live.join(active, "backfill_id", "left").withColumn("_slots", F.col("max_concurrent_runs") - F.coalesce("_active", F.lit(0)))
    room = room.where(F.col("_slots") > 0).withColumn("_total", total).where("_total > planned_chunks")
    each = room.select("backfill_id", "chunk_size", "_slots", F.explode(F.expr("sequence(int(planned_chunks), _total - 1)")).alias("chunk_index"))
    each = each.withColumn("chunk_id", F.concat_ws(":", "backfill_id", F.col("chunk_index").cast("string")))
    free = each.join(chunks.select("chunk_id"), "chunk_id", "left_anti")
    n = F.row_number().over(Window.partitionBy("backfill_id").orderBy("chunk_index"))
    free = free.withColumn("_n", n).where(F.col("_n") <= F.col("_slots"))
    cut = keys.join(live.select("backfill_id", "chunk_size"), "backfill_id").withColumn("chunk_index", F.floor(F.col("position") / F.col("chunk_size")).cast("int"))
    lists = cut.groupBy("backfill_id", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("position", "key"))).alias("_k"))
    out = free.join(lists, ["backfill_id", "chunk_index"]).withColumn("keys", F.expr("_k.key"))
    return out.select(
        "backfill_id", "chunk_index", "chunk_id", "keys",
        F.concat(F.lit("backfill:"), F.col("backfill_id"), F.lit(":chunk:"), F.col("chunk_index").cast("string")).alias("run_key"),
        S.request_fingerprint("keys").alias("request_fingerprint"),
    )


def backfill_preview(total: Column | str, chunk_size: Column | str) -> Column:
    return F.ceil(_c(total) / _c(chunk_size)).cast("int")


def backfill_transition(state: Column | str, version: Column | str, asked: Column | str, expected: Column | str) -> Column:
    """Struct (accepted, reason) of a pause, resume or cancel under its version check."""
    s, a = _c(state), _c(asked)
    target = F.when(a == "pause", "PAUSED").when(a == "resume", "RUNNING").when(a == "cancel", "CANCELLED")
    move = (s == "RUNNING") & target.isin("PAUSED", "CANCELLED") | (s == "PAUSED") & target.isin("RUNNING", "CANCELLED")
    reason = F.when(_c(expected).isNotNull() & (_c(expected) != _c(version)), "version_conflict").when(~move, "invalid_transition")
    return F.struct(reason.isNull().alias("accepted"), reason.alias("reason"), F.when(reason.isNull(), target).alias("new_state"))


def retry_failed_keys(backfills: DataFrame, chunks: DataFrame) -> DataFrame:
    """(parent_backfill_id, keys): distinct sorted keys of the failed chunks of failed
    backfills."""
    failed = backfills.where("state = 'FAILED'").select("backfill_id")
    bad = chunks.where("state = 'FAILED'").join(failed, "backfill_id", "left_semi")
    each = bad.select("backfill_id", F.explode(F.from_json("partition_keys", "array<string>")).alias("key"))
    return each.groupBy(F.col("backfill_id").alias("parent_backfill_id")).agg(F.array_sort(F.collect_set("key")).alias("keys"))


def run_bridge(resolved: DataFrame, runs: DataFrame) -> DataFrame:
    """Requests of the run-key index without a run: TRIGGER those whose source resolved,
    SKIP the rest."""
    wait = resolved.join(runs.select("run_id"), "run_id", "left_anti")
    return wait.withColumn("action", F.when(F.col("source").isNull(), "SKIP").otherwise("TRIGGER"))


def run_requests_missing(resolved: DataFrame, runs: DataFrame, tasks: DataFrame, graph_sizes: DataFrame) -> DataFrame:
    """Which halves a request still lacks: the run, its plan, or both; requests whose task
    graph is empty are left out.  ``graph_sizes`` are (run_id, planned)."""
    has_run = runs.select("run_id", F.lit(True).alias("_run"))
    has_plan = tasks.select("run_id").distinct().withColumn("_plan", F.lit(True))
    wide = resolved.where("source is not null").join(graph_sizes.where("planned > 0"), "run_id").join(has_run, "run_id", "left").join(has_plan, "run_id", "left")
    need = wide.select("*", F.col("_run").isNull().alias("emit_triggered"), F.col("_plan").isNull().alias("emit_plan")).drop("_run", "_plan")
    return need.where("emit_triggered or emit_plan")


def snapshot_garbage(dirs: DataFrame, referenced: DataFrame, current: int, now: int, keep: int = 10, age_ms: int = 86_400_000) -> DataFrame:
    """(path, reason): directories no manifest refers to, and versions beyond the newest
    ``keep`` and older than ``age_ms``; protected ones never."""
    free = dirs.join(referenced.select("path"), "path", "left_anti").where(F.lit(now) - F.col("modified_at") > age_ms)
    n = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("version")))
    rank = dirs.withColumn("_n", n).select("path", "_n")
    rows = free.join(rank, "path")
    reason = F.when(F.col("version") > current, "orphaned").when(F.col("_n") > keep, "beyond_retention")
    return rows.withColumn("reason", reason).where("reason is not null").select("path", "reason")


def ledger_garbage(files: DataFrame, watermark: str, now: int, hold_h: int = 48) -> DataFrame:
    """Ledger files folded before the watermark and older than the hold."""
    return files.where((F.col("event_id") <= watermark) & (F.lit(now) - F.col("modified_at") > hold_h * 3_600_000))


def metadata_allowlist(tables: DataFrame, log: DataFrame, keep: int) -> DataFrame:
    """Metadata files that stay: current, stable, pending and previous ones, and the last
    ``keep`` log entries of each table by time."""
    kinds = ("current", "stable", "pending", "previous")
    named = tables.select("table_id", F.explode(F.array(*(F.col(k) for k in kinds))).alias("path")).where("path is not null")
    n = F.row_number().over(Window.partitionBy("table_id").orderBy(F.desc("timestamp"), "path"))
    recent = log.withColumn("_n", n).where(F.col("_n") <= keep).select("table_id", "path")
    return named.union(recent).distinct()


def orphan_metadata(files: DataFrame, allowed: DataFrame, suffix: str = ".metadata.json") -> DataFrame:
    return files.where(F.endswith("path", F.lit(suffix))).join(allowed.select("path"), "path", "left_anti")


def live_postings(postings: DataFrame, tombstones: DataFrame, now: int) -> DataFrame:
    """Postings without those of objects whose tombstone is still valid.  A task hashes its
    share of the tombstones and lets postings, one a word, pass by without sorting them."""
    valid = tombstones.where(F.lit(now) < F.col("expires_at")).select("doc_id").distinct()
    return postings.join(valid.hint("shuffle_hash"), "doc_id", "left_anti")


def rerun_selection(tasks: DataFrame, mode: str, parent_state: str, subset: list[str] | None = None) -> DataFrame:
    """Task keys of a rerun.  FROM_FAILURE needs a failed parent and takes everything that
    did not succeed; SUBSET takes known keys."""
    if mode == "FROM_FAILURE":
        if parent_state != "FAILED":
            raise ValueError("only a failed run can be rerun from its failure")
        chosen = tasks.where(F.col("state") != "SUCCEEDED").select("task_key")
    elif mode == "SUBSET":
        wanted = sorted(set(subset or []))
        chosen = tasks.where(F.col("task_key").isin(*wanted)).select("task_key").distinct()
        if chosen.count() < len(wanted):
            raise ValueError("the subset names unknown tasks")
    else:
        raise ValueError(f"unknown mode {mode}")
    if chosen.isEmpty():
        raise ValueError("nothing to rerun")
    return chosen


def due_sensors(sensors: DataFrame, now: int, min_interval_s: int) -> DataFrame:
    """Active sensors whose last evaluation is at least the interval ago."""
    rested = F.col("last_evaluation_at").isNull() | (F.lit(now) - F.col("last_evaluation_at") >= min_interval_s * 1000)
    return sensors.where((F.col("status") == "ACTIVE") & rested)


def inventory_diff(authoritative: DataFrame, shadow: DataFrame) -> DataFrame:
    """(path, status, expected, found): counts of two inventories compared file by file."""
    a = authoritative.select("path", F.col("row_count").alias("expected"))
    b = shadow.select("path", F.col("row_count").alias("found"))
    status = (
        F.when(F.col("expected").isNull(), "UNEXPECTED").when(F.col("found").isNull(), "MISSING").when(F.col("expected") != F.col("found"), "MISMATCH").otherwise("MATCH")
    )
    return a.join(b, "path", "full_outer").withColumn("status", status)
