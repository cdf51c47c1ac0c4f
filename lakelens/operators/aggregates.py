"""Aggregations over runs, tasks, chunks and partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("SUCCEEDED", "FAILED", "SKIPPED", "CANCELLED")


def outcome(failed: Column | str, cancelled: Column | str) -> Column:
    f, c = (F.col(x) if isinstance(x, str) else x for x in (failed, cancelled))
    return F.when(c > 0, "CANCELLED").when(f > 0, "FAILED").otherwise("SUCCEEDED")


def run_counters(tasks: DataFrame) -> DataFrame:
    """Per run: tasks by terminal state, the state they amount to, and when all ended."""
    n = {s: F.count_if(F.col("state") == s).alias(f"tasks_{s.lower()}") for s in TERMINAL}
    agg = tasks.groupBy("run_id").agg(
        F.count("*").alias("tasks_total"),
        F.count_if(F.col("state").isin(*TERMINAL)).alias("tasks_completed"),
        *n.values(),
        F.max(F.when(F.col("state").isin(*TERMINAL), F.col("completed_at"))).alias("_at"),
    )
    done = F.col("tasks_completed") == F.col("tasks_total")
    state = F.when(done, outcome("tasks_failed", "tasks_cancelled")).otherwise("RUNNING")
    return agg.withColumn("state", state).withColumn("completed_at", F.when(done, F.col("_at"))).drop("_at")


def public_task_counts(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Runs with pending, queued and running tasks from rows, terminal ones from the run."""
    view = {"pending": ("PLANNED", "BLOCKED", "RETRY_WAIT"), "queued": ("READY", "DISPATCHED"), "running": ("RUNNING",)}
    n = tasks.groupBy("run_id").agg(*(F.count_if(F.col("state").isin(*s)).alias(k) for k, s in view.items()))
    wide = runs.join(n, "run_id", "left")
    return wide.select(*runs.columns, *(F.coalesce(k, F.lit(0)).alias(k) for k in view))


def public_run_state(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Runs with ``public_state``: cancelling while a cancel is pending, failed if a required
    output failed, running while one is still to appear."""
    needs = F.col("requires_visible_output") & (F.col("state") == "SUCCEEDED")
    seen = F.coalesce("output_visibility_state", F.lit("PENDING"))
    outputs = tasks.groupBy("run_id").agg(
        F.coalesce(F.bool_or(needs & (seen == "FAILED")), F.lit(False)).alias("_failed"),
        F.coalesce(F.bool_or(needs & (seen == "PENDING")), F.lit(False)).alias("_pending"),
    )
    rows = runs.join(outputs, "run_id", "left")
    ended = F.col("state").isin("SUCCEEDED", "FAILED", "CANCELLED")
    yes = lambda c: F.coalesce(c, F.lit(False))
    public = (
        F.when(F.col("cancel_requested") & ~ended, "CANCELLING")
        .when(F.col("state") == "CANCELLED", "CANCELLED")
        .when((F.col("state") == "FAILED") | yes("_failed"), "FAILED")
        .when((F.col("state") == "SUCCEEDED") & yes("_pending"), "RUNNING")
        .otherwise(F.col("state"))
    )
    return rows.withColumn("public_state", public).drop("_failed", "_pending")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Backfill chunks by state; planned ones count as pending."""
    s = F.col("state")
    return chunks.groupBy("backfill_id").agg(
        F.count("*").alias("total"),
        F.count_if(s.isin("PENDING", "PLANNED")).alias("pending"),
        *(F.count_if(s == x).alias(x.lower()) for x in ("RUNNING", "SUCCEEDED", "FAILED")),
    )


def partition_summary(partitions: DataFrame) -> DataFrame:
    n = partitions.groupBy("asset_key").agg(
        F.count("*").alias("total"),
        F.count("last_materialization_run_id").alias("materialized"),
        F.count("stale_since").alias("stale"),
    )
    return n.withColumn("missing", F.col("total") - F.col("materialized"))


def nearest_rank(value: str, share: float = 0.95) -> Column:
    """The value at index ceil(share * n) - 1 of the sorted values; null without any.  Counts
    of distinct values are what is shuffled, so a hot group is no hot task."""
    return F.expr(f"percentile_disc({share}) within group (order by {value})")


def trigger_latency(index: DataFrame, runs: DataFrame) -> DataFrame:
    """Seconds from request to trigger of each run, never below 0."""
    j = index.join(runs.select("run_id", "triggered_at"), "run_id")
    return j.withColumn("latency_s", F.greatest(F.lit(0), F.col("triggered_at") - F.col("created_at")) / 1000)


def slo_breaches(latencies: DataFrame, seconds: float) -> DataFrame:
    """A limit met exactly is no breach."""
    return latencies.where(F.col("latency_s") > seconds)


def backlog(index: DataFrame, runs: DataFrame, outbox: DataFrame, timers: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row of five gauges; each side is one aggregate."""
    one = lambda df, c, name: df.agg(c.alias(name))
    parts = [
        one(index.join(runs.select("run_id"), "run_id", "left_anti"), F.count("*"), "pending_requests"),
        one(outbox, F.count_if(F.col("status") == "PENDING"), "pending_dispatches"),
        one(timers, F.count_if((F.col("state") == "SCHEDULED") & F.col("cloud_task_id").isNull()), "pending_timers"),
        one(tasks, F.count_if(F.col("state") == "READY"), "ready_tasks"),
        one(tasks, F.count_if(F.col("state") == "RUNNING"), "running_tasks"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), F.lit(True))  # one row each
    return out


def skip_causes(edges: DataFrame, tasks: DataFrame) -> DataFrame:
    """First cause of every skipped task: of its edges that were not a success the earliest,
    ties by upstream and version."""
    bad = edges.where(F.col("resolution").isNotNull() & (F.col("resolution") != "SUCCESS"))
    order = F.struct(F.coalesce("satisfied_at", F.lit(0)).alias("at"), "upstream_task_key", "row_version")
    cause = bad.groupBy("run_id", F.col("downstream_task_key").alias("task_key")).agg(
        F.min_by(F.struct("upstream_task_key", "resolution"), order).alias("c")
    )
    skipped = tasks.where(F.col("state") == "SKIPPED").select("run_id", "task_key")
    return skipped.join(cause, ["run_id", "task_key"]).select(
        "run_id", "task_key", F.col("c.upstream_task_key").alias("cause"), F.col("c.resolution").alias("cause_resolution")
    )


def unmet_outputs(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Succeeded runs with a required output that has not appeared."""
    open_ = tasks.where(F.col("requires_visible_output") & ~F.coalesce("output_visibility_state", F.lit("PENDING")).isin("VISIBLE"))
    return runs.where(F.col("state") == "SUCCEEDED").join(open_, "run_id", "left_semi")


def newest_by_version(files: DataFrame) -> DataFrame:
    return files.groupBy("version").agg(F.max("modified_at").alias("modified_at"))


def sorted_set(items: Column | str) -> Column:
    return F.array_sort(F.array_distinct(items))
