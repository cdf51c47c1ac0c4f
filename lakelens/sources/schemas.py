"""Schemas of the metadata and state tables.

Ids are strings and times epoch milliseconds.  The column lists are fixed values:
files at rest have them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING, LONG, INT, BOOLEAN, FLOAT = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.FloatType()

#: Name and type of each column, and whether it may be null.
_COLUMNS = {
    "catalog.catalogs": (
        ("id", STRING, False), ("name", STRING, False), ("description", STRING, True), ("created_at", LONG, False), ("updated_at", LONG, False),
        ("properties_json", STRING, True), ("storage_root", STRING, True),
    ),
    "catalog.namespaces": (
        ("id", STRING, False), ("catalog_id", STRING, True), ("name", STRING, False), ("description", STRING, True), ("created_at", LONG, False),
        ("updated_at", LONG, False), ("properties_json", STRING, True), ("storage_root", STRING, True),
    ),
    "catalog.tables": (
        ("id", STRING, False), ("namespace_id", STRING, False), ("name", STRING, False), ("description", STRING, True), ("location", STRING, True),
        ("format", STRING, True), ("created_at", LONG, False), ("updated_at", LONG, False), ("table_type", STRING, True),
        ("properties_json", STRING, True),
    ),
    "catalog.columns": (
        ("id", STRING, False), ("table_id", STRING, False), ("name", STRING, False), ("data_type", STRING, False), ("is_nullable", BOOLEAN, False),
        ("ordinal", INT, False), ("description", STRING, True),
    ),
    "catalog.commits": (
        ("commit_ulid", STRING, False), ("snapshot_version", LONG, False), ("published_at", LONG, False), ("fencing_token", LONG, False),
        ("watermark_event_id", STRING, True), ("operation", STRING, True), ("object_type", STRING, True), ("object_id", STRING, True),
        ("object_name", STRING, True), ("manifest_id", STRING, True), ("event_witnesses_json", STRING, True),
    ),
    "catalog.snapshots": (
        ("snapshot_id", STRING, False), ("record_version", LONG, False), ("created_at", LONG, False), ("retained_until", LONG, False),
        ("retention_status", STRING, False), ("domain_count", LONG, False), ("parent_snapshot_id", STRING, True),
        ("has_legacy_compatibility", BOOLEAN, False),
    ),
    "catalog.transactions": (
        ("handle_id", STRING, False), ("record_version", LONG, False), ("lifecycle", STRING, False), ("created_at", LONG, False),
        ("updated_at", LONG, False), ("expires_at", LONG, False), ("prepared_at", LONG, True), ("committing_at", LONG, True),
        ("visible_at", LONG, True), ("terminal_at", LONG, True), ("mutation_count", LONG, False), ("visible_mutation_count", LONG, False),
    ),
    "lineage.edges": (
        ("id", STRING, False), ("source_id", STRING, False), ("target_id", STRING, False), ("edge_type", STRING, False), ("run_id", STRING, True),
        ("created_at", LONG, False),
    ),
    "search.postings": (
        ("token", STRING, False), ("token_norm", STRING, False), ("doc_type", STRING, False), ("doc_id", STRING, False), ("field", STRING, False),
        ("score", FLOAT, False),
    ),
    "orchestration.runs": (
        ("run_id", STRING, False), ("plan_id", STRING, False), ("state", STRING, False), ("run_key", STRING, True),
        ("cancel_requested", BOOLEAN, False), ("tasks_total", LONG, False), ("tasks_completed", LONG, False), ("tasks_succeeded", LONG, False),
        ("tasks_failed", LONG, False), ("tasks_skipped", LONG, False), ("tasks_cancelled", LONG, False), ("triggered_at", LONG, False),
        ("completed_at", LONG, True), ("labels", STRING, True), ("code_version", STRING, True), ("row_version", STRING, False),
    ),
    "orchestration.tasks": (
        ("run_id", STRING, False), ("task_key", STRING, False), ("state", STRING, False), ("attempt", LONG, False), ("attempt_id", STRING, True),
        ("started_at", LONG, True), ("completed_at", LONG, True), ("error_message", STRING, True), ("deps_total", LONG, False),
        ("deps_satisfied_count", LONG, False), ("max_attempts", LONG, False), ("heartbeat_timeout_sec", LONG, False),
        ("last_heartbeat_at", LONG, True), ("ready_at", LONG, True), ("asset_key", STRING, True), ("partition_key", STRING, True),
        ("requires_visible_output", BOOLEAN, True), ("materialization_id", STRING, True), ("output_visibility_state", STRING, True),
        ("published_at", LONG, True), ("publish_error", STRING, True), ("retry_not_before", LONG, True), ("delta_table", STRING, True),
        ("delta_version", LONG, True), ("delta_partition", STRING, True), ("execution_lineage_ref", STRING, True), ("row_version", STRING, False),
    ),
    "orchestration.catalog_run_index": (
        ("schema_version", LONG, False), ("org_id", STRING, False), ("workspace_id", STRING, False), ("run_id", STRING, False),
        ("task_key", STRING, False), ("plan_id", STRING, False), ("run_key", STRING, True), ("kind", STRING, True), ("reference_id", STRING, True),
        ("source_type", STRING, True), ("run_status", STRING, False), ("cancel_requested", BOOLEAN, False), ("task_status", STRING, False),
        ("asset_key", STRING, True), ("target_namespace", STRING, True), ("target_table", STRING, True), ("partition_key", STRING, True),
        ("attempt", LONG, False), ("attempt_id", STRING, True), ("requires_visible_output", BOOLEAN, False), ("materialization_id", STRING, True),
        ("output_visibility_state", STRING, True), ("published_at", LONG, True), ("publish_error", STRING, True), ("delta_table", STRING, True),
        ("delta_version", LONG, True), ("delta_partition", STRING, True), ("execution_lineage_ref", STRING, True), ("started_at", LONG, True),
        ("last_heartbeat_at", LONG, True), ("triggered_at", LONG, False), ("completed_at", LONG, True), ("updated_at", LONG, False),
        ("code_version", STRING, True), ("error_message", STRING, True), ("row_version", STRING, False),
    ),
    "orchestration.dep_satisfaction": (
        ("run_id", STRING, False), ("upstream_task_key", STRING, False), ("downstream_task_key", STRING, False), ("satisfied", BOOLEAN, False),
        ("resolution", STRING, True), ("satisfied_at", LONG, True), ("satisfying_attempt", LONG, True), ("row_version", STRING, False),
    ),
    "orchestration.timers": (
        ("timer_id", STRING, False), ("cloud_task_id", STRING, True), ("timer_type", STRING, False), ("run_id", STRING, True),
        ("task_key", STRING, True), ("attempt", LONG, True), ("fire_at", LONG, False), ("state", STRING, False), ("payload", STRING, True),
        ("row_version", STRING, False),
    ),
    "orchestration.dispatch_outbox": (
        ("run_id", STRING, False), ("task_key", STRING, False), ("attempt", LONG, False), ("dispatch_id", STRING, False),
        ("cloud_task_id", STRING, True), ("status", STRING, False), ("attempt_id", STRING, False), ("worker_queue", STRING, False),
        ("created_at", LONG, False), ("row_version", STRING, False),
    ),
    "orchestration.sensor_state": (
        ("tenant_id", STRING, False), ("workspace_id", STRING, False), ("sensor_id", STRING, False), ("cursor", STRING, True),
        ("last_evaluation_at", LONG, True), ("last_eval_id", STRING, True), ("status", STRING, False), ("state_version", LONG, False),
        ("row_version", STRING, False),
    ),
    "orchestration.sensor_evals": (
        ("tenant_id", STRING, False), ("workspace_id", STRING, False), ("eval_id", STRING, False), ("sensor_id", STRING, False),
        ("cursor_before", STRING, True), ("cursor_after", STRING, True), ("expected_state_version", LONG, True), ("trigger_source", STRING, False),
        ("run_requests", STRING, True), ("status", STRING, False), ("evaluated_at", LONG, False), ("row_version", STRING, False),
    ),
    "orchestration.run_key_index": (
        ("tenant_id", STRING, False), ("workspace_id", STRING, False), ("run_key", STRING, False), ("run_id", STRING, False),
        ("request_fingerprint", STRING, False), ("code_version", STRING, True), ("created_at", LONG, False), ("row_version", STRING, False),
    ),
    "orchestration.run_key_conflicts": (
        ("tenant_id", STRING, False), ("workspace_id", STRING, False), ("run_key", STRING, False), ("existing_fingerprint", STRING, False),
        ("conflicting_fingerprint", STRING, False), ("conflicting_event_id", STRING, False), ("detected_at", LONG, False),
    ),
    "orchestration.partition_status": (
        ("tenant_id", STRING, False), ("workspace_id", STRING, False), ("asset_key", STRING, False), ("partition_key", STRING, False),
        ("last_materialization_run_id", STRING, True), ("last_materialization_at", LONG, True), ("last_materialization_code_version", STRING, True),
        ("last_attempt_run_id", STRING, True), ("last_attempt_at", LONG, True), ("last_attempt_outcome", STRING, True), ("stale_since", LONG, True),
        ("stale_reason_code", STRING, True), ("partition_values", STRING, True), ("delta_table", STRING, True), ("delta_version", LONG, True),
        ("delta_partition", STRING, True), ("execution_lineage_ref", STRING, True), ("row_version", STRING, False),
    ),
    "orchestration.idempotency_keys": (
        ("tenant_id", STRING, False), ("workspace_id", STRING, False), ("idempotency_key", STRING, False), ("event_id", STRING, False),
        ("event_type", STRING, False), ("recorded_at", LONG, False), ("row_version", STRING, False),
    ),
    "orchestration.schedule_definitions": (
        ("tenant_id", STRING, False), ("workspace_id", STRING, False), ("schedule_id", STRING, False), ("cron_expression", STRING, False),
        ("timezone", STRING, False), ("catchup_window_minutes", LONG, False), ("asset_selection", STRING, True), ("code_version", STRING, True),
        ("max_catchup_ticks", LONG, False), ("enabled", BOOLEAN, False), ("created_at", LONG, False), ("row_version", STRING, False),
    ),
    "orchestration.schedule_state": (
        ("tenant_id", STRING, False), ("workspace_id", STRING, False), ("schedule_id", STRING, False), ("last_scheduled_for", LONG, True),
        ("last_tick_id", STRING, True), ("last_run_key", STRING, True), ("row_version", STRING, False),
    ),
    "orchestration.schedule_ticks": (
        ("tenant_id", STRING, False), ("workspace_id", STRING, False), ("tick_id", STRING, False), ("schedule_id", STRING, False),
        ("scheduled_for", LONG, False), ("definition_version", STRING, False), ("asset_selection", STRING, True),
        ("partition_selection", STRING, True), ("status", STRING, False), ("run_key", STRING, True), ("run_id", STRING, True),
        ("request_fingerprint", STRING, True), ("row_version", STRING, False),
    ),
    "orchestration.backfills": (
        ("tenant_id", STRING, False), ("workspace_id", STRING, False), ("backfill_id", STRING, False), ("asset_selection", STRING, False),
        ("code_version", STRING, True), ("partition_selector", STRING, False), ("chunk_size", LONG, False), ("max_concurrent_runs", LONG, False),
        ("state", STRING, False), ("state_version", LONG, False), ("total_partitions", LONG, False), ("planned_chunks", LONG, False),
        ("completed_chunks", LONG, False), ("failed_chunks", LONG, False), ("parent_backfill_id", STRING, True), ("created_at", LONG, False),
        ("row_version", STRING, False),
    ),
    "orchestration.backfill_chunks": (
        ("tenant_id", STRING, False), ("workspace_id", STRING, False), ("chunk_id", STRING, False), ("backfill_id", STRING, False),
        ("chunk_index", LONG, False), ("partition_keys", STRING, False), ("run_key", STRING, False), ("run_id", STRING, True),
        ("state", STRING, False), ("row_version", STRING, False),
    ),
    "metastore.objects": (
        ("schema_version", INT, False), ("ledger_watermark", STRING, False), ("object_id", STRING, False), ("object_type", STRING, False),
        ("name", STRING, True), ("owner", STRING, True), ("lifecycle_state", STRING, False), ("updated_at", LONG, False), ("url", STRING, True),
        ("credential_id", STRING, True), ("workspace_id", STRING, True), ("bound_object_id", STRING, True), ("bound_object_type", STRING, True),
        ("properties_json", STRING, True),
    ),
}

INTERNAL = {"orchestration.run_key_index", "orchestration.idempotency_keys", "search.postings", "metastore.objects"}
#: Columns of a public table that never leave the engine.
HIDDEN = {"catalog.commits": ("manifest_id", "event_witnesses_json")}
#: Tables whose files must have exactly the declared schema.
EXACT = {"catalog.snapshots", "catalog.transactions"}
#: Primary keys, where not the first column alone.
KEYS = {"orchestration.tasks": ("run_id", "task_key"), "orchestration.catalog_run_index": ("org_id", "workspace_id", "run_id", "task_key"), "orchestration.dep_satisfaction": ("run_id", "upstream_task_key", "downstream_task_key"), "orchestration.partition_status": ("asset_key", "partition_key"), "orchestration.dispatch_outbox": ("dispatch_id",), "orchestration.run_key_conflicts": ("run_key", "conflicting_event_id"), "orchestration.sensor_state": ("sensor_id",), "orchestration.sensor_evals": ("eval_id",), "orchestration.run_key_index": ("run_key",), "orchestration.schedule_definitions": ("schedule_id",), "orchestration.schedule_state": ("schedule_id",), "orchestration.schedule_ticks": ("tick_id",), "orchestration.backfills": ("backfill_id",), "orchestration.backfill_chunks": ("chunk_id",), "orchestration.idempotency_keys": ("idempotency_key",), "metastore.objects": ("object_type", "object_id")}


def schema(name: str) -> T.StructType:
    return T.StructType([T.StructField(*column) for column in _COLUMNS[name]])


def names() -> list[str]:
    return list(_COLUMNS)


def public_names() -> list[str]:
    return [n for n in _COLUMNS if n not in INTERNAL]


def primary_key(name: str) -> tuple[str, ...]:
    return KEYS.get(name, (schema(name).fieldNames()[0],))


class SchemaMismatch(ValueError):
    pass


def safe_projection(df: DataFrame, name: str) -> DataFrame:
    """The public columns of a table; a missing or incompatible one is an error."""
    have = {f.name: f.dataType for f in df.schema}
    out = []
    for f in schema(name):
        if f.name in HIDDEN.get(name, ()):
            continue
        if f.name not in have:
            raise SchemaMismatch(f"{name} lacks column {f.name}")
        if have[f.name] != f.dataType:
            raise SchemaMismatch(f"{name}.{f.name} is {have[f.name].simpleString()}")
        out.append(F.col(f.name))
    return df.select(*out)


def require_exact(df: DataFrame, name: str) -> DataFrame:
    want = [(f.name, f.dataType) for f in schema(name)]
    if [(f.name, f.dataType) for f in df.schema] != want:
        raise SchemaMismatch(f"{name} does not have its exact schema")
    return df


def check_evolution(old: T.StructType, new: T.StructType) -> list[str]:
    """What ``new`` breaks: columns may be added if nullable and may become nullable; none
    may go, change its type or stop being nullable."""
    found = []
    now = {f.name: f for f in new}
    for f in old:
        g = now.get(f.name)
        if g is None:
            found.append(f"{f.name} was removed")
        elif g.dataType != f.dataType:
            found.append(f"{f.name} changed from {f.dataType.simpleString()} to {g.dataType.simpleString()}")
        elif f.nullable and not g.nullable:
            found.append(f"{f.name} is no longer nullable")
    was = set(old.fieldNames())
    return found + [f"{f.name} was added but is not nullable" for f in new if f.name not in was and not f.nullable]
