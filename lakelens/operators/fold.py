"""Ordered folds of orchestration events into state tables.

The events of one key form a state machine that must see them in event-id order,
which no aggregate expresses, so each key's events are folded by a Python machine
over Arrow batches: runs by run_id, sensors by sensor_id, backfills by
backfill_id.  Everything that is only "latest wins" stays declarative in
``merge`` and below: schedules, run requests and partition status.

Input events are rows of (event_id, event_type, idempotency_key, ts, payload):
``ts`` in epoch milliseconds, ``payload`` a JSON object.  A key's events all meet
in one task; a run, sensor or backfill is bounded by its own plan.

Defined cases: unknown event types, payloads that aren't objects, lack what their
event needs or hold fields of another type are skipped; an event whose idempotency
key was applied before, by any entity, is skipped, one that was not applied leaves its
key free; null ids are skipped; an empty table gives empty states.
"""

from __future__ import annotations

import json
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.functions.encoded import millis_of_ulid, parse_timer
from lakelens.operators.graph import cut

TERMINAL = {"SUCCEEDED", "FAILED", "SKIPPED", "CANCELLED"}
#: How far a task state is on its way, for ties between versions.
TASK_RANK = {"PLANNED": 0, "BLOCKED": 1, "READY": 2, "DISPATCHED": 3, "RUNNING": 4, "RETRY_WAIT": 5, "SKIPPED": 10, "CANCELLED": 11, "FAILED": 12, "SUCCEEDED": 13}
_COUNTER = {s: f"tasks_{s.lower()}" for s in TERMINAL}

Handler = Callable[["Machine", dict, str, int], bool]


_ANY = {
    str: ("task_key", "attempt_id", "timer_id", "eval_id", "chunk_id", "dispatch_id", "worker_queue", "outcome", "timer_type", "asset_key", "partition_key", "visibility_state", "from_state", "to_state"),
    int: ("attempt", "max_attempts", "heartbeat_at", "fire_at", "state_version", "expected_state_version", "chunk_size", "chunk_index", "published_at"),
    list: ("tasks", "depends_on", "run_requests"),
    dict: ("labels", "output", "visibility"),
}
_TYPES = {name: kind for kind, names in _ANY.items() for name in names}
_NEEDS = {
    "DispatchRequested": ("task_key", "attempt"), "TimerRequested": ("timer_id",), "TimerEnqueued": ("timer_id",), "TimerFired": ("timer_id",),
    "SensorEvaluated": ("eval_id",), "BackfillChunkPlanned": ("chunk_id",), "TaskFinished": ("outcome",), "TaskCompletionRecorded": ("outcome",),
}


def well_formed(kind: str, body: Any) -> bool:
    """Whether a payload has what its event needs, each field of its type where it isn't null."""
    if not isinstance(body, dict) or any(body.get(n) is None for n in _NEEDS.get(kind, ())):
        return False
    for name, value in body.items():
        want = _TYPES.get(name)
        if want and value is not None and (not isinstance(value, want) or isinstance(value, bool)):
            return False
    for d in body.get("tasks") or []:
        if not well_formed("", d) or not isinstance(d.get("key"), str) or not all(isinstance(x, str) for x in d.get("depends_on") or []):
            return False
    return body.get("visibility") is None or well_formed("", body["visibility"])


def _parsed(kind: str, payload: str) -> dict | None:
    """A payload that is well formed for its event, else None."""
    try:
        body = json.loads(payload)
    except ValueError:
        return None
    return body if well_formed(kind, body) else None


#: Transitions only read what they are given, so short payloads, often repeated, are parsed once.
_parsed_once = lru_cache(maxsize=1 << 14)(_parsed)
_SHORT = 1024


class Machine:
    """Applies events in order; ``on`` maps an event type to its transition."""

    on: dict[str, Handler] = {}

    def __init__(self) -> None:
        self.applied: set[str] = set()

    def feed(self, event_id: str, kind: str, key: str | None, ts: int, payload: str | None) -> bool:
        step = self.on.get(kind)
        if step is None or event_id is None or (key is not None and key in self.applied):
            return False
        payload = payload or ""
        body = (_parsed_once if len(payload) <= _SHORT else _parsed)(kind, payload)
        if body is None:
            return False
        done = bool(step(self, body, event_id, int(ts)))
        if done and key is not None:
            self.applied.add(key)
        return done


    # -- state between micro-batches

    def dump(self) -> str:
        """All of the machine as JSON; tuple keys become pairs."""
        out = {}
        for k, v in vars(self).items():
            if isinstance(v, set):
                v = {"set": sorted(v)}
            elif isinstance(v, dict) and any(isinstance(x, tuple) for x in v):
                v = {"pairs": [[*k2, x] for k2, x in v.items()]}
            out[k] = v
        return json.dumps(out)

    def load(self, text: str) -> None:
        for k, v in json.loads(text).items():
            if isinstance(v, dict) and set(v) == {"set"}:
                v = set(v["set"])
            elif isinstance(v, dict) and set(v) == {"pairs"}:
                v = {tuple(x[:-1]): x[-1] for x in v["pairs"]}
            elif isinstance(getattr(self, k, None), defaultdict):
                v = defaultdict(list, v)
            setattr(self, k, v)


def handles(table: dict[str, Handler], *kinds: str) -> Callable[[Handler], Handler]:
    def add(f: Handler) -> Handler:
        table.update(dict.fromkeys(kinds, f))
        return f

    return add


def backoff_seconds(attempt: int) -> int:
    return min(900, 30 << min(max(attempt - 1, 0), 6))


_RUN: dict[str, Handler] = {}


class RunMachine(Machine):
    """One run: its row, tasks, dependency edges, dispatch outbox and timers."""

    on = _RUN

    def __init__(self, run_id: str) -> None:
        super().__init__()
        self.run_id = run_id
        self.run: dict[str, Any] | None = None
        self.tasks: dict[str, dict[str, Any]] = {}
        self.edges: dict[tuple[str, str], dict[str, Any]] = {}
        self.after: dict[str, list[str]] = defaultdict(list)
        self.outbox: dict[str, dict[str, Any]] = {}
        self.timers: dict[str, dict[str, Any]] = {}
        self.finishes: list[dict[str, Any]] = []

    # -- parts shared by transitions

    def outcome(self) -> str:
        r = self.run or {}
        return "CANCELLED" if r["tasks_cancelled"] else "FAILED" if r["tasks_failed"] else "SUCCEEDED"

    def count(self, state: str, event: str, ts: int) -> None:
        """A task has reached a terminal state."""
        if self.run is None:
            return
        self.run["tasks_completed"] += 1
        self.run[_COUNTER[state]] += 1
        self.run["row_version"] = event
        if self.run["tasks_completed"] == self.run["tasks_total"]:
            self.run |= {"state": self.outcome(), "completed_at": ts}

    def current(self, p: dict) -> dict[str, Any] | None:
        """The task, if the event speaks of its current attempt."""
        t = self.tasks.get(p.get("task_key"))
        same = t and (t["attempt"], t["attempt_id"]) == (p.get("attempt"), p.get("attempt_id"))
        return t if same else None

    def consumed(self, task_key: str, attempt: int) -> bool:
        """Whether a dispatch of this attempt has nothing left to do."""
        t = self.tasks.get(task_key)
        if t is None or t["attempt"] < attempt:
            return False
        return t["attempt"] > attempt or t["state"] in TERMINAL | {"RUNNING", "RETRY_WAIT"}

    def dispatch(self, p: dict) -> str:
        return p.get("dispatch_id") or f"dispatch:{self.run_id}:{p.get('task_key')}:{p.get('attempt')}"

    def resolve(self, up: str, down: str, event: str, ts: int, ok: bool, resolution: str, attempt: int | None) -> bool:
        """Settle an edge; True if it was not satisfied before."""
        before = self.edges.get((up, down), {}).get("satisfied", False)
        self.edges[up, down] = {
            "upstream_task_key": up, "downstream_task_key": down, "satisfied": ok, "resolution": resolution,
            "satisfied_at": ts, "satisfying_attempt": attempt, "row_version": event,
        }
        return not before

    def release(self, done: str, attempt: int, event: str, ts: int) -> None:
        for key in self.after[done]:
            if not self.resolve(done, key, event, ts, True, "SUCCESS", attempt) or key not in self.tasks:
                continue
            t = self.tasks[key]
            t["deps_satisfied_count"] += 1
            if t["deps_satisfied_count"] == t["deps_total"] and t["state"] == "BLOCKED":
                t |= {"state": "READY", "ready_at": ts, "row_version": event}

    def spread(self, failed: str, resolution: str, event: str, ts: int) -> None:
        """Skip or cancel what depends on a failed task; terminal tasks stop the spread."""
        queue = deque([(failed, resolution)])
        while queue:
            up, why = queue.popleft()
            for key in self.after[up]:
                self.resolve(up, key, event, ts, False, why, None)
                t = self.tasks.get(key)
                if t is None or t["state"] in TERMINAL:
                    continue
                state = "CANCELLED" if why == "CANCELLED" else "SKIPPED"
                t |= {"state": state, "row_version": event}
                queue.append((key, state))
                self.count(state, event, ts)


@handles(_RUN, "RunTriggered")
def _run_triggered(m: RunMachine, p: dict, event: str, ts: int) -> bool:
    if m.run is not None:
        return False
    done = [t for t in m.tasks.values() if t["state"] in TERMINAL]
    row = {
        "plan_id": p.get("plan_id"), "run_key": p.get("run_key"), "cancel_requested": False,
        "tasks_total": len(m.tasks), "tasks_completed": len(done), "triggered_at": ts, "completed_at": None,
        "labels": json.dumps(p.get("labels") or {}, sort_keys=True), "code_version": p.get("code_version"), "row_version": event,
    }
    m.run = row | {c: sum(t["state"] == s for t in done) for s, c in _COUNTER.items()}
    if not m.tasks:
        m.run["state"] = "TRIGGERED"
    elif len(done) < len(m.tasks):
        m.run["state"] = "RUNNING"
    else:
        m.run["state"] = m.outcome()
        m.run["completed_at"] = max((t["completed_at"] for t in done if t["completed_at"] is not None), default=None)
    return True


@handles(_RUN, "PlanCreated")
def _plan_created(m: RunMachine, p: dict, event: str, ts: int) -> bool:
    plan = p.get("tasks") or []
    if m.tasks:
        return False
    if m.run is not None:
        m.run |= {"tasks_total": len(plan), "state": "RUNNING", "row_version": event}
    for d in plan:
        key, needs = d["key"], d.get("depends_on") or []
        for up in needs:
            m.after[up].append(key)
            m.edges[up, key] = {
                "upstream_task_key": up, "downstream_task_key": key, "satisfied": False, "resolution": None,
                "satisfied_at": None, "satisfying_attempt": None, "row_version": event,
            }
        m.tasks[key] = dict.fromkeys(TASK_COLUMNS) | {
            "task_key": key, "state": "BLOCKED" if needs else "READY", "attempt": 0, "deps_total": len(needs),
            "deps_satisfied_count": 0, "max_attempts": d.get("max_attempts", 1),
            "heartbeat_timeout_sec": d.get("heartbeat_timeout_sec", 60), "ready_at": None if needs else ts,
            "asset_key": d.get("asset_key"), "partition_key": d.get("partition_key"),
            "requires_visible_output": bool(d.get("requires_visible_output")), "row_version": event,
        }
    return bool(plan) or m.run is not None


@handles(_RUN, "RunCancelRequested")
def _cancel(m: RunMachine, p: dict, event: str, ts: int) -> bool:
    if m.run is not None and m.run["state"] in TERMINAL:
        return False
    stopped = [t for t in m.tasks.values() if t["state"] not in TERMINAL | {"RUNNING"}]
    for t in stopped:
        t |= {"state": "CANCELLED", "row_version": event}
    if m.run is not None:
        r = m.run
        r |= {"cancel_requested": True, "row_version": event}
        r["tasks_cancelled"] += len(stopped)
        r["tasks_completed"] += len(stopped)
        if r["tasks_completed"] == r["tasks_total"]:
            r |= {"state": "CANCELLED", "completed_at": ts}
    return bool(stopped) or m.run is not None


@handles(_RUN, "TaskStarted")
def _started(m: RunMachine, p: dict, event: str, ts: int) -> bool:
    t = m.tasks.get(p.get("task_key"))
    attempt, who = p.get("attempt", 0), p.get("attempt_id")
    if t is None or t["state"] in TERMINAL or attempt < t["attempt"]:
        return False
    if attempt == t["attempt"] and t["attempt_id"] not in (None, who):
        return False
    t |= {"state": "RUNNING", "attempt": attempt, "attempt_id": who, "started_at": ts, "row_version": event}
    m.outbox.pop(f"dispatch:{m.run_id}:{t['task_key']}:{attempt}", None)
    return True


@handles(_RUN, "TaskHeartbeat")
def _heartbeat(m: RunMachine, p: dict, event: str, ts: int) -> bool:
    t = m.current(p)
    if t is None or t["state"] in TERMINAL:
        return False
    t |= {"last_heartbeat_at": p.get("heartbeat_at", ts), "row_version": event}
    return True


@handles(_RUN, "TaskFinished", "TaskCompletionRecorded")
def _finished(m: RunMachine, p: dict, event: str, ts: int) -> bool:
    t = m.current(p)
    if t is None or t["state"] in TERMINAL:
        return False
    outcome = p.get("outcome")
    retry = outcome == "FAILED" and p.get("retryable", True) is not False and t["attempt"] < t["max_attempts"]
    state = "RETRY_WAIT" if retry else outcome
    out = p.get("output") or {}
    partition = p.get("partition_key") or out.get("delta_partition")
    t["asset_key"] = t["asset_key"] or p.get("asset_key")
    t["partition_key"] = t["partition_key"] or partition
    t |= {"state": state, "row_version": event, "error_message": None if outcome == "SUCCEEDED" else p.get("error_message"), "retry_not_before": None}
    if retry:
        anchor = millis_of_ulid(event)
        t["retry_not_before"] = (ts if anchor is None else anchor) + 1000 * backoff_seconds(t["attempt"])
    else:
        t["completed_at"] = ts
    lineage = None
    if outcome == "SUCCEEDED":
        told = {"run_id": m.run_id, "task_key": t["task_key"], "attempt": t["attempt"], "materialization_id": p.get("materialization_id")}
        lineage = json.dumps(told | out, sort_keys=True, separators=(",", ":"))
        t |= {"materialization_id": p.get("materialization_id"), "execution_lineage_ref": lineage}
        t |= {k: out.get(k) for k in ("delta_table", "delta_version", "delta_partition")}
    else:
        t |= dict.fromkeys(("output_visibility_state", "published_at", "publish_error"))
    if not retry:
        m.count(state, event, ts)
    if outcome == "SUCCEEDED":
        m.release(t["task_key"], t["attempt"], event, ts)
    elif not retry:
        m.spread(t["task_key"], outcome, event, ts)
    if p.get("asset_key") and partition:
        m.finishes.append({
            "asset_key": p["asset_key"], "partition_key": partition, "outcome": outcome, "at": ts, "event_id": event,
            "code_version": p.get("code_version"), "execution_lineage_ref": lineage,
        } | {k: out.get(k) for k in ("delta_table", "delta_version", "delta_partition")})
    if outcome == "SUCCEEDED" and p.get("visibility"):
        _visibility(m, p | p["visibility"], event, ts)
    return True


@handles(_RUN, "TaskOutputVisibilityChanged")
def _visibility(m: RunMachine, p: dict, event: str, ts: int) -> bool:
    t = m.current(p)
    state = p.get("visibility_state")
    if t is None or t["state"] != "SUCCEEDED" or t["output_visibility_state"] in {"VISIBLE", "FAILED"} - {state}:
        return False
    t |= {
        "output_visibility_state": state, "row_version": event,
        "published_at": p.get("published_at", ts) if state == "VISIBLE" else None,
        "publish_error": p.get("publish_error") if state == "FAILED" else None,
    }
    return True


@handles(_RUN, "DispatchRequested")
def _dispatch_requested(m: RunMachine, p: dict, event: str, ts: int) -> bool:
    key, attempt, name = p["task_key"], p["attempt"], m.dispatch(p)
    queue = p.get("worker_queue") or "default-queue"
    if m.consumed(key, attempt):
        m.outbox.pop(name, None)
        return False
    row, changed = m.outbox.get(name), False
    if row is None:
        changed = True
        who = p.get("attempt_id")
        m.outbox[name] = {
            "task_key": key, "attempt": attempt, "dispatch_id": name, "cloud_task_id": None, "status": "PENDING",
            "attempt_id": who, "worker_queue": queue, "created_at": ts, "row_version": event,
        }
    else:  # an enqueue came first: only fill in what it could not know
        if not row["attempt_id"]:
            row["attempt_id"], changed = p.get("attempt_id"), True
        if row["worker_queue"] in ("", "default-queue") and row["worker_queue"] != queue:
            row["worker_queue"], changed = queue, True
        who = row["attempt_id"]
    t = m.tasks.get(key)
    if t and t["state"] in {"READY", "RETRY_WAIT", "DISPATCHED"} and attempt >= t["attempt"]:
        if (t["state"], t["attempt"], t["attempt_id"]) != ("DISPATCHED", attempt, who):
            t |= {"state": "DISPATCHED", "attempt": attempt, "attempt_id": who, "retry_not_before": None, "row_version": event}
            changed = True
    return changed


@handles(_RUN, "DispatchEnqueued")
def _dispatch_enqueued(m: RunMachine, p: dict, event: str, ts: int) -> bool:
    key, attempt, name = p.get("task_key"), p.get("attempt"), m.dispatch(p)
    if key is not None and attempt is not None and m.consumed(key, attempt):
        m.outbox.pop(name, None)
        return False
    row = m.outbox.get(name)
    if row is None:
        if key is None or attempt is None:
            return False
        row = m.outbox[name] = {"task_key": key, "attempt": attempt, "dispatch_id": name, "attempt_id": "", "worker_queue": "default-queue", "row_version": ""}
    if event <= row["row_version"]:
        return False
    row |= {"status": "CREATED", "cloud_task_id": p.get("cloud_task_id"), "created_at": ts, "row_version": event}
    return True


def _timer(m: Any, p: dict, event: str, state: str) -> dict[str, Any] | None:
    """A timer row that an event other than its request makes, from what its id says."""
    said = parse_timer(p["timer_id"])
    if said is None:
        return None
    row = {"timer_id": p["timer_id"], "cloud_task_id": None, "payload": None, "state": state, "row_version": event}
    row |= {"timer_type": said["timer_type"], "fire_at": said["fire_at"]}
    return row | {k: p[k] if p.get(k) is not None else said[k] for k in ("run_id", "task_key", "attempt")}


@handles(_RUN, "TimerRequested")
def _timer_requested(m: RunMachine, p: dict, event: str, ts: int) -> bool:
    name, row = p["timer_id"], m.timers.get(p["timer_id"])
    fields = ("run_id", "task_key", "attempt")
    if row is None:
        m.timers[name] = {
            "timer_id": name, "cloud_task_id": None, "timer_type": p.get("timer_type"), "fire_at": p.get("fire_at"),
            "state": "SCHEDULED", "payload": None, "row_version": event,
        } | {k: p.get(k) for k in fields}
        changed = True
    else:  # the request has the last word on the time, not on the state
        before = dict(row)
        row["fire_at"] = p.get("fire_at")
        row |= {k: p.get(k) for k in fields if row[k] is None}
        changed = row != before
    t = m.tasks.get(p.get("task_key"))
    if p.get("timer_type") == "RETRY" and t and (t["state"], t["attempt"]) == ("RETRY_WAIT", p.get("attempt")):
        t |= {"retry_not_before": p.get("fire_at"), "row_version": event}
        changed = True
    return changed


@handles(_RUN, "TimerEnqueued", "TimerFired")
def _timer_moved(m: RunMachine, p: dict, event: str, ts: int) -> bool:
    fired = "cloud_task_id" not in p
    row = m.timers.get(p["timer_id"])
    if row is None:
        row = _timer(m, p, "", "SCHEDULED")
        if row is None:
            return False
        m.timers[p["timer_id"]] = row
    if event <= row["row_version"]:
        return False
    row |= {"row_version": event} | ({"state": "FIRED"} if fired else {"cloud_task_id": p["cloud_task_id"]})
    return True


RUN_COLUMNS = ["plan_id", "state", "run_key", "cancel_requested", "tasks_total", "tasks_completed", "tasks_succeeded", "tasks_failed", "tasks_skipped", "tasks_cancelled", "triggered_at", "completed_at", "labels", "code_version", "row_version"]
TASK_COLUMNS = ["task_key", "state", "attempt", "attempt_id", "started_at", "completed_at", "error_message", "deps_total", "deps_satisfied_count", "max_attempts", "heartbeat_timeout_sec", "last_heartbeat_at", "ready_at", "asset_key", "partition_key", "requires_visible_output", "materialization_id", "output_visibility_state", "published_at", "publish_error", "retry_not_before", "delta_table", "delta_version", "delta_partition", "execution_lineage_ref", "row_version"]

_SENSOR: dict[str, Handler] = {}


class SensorMachine(Machine):
    """One sensor: its cursor under compare-and-set, and its evaluations."""

    on = _SENSOR

    def __init__(self, sensor_id: str) -> None:
        super().__init__()
        self.state = {"sensor_id": sensor_id, "cursor": None, "last_evaluation_at": None, "last_eval_id": None, "status": "ACTIVE", "state_version": 0, "row_version": ""}
        self.evals: dict[str, dict[str, Any]] = {}


@handles(_SENSOR, "SensorEvaluated")
def _evaluated(m: SensorMachine, p: dict, event: str, ts: int) -> bool:
    expected = p.get("expected_state_version")
    stale = expected is not None and expected != m.state["state_version"]
    name, changed = p["eval_id"], False
    if event > m.evals.get(name, {}).get("row_version", ""):
        m.evals[name] = {
            "sensor_id": m.state["sensor_id"], "eval_id": name, "cursor_before": p.get("cursor_before"),
            "cursor_after": p.get("cursor_after"), "expected_state_version": expected,
            "trigger_source": json.dumps(p.get("trigger_source")), "run_requests": json.dumps(p.get("run_requests") or []),
            "status": "SKIPPED_STALE_CURSOR" if stale else p.get("status"), "evaluated_at": ts, "row_version": event,
        }
        changed = True
    if stale or event <= m.state["row_version"]:
        return changed
    m.state |= {"cursor": p.get("cursor_after"), "last_evaluation_at": ts, "last_eval_id": name, "row_version": event}
    m.state["state_version"] += 1
    return True


_BACKFILL: dict[str, Handler] = {}
#: Where a backfill's state may go.
BACKFILL_MOVES = {"PENDING": {"RUNNING"}, "RUNNING": {"PAUSED", "SUCCEEDED", "FAILED", "CANCELLED"}, "PAUSED": {"RUNNING", "CANCELLED"}}


class BackfillMachine(Machine):
    """One backfill and its chunks."""

    on = _BACKFILL

    def __init__(self, backfill_id: str) -> None:
        super().__init__()
        self.name = backfill_id
        self.row: dict[str, Any] | None = None
        self.chunks: dict[str, dict[str, Any]] = {}

    def prefix(self, start: int) -> int:
        """First chunk index not planned yet."""
        while f"{self.name}:{start}" in self.chunks:
            start += 1
        return start


@handles(_BACKFILL, "BackfillCreated")
def _backfill_created(m: BackfillMachine, p: dict, event: str, ts: int) -> bool:
    if m.row is not None:
        return False
    m.row = {
        "asset_selection": json.dumps(p.get("asset_selection") or []), "code_version": p.get("code_version"),
        "partition_selector": json.dumps(p.get("partition_selector")), "chunk_size": p.get("chunk_size", 0),
        "max_concurrent_runs": p.get("max_concurrent_runs", 0), "state": "RUNNING", "state_version": 1,
        "total_partitions": p.get("total_partitions", 0), "planned_chunks": m.prefix(0) if p.get("chunk_size") else 0,
        "completed_chunks": 0, "failed_chunks": 0, "parent_backfill_id": p.get("parent_backfill_id"), "created_at": ts, "row_version": event,
    }
    return True


@handles(_BACKFILL, "BackfillChunkPlanned")
def _chunk_planned(m: BackfillMachine, p: dict, event: str, ts: int) -> bool:
    name = p["chunk_id"]
    before = m.chunks.get(name, {})
    if event <= before.get("row_version", ""):
        return False
    m.chunks[name] = {
        "chunk_id": name, "chunk_index": p.get("chunk_index"), "partition_keys": json.dumps(p.get("partition_keys") or []),
        "run_key": p.get("run_key"), "run_id": before.get("run_id"), "state": "PLANNED", "row_version": event,
    }
    if m.row is not None and (n := m.prefix(m.row["planned_chunks"])) != m.row["planned_chunks"]:
        m.row |= {"planned_chunks": n, "row_version": event}
    return True


@handles(_BACKFILL, "BackfillStateChanged")
def _backfill_moved(m: BackfillMachine, p: dict, event: str, ts: int) -> bool:
    r = m.row
    if r is None or event <= r["row_version"] or r["state"] != p.get("from_state"):
        return False
    if p.get("to_state") not in BACKFILL_MOVES.get(r["state"], ()) or p.get("state_version") != r["state_version"] + 1:
        return False
    r |= {"state": p["to_state"], "state_version": p["state_version"], "row_version": event}
    return True


# -- Spark side ------------------------------------------------------------------

FOLDED = "fold_key string, entity string, entity_key string, row_version string, state string"


def _rows_of(m: Machine, key: str) -> Iterator[tuple[str, str, dict]]:
    if isinstance(m, RunMachine):
        if m.run is not None:
            yield "run", key, m.run
        yield from (("task", k, t) for k, t in m.tasks.items())
        yield from (("edge", f"{a}>{b}", e) for (a, b), e in m.edges.items())
        yield from (("outbox", k, o) for k, o in m.outbox.items())
        yield from (("timer", k, t) for k, t in m.timers.items())
        yield from (("finish", f["event_id"], f | {"row_version": f["event_id"]}) for f in m.finishes)
    elif isinstance(m, SensorMachine):
        yield "sensor", key, m.state
        yield from (("eval", k, e) for k, e in m.evals.items())
    elif isinstance(m, BackfillMachine):
        if m.row is not None:
            yield "backfill", key, m.row
        yield from (("chunk", k, c) for k, c in m.chunks.items())


MACHINES: dict[str, type] = {"run_id": RunMachine, "sensor_id": SensorMachine, "backfill_id": BackfillMachine}


def fold_events(events: DataFrame, by: str, only: tuple[str, ...] = ()) -> DataFrame:
    """Final rows of every key's machine as JSON, by entity; with ``only`` those of the
    entities named, all events being folded just the same.  ``events`` carry the key in
    column ``by`` (run_id, sensor_id or backfill_id).  Keys are dealt out by hash and come
    to their task in order, so a machine holds one key's rows and no more.

    An idempotency key counts once over all machines.  Machines that share none with
    others are folded in one pass.  The few that do are folded again and again, without
    the events whose key an earlier event of another machine was seen to apply, until
    that set stays the same; each round settles at least the earliest open event."""
    wanted = events.where(F.col(by).isNotNull() & F.col("event_id").isNotNull() & F.col("event_type").isin(*MACHINES[by].on))
    slim = wanted.select(F.col(by).cast("string").alias(by), "event_id", "event_type", "idempotency_key", F.col("ts").cast("long").alias("ts"), "payload")
    named = slim.where(F.col("idempotency_key").isNotNull()).groupBy("idempotency_key").agg(F.min(by).alias("a"), F.max(by).alias("b"))
    shared = cut(named.where("a <> b").select("idempotency_key"))
    if shared.isEmpty():
        return _folded(slim, by, only=only)
    touched = cut(slim.join(shared, "idempotency_key").select(by).distinct())
    some = slim.join(touched, by)
    banned = cut(some.select(by, "event_id").limit(0))
    while True:
        got = cut(_folded(some.join(banned, [by, "event_id"], "left_anti"), by, told=True, only=only))
        applied = got.where("entity = 'applied'").select(F.col("entity_key").alias("idempotency_key"), F.col("row_version").alias("event_id"))
        first = applied.join(shared, "idempotency_key").groupBy("idempotency_key").agg(F.min("event_id").alias("first"))
        late = cut(some.join(first, "idempotency_key").where("event_id > first").select(by, "event_id").distinct())
        if late.exceptAll(banned).isEmpty() and banned.exceptAll(late).isEmpty():
            return _folded(slim.join(touched, by, "left_anti"), by, only=only).union(got.where("entity <> 'applied'"))
        banned = late


def _folded(slim: DataFrame, by: str, told: bool = False, only: tuple[str, ...] = ()) -> DataFrame:
    """One pass over the machines; with ``told`` also a row for each applied idempotency key."""
    make = MACHINES[by]
    names = ("event_id", "event_type", "idempotency_key", "ts", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, now, last = None, None, None
        out: list[tuple] = []

        def close() -> None:
            if machine is not None:
                out.extend((now, e, k, r.get("row_version"), json.dumps(r, sort_keys=True)) for e, k, r in _rows_of(machine, now) if not only or e in only)

        def give() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * 5
            out.clear()
            return pa.record_batch([pa.array(c, pa.string()) for c in cols], names=["fold_key", "entity", "entity_key", "row_version", "state"])

        for batch in batches:
            for key, *event in zip(batch.column(by).to_pylist(), *(batch.column(n).to_pylist() for n in names)):
                if key != now:
                    close()
                    machine, now, last = make(key), key, None
                if event[0] != last:  # a repeated event id counts once
                    if machine.feed(*event) and told and event[2] is not None:
                        out.append((key, "applied", event[2], event[0], None))
                    last = event[0]
            yield give()
        close()
        yield give()

    return slim.repartition(by).sortWithinPartitions(by, "event_id").mapInArrow(run, FOLDED)


def entity(folded: DataFrame, name: str, schema: str, key: str) -> DataFrame:
    """One entity's table from folded rows, its JSON read with ``schema``."""
    rows = folded.where(F.col("entity") == name)
    return rows.select(F.col("fold_key").alias(key), F.from_json("state", schema).alias("s")).select(key, "s.*")


def partition_status(finishes: DataFrame) -> DataFrame:
    """State of every (asset, partition) from accepted finishes, latest event last: a
    success sets the materialization and clears staleness, every outcome the attempt."""
    order = F.struct("event_id")
    last = lambda c: F.max_by(c, order)
    won = F.when(F.col("outcome") == "SUCCEEDED", F.col("event_id"))
    good = lambda c: F.max_by(c, won)
    return finishes.groupBy("asset_key", "partition_key").agg(
        good("run_id").alias("last_materialization_run_id"),
        good("at").alias("last_materialization_at"),
        good("code_version").alias("last_materialization_code_version"),
        last("run_id").alias("last_attempt_run_id"),
        last("at").alias("last_attempt_at"),
        last("outcome").alias("last_attempt_outcome"),
        *(good(c).alias(c) for c in ("delta_table", "delta_version", "delta_partition", "execution_lineage_ref")),
        F.max("event_id").alias("row_version"),
    )


def catalog_run_index(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Runs with their asset tasks; versions take the later of both."""
    from lakelens.functions.scalars import asset_namespace_table, first_label

    t = tasks.where(F.col("asset_key").isNotNull()).alias("t")
    r = runs.withColumn("labels_map", F.from_json("labels", "map<string,string>")).alias("r")
    parts = asset_namespace_table(F.col("t.asset_key"))
    return r.join(t, "run_id").select(
        "run_id",
        "t.task_key",
        "r.plan_id",
        "r.run_key",
        first_label("labels_map", "kind", "run_kind").alias("kind"),
        F.col("r.state").alias("run_status"),
        "r.cancel_requested",
        F.col("t.state").alias("task_status"),
        "t.asset_key",
        parts["namespace"].alias("target_namespace"),
        parts["table"].alias("target_table"),
        "t.partition_key",
        "t.attempt",
        "t.output_visibility_state",
        "r.triggered_at",
        F.coalesce("t.completed_at", "r.completed_at").alias("completed_at"),
        F.greatest("r.row_version", "t.row_version").alias("row_version"),
    )


def run_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, conflicts) from run requests: the first request of a run key stands; later
    ones with another fingerprint conflict, with the same one say nothing new."""
    first = requests.groupBy("run_key").agg(
        F.min_by(F.struct("request_fingerprint", "code_version", "ts"), "event_id").alias("f"), F.min("event_id").alias("row_version")
    )
    index = first.select("run_key", "f.request_fingerprint", "f.code_version", F.col("f.ts").alias("created_at"), "row_version")
    known = index.select("run_key", F.col("request_fingerprint").alias("existing_fingerprint"), F.col("row_version").alias("first"))
    conflicts = (
        requests.join(known, "run_key")
        .where((F.col("event_id") > F.col("first")) & ~F.col("request_fingerprint").eqNullSafe(F.col("existing_fingerprint")))
        .select(
            "run_key", "existing_fingerprint", F.col("request_fingerprint").alias("conflicting_fingerprint"),
            F.col("event_id").alias("conflicting_event_id"), F.col("ts").alias("detected_at"),
        )
    )
    return index, conflicts
