import json
import random
import time

import pytest

from lakelens.operators import fold
from lakelens.operators.metastore import FoldError, fold_catalog, object_names, principal_names, replay, safe_objects
from lakelens.streaming.folds import fold_stream

EVENTS = "run_id string, event_id string, event_type string, idempotency_key string, ts long, payload string"


def machine(*events, kind=fold.RunMachine, key="r"):
    m = kind(key)
    for i, (name, body) in enumerate(events):
        m.feed(f"{i:03d}", name, f"k{i}", 1000 * i, json.dumps(body))
    return m


PLAN = ("PlanCreated", {"tasks": [{"key": "a"}, {"key": "b", "depends_on": ["a"], "max_attempts": 2}, {"key": "c", "depends_on": ["b"]}]})
RUN = ("RunTriggered", {"plan_id": "p", "labels": {"kind": "x"}})


def attempt(key, n=1, **more):
    return {"task_key": key, "attempt": n, "attempt_id": f"{key}{n}"} | more


def started(key, n=1):
    return ("TaskStarted", attempt(key, n))


def done(key, outcome="SUCCEEDED", n=1, **more):
    return ("TaskFinished", attempt(key, n, outcome=outcome, **more))


def states(m):
    return {k: t["state"] for k, t in m.tasks.items()}


def test_success_releases_dependants():
    m = machine(RUN, PLAN, started("a"), done("a"))
    assert states(m) == {"a": "SUCCEEDED", "b": "READY", "c": "BLOCKED"} and m.run["tasks_succeeded"] == 1 and m.run["state"] == "RUNNING"
    assert m.edges["a", "b"]["satisfied"] and m.edges["a", "b"]["resolution"] == "SUCCESS"


def test_retry_then_failure_spreads():
    m = machine(RUN, PLAN, started("a"), done("a"), started("b"), done("b", "FAILED"))
    assert states(m)["b"] == "RETRY_WAIT" and m.tasks["b"]["retry_not_before"] == 5000 + 30_000
    m = machine(RUN, PLAN, started("a"), done("a"), started("b"), done("b", "FAILED"), started("b", 2), done("b", "FAILED", 2))
    assert states(m) == {"a": "SUCCEEDED", "b": "FAILED", "c": "SKIPPED"} and m.run["state"] == "FAILED" and m.run["tasks_completed"] == 3
    m = machine(RUN, PLAN, started("a"), done("a", "FAILED", retryable=False))
    assert states(m) == {"a": "FAILED", "b": "SKIPPED", "c": "SKIPPED"}
    assert m.edges["a", "b"]["resolution"] == "FAILED" and m.edges["b", "c"]["resolution"] == "SKIPPED"


def test_stale_attempts_are_ignored():
    m = machine(RUN, PLAN, started("a", 2), started("a", 1), done("a", n=1))
    assert states(m)["a"] == "RUNNING" and m.tasks["a"]["attempt"] == 2
    m = machine(RUN, PLAN, started("a"), ("TaskStarted", {"task_key": "a", "attempt": 1, "attempt_id": "other"}))
    assert m.tasks["a"]["attempt_id"] == "a1"
    m = machine(RUN, PLAN, started("a"), ("TaskHeartbeat", attempt("a", heartbeat_at=7)), ("TaskHeartbeat", attempt("a", 2, heartbeat_at=9)))
    assert m.tasks["a"]["last_heartbeat_at"] == 7


def test_cancel():
    m = machine(RUN, PLAN, started("a"), ("RunCancelRequested", {}))
    assert states(m) == {"a": "RUNNING", "b": "CANCELLED", "c": "CANCELLED"} and m.run["cancel_requested"] and m.run["state"] == "RUNNING"
    m = machine(RUN, PLAN, ("RunCancelRequested", {}), ("RunCancelRequested", {}))
    assert m.run["state"] == "CANCELLED" and m.run["tasks_completed"] == 3


def test_late_run_counts_tasks():
    m = machine(PLAN, started("a"), done("a"), RUN)
    assert m.run["tasks_total"] == 3 and m.run["tasks_succeeded"] == 1 and m.run["state"] == "RUNNING"
    m = machine(("PlanCreated", {"tasks": [{"key": "a"}]}), started("a"), done("a"), RUN)
    assert m.run["state"] == "SUCCEEDED" and m.run["completed_at"] == 2000


def test_visibility_is_sticky():
    see = lambda s: ("TaskOutputVisibilityChanged", attempt("a", visibility_state=s))
    m = machine(RUN, PLAN, started("a"), see("VISIBLE"), done("a"), see("PENDING"), see("VISIBLE"), see("FAILED"))
    assert m.tasks["a"]["output_visibility_state"] == "VISIBLE" and m.tasks["a"]["published_at"] == 6000
    m = machine(RUN, PLAN, started("a"), ("TaskCompletionRecorded", attempt("a", outcome="SUCCEEDED", visibility={"visibility_state": "FAILED", "publish_error": "x"})))
    assert (m.tasks["a"]["output_visibility_state"], m.tasks["a"]["publish_error"]) == ("FAILED", "x")


def test_dispatch_out_of_order():
    ask = ("DispatchRequested", attempt("a", worker_queue="q"))
    put = ("DispatchEnqueued", {"task_key": "a", "attempt": 1, "cloud_task_id": "ct"})
    for order in ((ask, put), (put, ask)):
        m = machine(RUN, PLAN, *order)
        row = m.outbox["dispatch:r:a:1"]
        assert (row["status"], row["cloud_task_id"], row["attempt_id"], row["worker_queue"]) == ("CREATED", "ct", "a1", "q")
        assert states(m)["a"] == "DISPATCHED"
    assert machine(RUN, PLAN, started("a"), ask).outbox == {} and machine(RUN, PLAN, ask, started("a")).outbox == {}


def test_timers():
    name = "timer:retry:r:b:1:50"
    m = machine(RUN, PLAN, ("TimerFired", {"timer_id": name}), ("TimerRequested", {"timer_id": name, "timer_type": "RETRY", "fire_at": 7}))
    t = m.timers[name]
    assert (t["state"], t["task_key"], t["attempt"], t["fire_at"]) == ("FIRED", "b", 1, 7)
    m = machine(("TimerEnqueued", {"timer_id": name, "cloud_task_id": "x"}), ("TimerFired", {"timer_id": "bad"}))
    assert list(m.timers) == [name] and m.timers[name]["fire_at"] == 50_000 and m.timers[name]["cloud_task_id"] == "x"


def test_idempotency_keys_only_when_applied():
    m = fold.RunMachine("r")
    assert not m.feed("1", "TaskStarted", "k", 0, json.dumps(attempt("a")))
    m.feed("2", *RUN[:1], "run", 0, json.dumps(RUN[1]))
    m.feed("3", *PLAN[:1], "plan", 0, json.dumps(PLAN[1]))
    assert m.feed("4", "TaskStarted", "k", 0, json.dumps(attempt("a")))
    assert not m.feed("5", "TaskStarted", "k", 0, json.dumps(attempt("a")))
    assert not m.feed("6", "Unknown", "z", 0, "{}") and not m.feed("7", "TaskStarted", "y", 0, "[1]") and not m.feed("8", "TaskStarted", "y", 0, None)


def test_sensor_cas():
    e = lambda i, cursor, expected=None: ("SensorEvaluated", {"eval_id": f"e{i}", "cursor_after": cursor, "expected_state_version": expected, "status": "TRIGGERED"})
    m = machine(e(1, "a", 0), e(2, "b", 0), e(3, "c", 1), kind=fold.SensorMachine, key="s")
    assert m.state["cursor"] == "c" and m.state["state_version"] == 2
    assert [m.evals[f"e{i}"]["status"] for i in (1, 2, 3)] == ["TRIGGERED", "SKIPPED_STALE_CURSOR", "TRIGGERED"]


def test_backfill():
    chunk = lambda i: ("BackfillChunkPlanned", {"chunk_id": f"b:{i}", "chunk_index": i, "run_key": f"k{i}"})
    move = lambda a, z, v: ("BackfillStateChanged", {"from_state": a, "to_state": z, "state_version": v})
    m = machine(chunk(1), ("BackfillCreated", {"chunk_size": 2, "total_partitions": 9}), chunk(0), move("RUNNING", "PAUSED", 3), move("RUNNING", "PAUSED", 2), move("PAUSED", "SUCCEEDED", 3), move("PAUSED", "RUNNING", 3), kind=fold.BackfillMachine, key="b")
    assert m.row["planned_chunks"] == 2 and m.row["state"] == "RUNNING" and m.row["state_version"] == 3


def stream(seed=1, n=8):
    r = random.Random(seed)
    rows = []
    for run in range(n):
        body = [RUN, PLAN, started("a"), ("TaskHeartbeat", attempt("a", heartbeat_at=5)), done("a", r.choice(["SUCCEEDED", "FAILED"]), retryable=False, asset_key="x.y", partition_key="p"), started("b"), done("b")]
        rows += [(f"r{run}", f"{run:02d}{i:03d}", name, f"{run}-{i}", 10 * i, json.dumps(b)) for i, (name, b) in enumerate(body)]
    return rows


def folded(spark, rows):
    got = fold.fold_events(spark.createDataFrame(rows, EVENTS), "run_id")
    return sorted(map(tuple, got.collect()))


def test_order_and_duplicates_do_not_matter(spark):
    rows = stream()
    want = folded(spark, rows)
    shuffled = rows * 2
    random.Random(3).shuffle(shuffled)
    assert folded(spark, shuffled) == want
    assert folded(spark, [*rows, (None, "x", "RunTriggered", "k", 0, "{}"), ("r0", None, "RunTriggered", "k", 0, "{}")]) == want


def test_empty_ledger(spark):
    assert folded(spark, []) == []


def test_machine_state_round_trip():
    m = machine(RUN, PLAN, started("a"), done("a"))
    n = fold.RunMachine("r")
    n.load(m.dump())
    assert vars(n) == vars(m)
    n.feed("900", "TaskStarted", "kx", 1, json.dumps(attempt("b")))
    assert states(n)["b"] == "RUNNING"


def test_stream_ends_where_the_batch_does(spark, tmp_path):
    rows = stream(2)
    for k in range(3):  # three files, three micro-batches, ids in order
        part = sorted(rows, key=lambda x: x[1][2:])[k::3] if False else [x for i, x in enumerate(sorted(rows, key=lambda x: x[1][2:])) if i * 3 // len(rows) == k]
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    src = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out: dict = {}

    def keep(df, _):
        for r in df.collect():
            out[r.fold_key, r.entity, r.entity_key] = r.state

    q = fold_stream(src, "run_id").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r[0], r[1], r[2]): r[4] for r in folded(spark, rows)}
    assert out == want


def test_partition_status(spark):
    rows = stream(4)
    got = fold.fold_events(spark.createDataFrame(rows, EVENTS), "run_id")
    f = fold.entity(got, "finish", "asset_key string, partition_key string, outcome string, at long, event_id string, code_version string, execution_lineage_ref string, delta_table string, delta_version long, delta_partition string", "run_id")
    s = fold.partition_status(f).first()
    ok = [r for r in rows if r[2] == "TaskFinished" and '"SUCCEEDED"' in r[5] and "x.y" in r[5]]
    last = [r for r in rows if r[2] == "TaskFinished" and "x.y" in r[5]][-1]
    assert s.last_materialization_run_id == ok[-1][0] and s.last_attempt_run_id == last[0] and s.row_version == last[1]


# -- catalog and metastore


def ev(i, kind, **row):
    return (f"{i:03d}", kind, json.dumps(row))


def test_catalog_fold(spark):
    events = [ev(1, "catalog.created", id="c", name="default"), ev(2, "namespace.created", id="n", name="sales"), ev(3, "table.created", id="t", name="orders", namespace_id="n"), ev(4, "column.created", id="k", name="id", table_id="t"),
              ev(5, "table.renamed", id="t", name="orders2"), ev(6, "edge.created", id="e", source_id="a"), ev(7, "edge.created", id="e", source_id="b")]
    s = fold_catalog(spark.createDataFrame(events[::-1] + events, "event_id string, kind string, payload string"))
    assert s.rows["table"]["t"]["name"] == "orders2" and s.edges["e"]["source_id"] == "a" and s.watermark == "007"
    s.apply("008", "table.deleted", {"id": "t"})
    assert s.rows["column"] == {} and s.rows["table"] == {}
    s.apply("009", "table.deleted", {"id": "t"})
    with pytest.raises(FoldError):
        s.apply("010", "catalog.deleted", {"id": "c"})  # its namespace has a null catalog: default
    with pytest.raises(FoldError):
        s.apply("011", "namespace.created", {"id": "n2", "name": "sales", "catalog_id": "c"})
    with pytest.raises(FoldError):
        s.apply("012", "namespace.created", {"id": "n", "name": "other"})
    s.apply("013", "namespace.created", {"id": "n", "name": "sales"})
    with pytest.raises(FoldError):
        s.apply("014", "namespace.updated", {"id": "n", "catalog_id": "zz"})
    s.apply("001", "nonsense.kind", {})  # before the watermark


def test_metastore(spark):
    cols = "kind string, object_id string, object_type string, name string, owner string, lifecycle_state string, updated_at long, sequence int, position int, deleted boolean, secret string"
    rows = [("securable", "s", "TABLE", "old", "o", "ACTIVE", 1, 1, 0, False, None), ("securable", "s", "TABLE", "new", "o", "ACTIVE", 2, 1, 1, False, None), ("securable", "x", "TABLE", "dead", "o", "DELETED", 1, 1, 2, False, None),
            ("principal", "p", None, "ann", None, "ACTIVE", 1, 1, 3, False, None), ("principal", "p", None, "anna", None, "ACTIVE", 1, 2, 4, False, None), ("credential", "c", None, "cred", None, "ACTIVE", 1, 3, 5, False, "hush"), ("grant", "g", None, None, None, "ACTIVE", 1, 3, 6, True, None)]
    df = spark.createDataFrame(rows, cols)
    state = replay(df).cache()
    assert {r.name for r in object_names(state).collect()} == {"new"}
    assert {r.name: r.object_id for r in principal_names(df).collect()} == {"ann": "p", "anna": "p"}
    shown = safe_objects(state, "w")
    assert "secret" not in shown.columns and [(r.object_type, r.object_id) for r in shown.collect()] == [("CREDENTIAL", "c"), ("PRINCIPAL", "p"), ("TABLE", "s"), ("TABLE", "x")]


# -- malformed payloads and the gate over all machines


def test_malformed_payloads_are_skipped(spark):
    bad = ["{}", '{"tasks":[{}]}', '{"tasks":[{"key":1}]}', '{"tasks":{"key":"a"}}', '{"tasks":[3]}', "[]", "null", "{", '{"attempt":"x","task_key":"a"}', '{"timer_id":7}', '{"visibility":[]}']
    kinds = ["PlanCreated", "DispatchRequested", "TimerRequested", "TimerFired", "TaskStarted", "TaskFinished", "TaskOutputVisibilityChanged"]
    rows = [("r", f"{i:03d}{j:02d}", kind, f"k{i}-{j}", 0, body) for i, kind in enumerate(kinds) for j, body in enumerate(bad)]
    assert folded(spark, rows) == []
    assert fold.fold_events(spark.createDataFrame([("s", "1", "SensorEvaluated", "k", 0, "{}")], EVENTS.replace("run_id", "sensor_id")), "sensor_id").where("entity = 'eval'").count() == 0


def test_idempotency_keys_count_once_over_all_machines(spark):
    run = lambda k: json.dumps({"plan_id": k})
    rows = [
        ("a", "01", "RunTriggered", "k1", 0, run("a")), ("b", "02", "RunTriggered", "k1", 0, run("b")),  # b's is a replay
        ("c", "03", "TaskStarted", "k2", 0, json.dumps(attempt("x"))),  # not applied: its key stays free
        ("d", "04", "RunTriggered", "k2", 0, run("d")),
        # once b's trigger is gone, a later one of b applies and takes k3 from e
        ("b", "05", "RunTriggered", "k3", 0, run("b2")), ("e", "06", "RunTriggered", "k3", 0, run("e")), ("f", "07", "RunTriggered", "k4", 0, run("f")),
    ]
    got = {r[0]: json.loads(r[4])["plan_id"] for r in folded(spark, rows[::-1]) if r[1] == "run"}
    assert got == {"a": "a", "b": "b2", "d": "d", "f": "f"}


def test_stream_emits_only_what_changed(spark, tmp_path):
    events = [("r", "1", "RunTriggered", "a", 0, "{}"), ("r", "2", "PlanCreated", "b", 0, '{"tasks":[{"key":"x"},{"key":"y"}]}'), ("r", "3", "TaskStarted", "c", 0, json.dumps(attempt("x")))]
    for e in (events[:2], events[2:]):
        spark.createDataFrame(e, EVENTS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(1.1)
    src = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = []
    q = fold_stream(src, "run_id").writeStream.outputMode("update").foreachBatch(lambda df, i: out.append(sorted((r.entity, r.entity_key) for r in df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [x for x in out if x] == [[("run", "r"), ("task", "x"), ("task", "y")], [("task", "x")]]


def test_only_the_wanted_entities_and_shared_payloads(spark):
    """Runs with equal payloads keep states of their own; entities not asked for are not given."""
    events = [(r, f"{r}{i}", kind, f"{r}{i}", 1, json.dumps(body)) for r in ("r1", "r2") for i, (kind, body) in enumerate([RUN, PLAN, started("a"), done("a")])]
    df = spark.createDataFrame(events[:-1], EVENTS)
    whole = fold.fold_events(df, "run_id").collect()
    some = fold.fold_events(df, "run_id", only=("run",)).collect()
    assert sorted(some) == sorted(x for x in whole if x.entity == "run") and len(some) == 2
    assert {x.fold_key: json.loads(x.state)["tasks_succeeded"] for x in some} == {"r1": 1, "r2": 0}
