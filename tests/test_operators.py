import random

import pytest
from pyspark.sql import functions as F

from lakelens.operators import aggregates, checks, graph, joins, merge, rules, windows
from lakelens.operators.search import catalog_postings, search


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# -- merges


def test_later_delta_wins_ties_and_ranks(spark):
    layers = spark.createDataFrame(
        [("a", "RUNNING", "1", 0), ("a", "SUCCEEDED", "1", 1), ("a", "READY", "1", 2), ("b", "READY", "2", 0), ("b", "READY", "1", 1), ("c", "READY", "1", 0), ("c", "FAILED", "1", 1)],
        "k string, state string, row_version string, delta_ordinal int",
    )
    got = {r.k: r.state for r in merge.merge_layers(layers, ["k"], "tasks").collect()}
    assert got == {"a": "SUCCEEDED", "b": "READY", "c": "FAILED"}
    plain = {r.k: r.state for r in merge.merge_layers(layers, ["k"]).collect()}
    assert plain["a"] == "READY"


def test_tombstones_and_reinsert(spark):
    layers = spark.createDataFrame([("a", 1, "1", 0), ("a", 2, "2", 3), ("b", 1, "1", 0), ("b", 3, "0", 2)], "k string, v int, row_version string, delta_ordinal int")
    gone = spark.createDataFrame([("a", 2), ("b", 2)], "k string, delta_ordinal int")
    assert rows(merge.merge_layers(layers, ["k"], "", gone)) == [("a", 2, "2")]


def test_sequence_rule(spark):
    data = [("k", "1", None, "i1"), ("k", "2", 5, "i2"), ("k", "3", None, "i3"), ("k", "4", 4, "i4"), ("k", "5", 5, "i5"), ("k", "6", 9, "i5")]
    df = spark.createDataFrame(data, "key string, event_id string, sequence int, idempotency_key string")
    assert merge.upsert_by_sequence(df, "key").first().event_id == "5"


def test_late_policies(spark):
    df = spark.createDataFrame([("1", 50), ("2", 150), ("9", 10)], "event_id string, ts int")
    for policy, n, aside in (("skip", 1, 0), ("log", 1, 1), ("process", 2, 0), ("quarantine", 1, 1)):
        now, late = merge.split_late(df, "5", 100, policy)
        assert (now.count(), late.count()) == (n, aside)
    with pytest.raises(ValueError):
        merge.split_late(df, "5", 100, "other")


def test_invalid_events(spark):
    raw = spark.createDataFrame([('{"event_type":"A"}',), ("{bad",), ('{"x":1}',), ('{"event_type":"Z"}',), (None,)], "payload string")
    good, bad = merge.split_invalid(raw, "event_type string", ["A"])
    assert good.count() == 1
    assert sorted(r.reason for r in bad.collect()) == ["malformed", "malformed", "missing event_type", "unknown event_type"]


def test_append_once(spark):
    old = spark.createDataFrame([("1", "a")], "event_id string, payload string")
    new = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "b"), ("2", "b"), ("3", "c"), ("3", "d")], "event_id string, payload string")
    fresh, bad = merge.append_once(old, new)
    assert rows(fresh) == [("2", "b")] and rows(bad) == [("3", "c"), ("3", "d")]
    assert merge.append_once(old, spark.createDataFrame([("1", "z")], old.schema))[1].count() == 1


def test_watermarks_and_retention(spark):
    assert merge.advance_watermarks({"a": "5", "b": None}, {"a": "3", "c": "1"}) == {"a": "5", "b": None, "c": "1"}
    runs = spark.createDataFrame([("old", "FAILED", "01ARZ3NDEKTSV4RRFFQ69G5FAV"), ("open", "RUNNING", "01ARZ3NDEKTSV4RRFFQ69G5FAV")], "run_id string, state string, row_version string")
    tasks = spark.createDataFrame([("old", "t"), ("open", "t")], "run_id string, task_key string")
    kept, cascade = merge.prune_runs(runs, {"tasks": tasks}, 1_700_000_000_000)
    assert rows(kept.select("run_id")) == [("open",)] and rows(cascade["tasks"]) == [("open", "t")]


def test_missed_pages(spark):
    df = spark.createDataFrame([("a", "5", 1), ("b", "1", 9), ("c", "1", 1), ("d", "7", 1)], "path string, event_id string, modified_at int")
    assert [r.path for r in merge.missed(df, "3", 5).collect()] == ["a", "b", "d"]
    assert [r.path for r in merge.missed(df, "3", 5, cursor="a", page=1).collect()] == ["b"]


# -- graphs


def test_selection_directions(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c"), ("c", "b")], "src string, dst string")
    roots = spark.createDataFrame([("b",)], "node string")
    pick = lambda **k: {r.node for r in graph.selection(edges, roots, **k).collect()}
    assert pick() == {"b"} and pick(downstream=True) == {"b", "c"} and pick(upstream=True) == {"a", "b", "c", "x"}


def test_cyclic_membership(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("u", "a"), (None, "a")], "child string, parent string")
    got = {}
    for r in graph.pairs_closure(e).collect():
        got.setdefault(r.node, set()).add(r.ancestor)
    assert got["u"] == {"u", "a", "b", "c"} and got["a"] == {"a", "b", "c"}


def test_stages(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d")], "src string, dst string")
    assert {r.node: r.stage for r in graph.stage_levels(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 0}
    with pytest.raises(ValueError):
        graph.stage_levels(nodes, edges.union(spark.createDataFrame([("d", "a")], edges.schema)))


def test_rounds_send_nothing_through_the_driver(spark, monkeypatch):
    """No round of a closure, of stages or of a spread broadcasts its edges or frontier."""
    plans, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    nodes = spark.range(1, 8).toDF("node")
    edges = spark.range(2, 8).select(F.floor(F.col("id") / 2).cast("long").alias("src"), F.col("id").alias("dst"))
    assert graph.closure(edges, spark.range(1, 2).toDF("node")).count() == 7
    assert {r.node: r.stage for r in graph.stage_levels(nodes, edges).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2, 7: 2}
    tasks = nodes.withColumn("state", F.lit("BLOCKED"))
    new, _ = graph.propagate_failures(tasks, edges, spark.createDataFrame([(3, "FAILED")], "node long, resolution string"))
    assert {r.node for r in new.where("state = 'SKIPPED'").collect()} == {6, 7}
    assert graph.pairs_closure(edges.toDF("parent", "child")).count() == 17
    assert len(plans) > 15 and not any("Broadcast" in p for p in plans)


def test_failures_stop_at_terminal_tasks(spark):
    tasks = spark.createDataFrame([("a", "FAILED"), ("b", "BLOCKED"), ("c", "SUCCEEDED"), ("d", "BLOCKED"), ("e", "BLOCKED")], "node string, state string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d"), ("b", "e")], "src string, dst string")
    new, marked = graph.propagate_failures(tasks, edges, spark.createDataFrame([("a", "FAILED")], "node string, resolution string"))
    assert {r.node: r.state for r in new.collect()} == {"a": "FAILED", "b": "SKIPPED", "c": "SUCCEEDED", "d": "BLOCKED", "e": "SKIPPED"}
    assert {(r.src, r.dst): r.resolution for r in marked.collect()} == {("a", "b"): "FAILED", ("a", "c"): "FAILED", ("c", "d"): None, ("b", "e"): "SKIPPED"}


def test_topological_order():
    assert graph.topological_order({"c": ["a", "b"], "b": ["a"], "a": []}) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="cycle"):
        graph.topological_order({"a": ["b"], "b": ["a"]})


def test_walk_log(spark):
    logs = spark.createDataFrame([("3", "2"), ("2", "1"), ("1", "3")], "path string, previous string")
    assert [(r.path, r.step) for r in graph.walk_log(logs, "3").orderBy("step").collect()] == [("3", 0), ("2", 1), ("1", 2)]


# -- ordering


def simulate(tenants):
    """Deficit round robin as told: credit is added when no tenant with tasks has any left,
    the highest credit goes first."""
    queue = {t: list(range(n)) for t, (w, n) in tenants.items()}
    credit, out = dict.fromkeys(tenants, 0), []
    while any(queue.values()):
        busy = [t for t in queue if queue[t]]
        if not any(credit[t] > 0 for t in busy):
            for t in busy:
                credit[t] += max(1, tenants[t][0])
        t = max(sorted(busy), key=lambda t: credit[t])
        credit[t] -= 1
        out.append((t, queue[t].pop(0)))
        if not queue[t]:
            credit[t] = 0
    return out


def test_fair_order_matches_simulation(spark):
    r = random.Random(1)
    for _ in range(6):
        tenants = {f"t{i}": (r.randint(0, 4), r.randint(1, 7)) for i in range(r.randint(1, 5))}
        df = spark.createDataFrame([(t, k, w) for t, (w, n) in tenants.items() for k in range(n)], "tenant string, k int, w int")
        got = windows.fair_order(df, "tenant", "w", ["k"]).orderBy("fair_rank").collect()
        assert [(x.tenant, x.k) for x in got] == simulate(tenants)


def test_pages_and_cursors(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(30)], "a int, b int")
    keys, seen, after = [("a", False), ("b", True)], [], None
    while True:
        page = windows.keyset_page(df, keys, after, 7).collect()
        seen += page[:7]
        if len(page) <= 7:
            break
        after = windows.read_cursor(windows.cursor([page[6].a, page[6].b]), [int, int])
    assert [tuple(x) for x in seen] == sorted(((i % 3, i) for i in range(30)), key=lambda x: (-x[0], x[1]))
    assert windows.read_cursor("25", [int]) == 25
    with pytest.raises(ValueError):
        windows.read_cursor("%%%", [int])
    assert windows.page_size(0, 50, 200) == 50
    with pytest.raises(ValueError):
        windows.page_size(201, 50, 200)


def test_catch_up_and_budget(spark):
    df = spark.createDataFrame([("s", i, 2) for i in range(5)], "s string, at int, most int")
    assert rows(windows.earliest(df, "s", "at", "most").select("at")) == [(0,), (1,)]
    big = spark.createDataFrame([(1, 100), (2, 1)], "p int, n int")
    assert [r.too_large for r in windows.budget_page(big, "p", "n", 10).collect()] == [True]


# -- joins and rules


def test_path_authority_and_conflicts(spark):
    places = spark.createDataFrame([("a", "s3://b"), ("b", "s3://b/x"), ("c", "s3://b/x"), ("d", "s3://bb")], "name string, place string")
    paths = spark.createDataFrame([("s3://b/x/y",), ("s3://b/xx",), ("gs://q",)], "path string")
    got = {r.path: (r.place, r.status) for r in joins.path_authority(paths, places).collect()}
    assert got == {"s3://b/x/y": ("s3://b/x", "AMBIGUOUS"), "s3://b/xx": ("s3://b", "FOUND"), "gs://q": (None, "NOT_FOUND")}
    assert rows(joins.path_conflicts(places)) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_permissions(spark):
    objects = spark.createDataFrame([("c", "CATALOG", None, "own"), ("s", "SCHEMA", "c", None), ("t", "TABLE", "s", None)], "object_id string, object_type string, parent_object_id string, owner_principal_id string")
    grants = spark.createDataFrame([("g1", "s", "team", "SELECT", False), ("g2", "t", "gone", "SELECT", False)], "grant_id string, object_id string, principal_id string, privilege string, grant_option boolean")
    members = spark.createDataFrame([("ann", "sub"), ("sub", "team"), ("bob", "team")], "child string, parent string")
    principals = spark.createDataFrame([(p, "DISABLED" if p in ("bob", "gone") else "ACTIVE", "USER") for p in ("own", "ann", "bob", "gone", "team", "sub")], "principal_id string, lifecycle_state string, principal_kind string")
    compiled = joins.compile_permissions(objects, grants, members, principals).cache()
    asked = [("ann", "t", "TABLE", "SELECT"), ("ann", "c", "CATALOG", "SELECT"), ("bob", "t", "TABLE", "SELECT"), ("own", "c", "CATALOG", "CREATE_SCHEMA"), ("ann", "t", "DRAGON", "SELECT")]
    req = spark.createDataFrame(asked, "principal_id string, object_id string, object_type string, privilege string")
    got = {(r.principal_id, r.object_id, r.object_type): r.reason for r in joins.decide(req, compiled).collect()}
    assert got == {("ann", "t", "TABLE"): "allowed", ("ann", "c", "CATALOG"): "absence_of_allow", ("bob", "t", "TABLE"): "absence_of_allow", ("own", "c", "CATALOG"): "allowed", ("ann", "t", "DRAGON"): "unknown_object_type"}
    assert {r.reason for r in joins.decide(req, compiled, fresh=False).collect()} == {"stale_projection"}


def test_hot_group_is_spread(spark, monkeypatch):
    """Every row with every row of a key, over many tasks, and nothing is shuffled after."""
    monkeypatch.setattr(joins, "_SIDE", 8)
    a = spark.createDataFrame([("g" if i else "h", i) for i in range(41)], "k string, a int")
    b = spark.createDataFrame([("g", i) for i in range(37)] + [("h", 1), ("x", 2)], "k string, b int")
    out = joins._each_with_each(a, b, "k")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, a.join(b, "k").collect()))
    tasks = out.where("k = 'g'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 40 * 37 / 2


def test_permissions_multiply_last(spark, monkeypatch):
    """Members stay in arrays up to the last step, in as many even tasks as the rows call
    for; a group that owns manages, its members don't."""
    monkeypatch.setattr(joins, "_SIDE", 8)
    monkeypatch.setattr(joins, "_TASK", 500, raising=False)
    below = [f"t{i}" for i in range(40)]
    users = [f"u{i}" for i in range(100)]
    objects = spark.createDataFrame([("c", "CATALOG", None, "team"), *((t, "TABLE", "c", None) for t in below)], "object_id string, object_type string, parent_object_id string, owner_principal_id string")
    grants = spark.createDataFrame([("g", "c", "team", "SELECT", False)], "grant_id string, object_id string, principal_id string, privilege string, grant_option boolean")
    members = spark.createDataFrame([(u, "team") for u in users], "child string, parent string")
    principals = spark.createDataFrame([(p, "ACTIVE", "USER") for p in ["team", *users]], "principal_id string, lifecycle_state string, principal_kind string")
    out = joins.compile_permissions(objects, grants, members, principals)
    kind = lambda o: "CATALOG" if o == "c" else "TABLE"
    want = [(o, p, "SELECT", "grant", "g", "c", False, kind(o)) for o in ["c", *below] for p in ["team", *users]]
    assert rows(out) == sorted([*want, ("c", "team", "MANAGE", "owner", None, "c", True, "CATALOG")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.find("Generate explode(member") < plan.find("Join")
    tasks = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(tasks) == 8 and max(tasks) < 1.5 * len(want) / 8


def test_live_postings_are_not_sorted(spark):
    found = spark.createDataFrame([("a", str(i)) for i in range(5)] + [("b", "x"), (None, "y")], "doc_id string, token string")
    gone = spark.createDataFrame([("b", 100), ("b", 90), ("a", 10)], "doc_id string, expires_at long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = rules.live_postings(found, gone, 50)
        assert sorted(r.token for r in out.collect()) == ["0", "1", "2", "3", "4", "y"]
        assert "Sort" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_month_windows(spark):
    d = spark.createDataFrame([("2024-03-01",)], "key string")
    u = spark.createDataFrame([("2024-01-01",), ("2024-02-01",), ("2024-03-01",), ("2024-04-01",)], "key string")
    assert rows(joins.map_partitions(d, u, "window", -1, 0, "month")) == [("2024-03-01", "2024-02-01"), ("2024-03-01", "2024-03-01")]
    with pytest.raises(ValueError):
        joins.map_partitions(d, u, "other")


TASK = "run_id string, task_key string, state string, attempt int, attempt_id string, max_attempts int, ready_at long, retry_not_before long, last_heartbeat_at long, started_at long, heartbeat_timeout_sec int"


def test_anti_entropy_guards(spark):
    now = 10_000_000
    tasks = spark.createDataFrame([("r", "ready", "READY", 0, None, 3, 1, None, None, None, 60), ("r", "dead", "RUNNING", 1, "a", 3, None, None, 1, None, 60), ("r", "lost", "DISPATCHED", 1, "a", 3, None, None, None, None, 60)], TASK)
    outbox = spark.createDataFrame([], "run_id string, task_key string, attempt int, status string, created_at long")
    fix = lambda **k: {r.task_key: r.repair for r in rules.anti_entropy(tasks, outbox, now, **k).collect()}
    assert fix() == {"ready": "CREATE_DISPATCH_OUTBOX", "dead": "FAIL_STALE_RUNNING_TASK", "lost": "CREATE_DISPATCH_OUTBOX"}
    assert fix(lag_ms=60_000) == {"ready": "SKIPPED_DUE_TO_LAG", "dead": "SKIPPED_DUE_TO_LAG"}
    assert fix(lag_ms=60_000, ledger="CURRENT") == {"ready": "CREATE_DISPATCH_OUTBOX", "dead": "SKIPPED_DUE_TO_LAG", "lost": "CREATE_DISPATCH_OUTBOX"}
    assert fix(ledger="STALE")["dead"] == "SKIPPED_DUE_TO_LAG"


def test_outboxes_and_lag(spark):
    o = spark.createDataFrame([("d1", "PENDING"), ("d2", "CREATED")], "dispatch_id string, status string")
    assert {r.dispatch_id: r.action for r in rules.dispatcher(o).collect()} == {"d1": "CREATE", "d2": "SKIP"}
    assert [(r.dispatch_id, r.reason) for r in rules.dispatcher(o, lag_ms=10**6).collect()] == [("d1", "compaction_lag")]
    t = spark.createDataFrame([("a", "SCHEDULED", None), ("b", "SCHEDULED", "x"), ("c", "FIRED", None), ("d", "CANCELLED", None)], "timer_id string, state string, cloud_task_id string")
    assert {r.timer_id: r.reason for r in rules.timer_outbox(t).collect()} == {"a": None, "b": "already_has_cloud_task_id", "c": "already_fired", "d": "cancelled"}


def test_backfill_transitions(spark):
    df = spark.createDataFrame([("RUNNING", 1, "pause", 1), ("RUNNING", 1, "pause", 2), ("PAUSED", 1, "resume", None), ("FAILED", 1, "cancel", None)], "s string, v int, a string, e int")
    got = [r.x for r in df.select(rules.backfill_transition("s", "v", "a", "e").alias("x")).collect()]
    assert [(x.accepted, x.new_state, x.reason) for x in got] == [(True, "PAUSED", None), (False, None, "version_conflict"), (True, "RUNNING", None), (False, None, "invalid_transition")]


def test_reruns_and_retries(spark):
    tasks = spark.createDataFrame([("a", "SUCCEEDED"), ("b", "FAILED"), ("c", "SKIPPED")], "task_key string, state string")
    assert rows(rules.rerun_selection(tasks, "FROM_FAILURE", "FAILED")) == [("b",), ("c",)]
    assert rows(rules.rerun_selection(tasks, "SUBSET", "SUCCEEDED", ["a"])) == [("a",)]
    for bad in (("FROM_FAILURE", "SUCCEEDED", None), ("SUBSET", "FAILED", ["zz"]), ("SUBSET", "FAILED", [])):
        with pytest.raises(ValueError):
            rules.rerun_selection(tasks, *bad)
    b = spark.createDataFrame([("p", "FAILED"), ("q", "RUNNING")], "backfill_id string, state string")
    c = spark.createDataFrame([("p", "FAILED", '["2","1"]'), ("p", "FAILED", '["2"]'), ("p", "SUCCEEDED", '["9"]'), ("q", "FAILED", '["7"]')], "backfill_id string, state string, partition_keys string")
    assert rows(rules.retry_failed_keys(b, c)) == [("p", ["1", "2"])]


def test_collection_of_garbage(spark):
    t = spark.createDataFrame([("t", "m5", "m4", None, "m3")], "table_id string, current string, stable string, pending string, previous string")
    log = spark.createDataFrame([("t", "m2", 2), ("t", "m1", 1)], "table_id string, path string, timestamp int")
    kept = rules.metadata_allowlist(t, log, 1)
    assert {r.path for r in kept.collect()} == {"m5", "m4", "m3", "m2"}
    files = spark.createDataFrame([("a.metadata.json",), ("m2",), ("b.txt",)], "path string")
    assert rows(rules.orphan_metadata(files, kept)) == [("a.metadata.json",)]
    ledger = spark.createDataFrame([("1", 0), ("9", 0), ("2", 10**9)], "event_id string, modified_at long")
    assert rows(rules.ledger_garbage(ledger, "5", 10**9)) == [("1", 0)]


def test_search(spark):
    ns = spark.createDataFrame([("n1", "sales_eu", "European sales")], "id string, name string, description string")
    none = spark.createDataFrame([], "id string, name string, description string")
    t = spark.createDataFrame([("t1", "orders", None), ("t2", "sales", "sales sales")], "id string, name string, description string")
    found = catalog_postings(ns, t, none)
    assert [(r.doc_id, r.score) for r in search(found, ["SALES"]).collect()] == [("t2", 2.0), ("n1", 0.5)]
    gone = spark.createDataFrame([("t2", 100)], "doc_id string, expires_at long")
    assert {r.doc_id for r in search(rules.live_postings(found, gone, 50), ["sales"]).collect()} == {"n1"}
    assert search(rules.live_postings(found, gone, 100), ["sales"]).count() == 2


def test_small_aggregates(spark):
    v = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    assert v.agg(aggregates.nearest_rank("v").alias("x")).first().x == 94.0
    assert v.where("v < 0").agg(aggregates.nearest_rank("v").alias("x")).first().x is None
    files = spark.createDataFrame([(1, 5), (1, 9), (2, 3)], "version int, modified_at int")
    assert rows(aggregates.newest_by_version(files)) == [(1, 9), (2, 3)]
    one = spark.createDataFrame([(["b", "a", "b"],)], "x array<string>")
    assert one.select(aggregates.sorted_set("x").alias("x")).first().x == ["a", "b"]


def test_sensors_and_requests(spark):
    s = spark.createDataFrame([("a", "ACTIVE", None), ("b", "PAUSED", None), ("c", "ACTIVE", 99_000)], "sensor_id string, status string, last_evaluation_at long")
    assert rows(rules.due_sensors(s, 100_000, 30).select("sensor_id")) == [("a",)]


def test_checks_edge_cases(spark):
    df = spark.createDataFrame([], "a int, t timestamp")
    todo = [checks.RowCount("r", minimum=1), checks.RowCount("ratio", min_ratio=0.5), checks.NotNull("n", columns=("a",)), checks.Unique("u", columns=("a",)), checks.Freshness("f", column="t", max_age_hours=1), checks.RowCount("pre", phase="pre")]
    got = {r.name: r.passed for r in checks.run_checks(df, todo, previous_rows=10, now="2024-01-01", phase="post").collect()}
    assert got == {"r": False, "ratio": False, "n": True, "u": True, "f": False}
    assert checks.run_checks(df, []).count() == 0


@pytest.mark.parametrize("kind", ["long", "date", "string"])
def test_latest_mapping_over_stretches(spark, kind):
    import datetime
    import random

    r = random.Random(1)
    make = {
        "long": lambda: r.randint(-20000, 20000),
        "date": lambda: datetime.date(2020, 1, 1) + datetime.timedelta(r.randint(0, 900)),
        "string": lambda: "".join(r.choice("abc") for _ in range(r.randint(0, 10))),
    }[kind]
    down, up = [make() for _ in range(60)], [make() for _ in range(30)]
    df = lambda keys: spark.createDataFrame([(x,) for x in keys], f"key {kind}")
    got = {tuple(x) for x in joins.map_partitions(df(down), df(up), "latest").collect()}
    assert got == {(x, max(y for y in up if y <= x)) for x in down if any(y <= x for y in up)}
