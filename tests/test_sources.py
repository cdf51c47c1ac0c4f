import json
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens import assets
from lakelens.operators.checks import RowCount
from lakelens.plans.sqlgate import QueryError
from lakelens.sources import catalog, ledger, schemas, tableformats
from lakelens.sources.snapshots import Conflict, VersionedTable, write_by_tenant
from lakelens.streaming import folds, windows


def test_schemas():
    assert schemas.schema("orchestration.runs")["run_id"].nullable is False
    assert schemas.primary_key("orchestration.tasks") == ("run_id", "task_key") and schemas.primary_key("catalog.tables") == ("id",)
    old = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType(), False)])
    assert schemas.check_evolution(old, T.StructType([*old.fields, T.StructField("c", T.StringType())])) == []
    worse = T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("n", T.LongType(), False)])
    assert len(schemas.check_evolution(old, worse)) == 3  # changed, removed, added


def test_system_views(spark):
    commits = spark.createDataFrame([], schemas.schema("catalog.commits"))
    assert not {"manifest_id", "event_witnesses_json"} & set(catalog.system_view(commits, "catalog.commits").columns)
    with pytest.raises(schemas.SchemaMismatch):
        catalog.system_view(commits.drop("operation"), "catalog.commits")
    with pytest.raises(schemas.SchemaMismatch):
        catalog.system_view(spark.createDataFrame([], schemas.schema("catalog.snapshots")).withColumn("x", F.lit(1)), "catalog.snapshots")
    with pytest.raises(QueryError):
        catalog.system_view(commits, "orchestration.idempotency_keys")


def test_metadata_surface(spark):
    index = spark.createDataFrame([], schemas.schema("orchestration.catalog_run_index"))
    row = {f.name: {"string": "x", "bigint": 1, "boolean": False}[f.dataType.simpleString()] for f in index.schema}
    index = spark.createDataFrame([tuple((row | {"org_id": o})[f.name] for f in index.schema) for o in ("mine", "other")], index.schema)
    tables = {"orchestration.catalog_run_index": index, "lineage.edges": spark.createDataFrame([], schemas.schema("lineage.edges")), "catalog.commits": spark.createDataFrame([], schemas.schema("catalog.commits"))}
    surface = catalog.metadata_surface(tables, "mine", "x")
    assert surface.bind(spark, "select count(*) as n from system.orchestration.catalog_run_index").first().n == 1
    assert surface.bind(spark, "select count(*) as n from lineage.lineage_edges").first().n == 0
    with pytest.raises(QueryError):
        surface.bind(spark, "select manifest_id from system.catalog.commits")


def test_catalog_resolution(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "d" / "o.parquet"))
    c = spark.createDataFrame([("c1", "default"), ("c2", "other")], "id string, name string")
    ns = spark.createDataFrame([("n1", None, "sales", 2), ("n0", None, "sales", 1), ("n2", "c2", "sales", 1)], "id string, catalog_id string, name string, created_at long")
    loc = [("t1", "n0", "orders", "d/o.parquet", None), ("t2", "n0", "delta", "d/o.parquet", "DELTA"), ("t3", "n0", "far", "s3://x/o.parquet", None), ("t4", "n0", "theirs", "tenant=b/workspace=w/o.parquet", None), ("t5", "n1", "hidden", "d/o.parquet", None), ("t6", "n0", "up", "../o.parquet", None)]
    t = spark.createDataFrame(loc, "id string, namespace_id string, name string, location string, format string")
    cols = spark.createDataFrame([("t1", "b", 2), ("t1", "a", 1)], "table_id string, name string, ordinal int")
    cat = catalog.Catalog.of(spark, str(tmp_path), c, ns, t, cols, "a", "w")
    assert cat.surface().bind(spark, "select count(*) as n from default.sales.orders").first().n == 5
    assert cat.model.where("table_id = 't1'").first().columns == ["a", "b"]
    for bad in ("delta", "far", "theirs", "hidden", "up", "none"):
        with pytest.raises(QueryError):
            cat.surface().bind(spark, f"select * from default.sales.{bad}")


SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType()), T.StructField("row_version", T.StringType())])


def table(spark, tmp_path, name="t"):
    return VersionedTable(spark, f"file://{tmp_path}/{name}", SCHEMA, ("k",))


def rows(df):
    return sorted((r.k, r.v) for r in df.collect())


def test_versioned_table(spark, tmp_path):
    t = table(spark, tmp_path)
    df = lambda *r: spark.createDataFrame(r, SCHEMA)
    assert rows(t.read()) == []
    assert t.publish_base(df(("a", 1, "1"), ("b", 1, "1")), {"m": "5"}) == 1
    t.publish_delta(df(("a", 2, "2"), ("c", 1, "1")), df(("b", 0, "")), {"m": "3"})
    assert rows(t.read()) == [("a", 2), ("c", 1)] and rows(t.read(1)) == [("a", 1), ("b", 1)]
    assert t.manifest()["watermarks"] == {"m": "5"}
    t.publish_delta(df(("b", 9, "0")))
    assert rows(t.read()) == [("a", 2), ("b", 9), ("c", 1)]
    t.compact()
    assert rows(t.read()) == [("a", 2), ("b", 9), ("c", 1)] and t.manifest()["deltas"] == [] and t.row_count() == 3
    df(("z", 1, "1")).write.parquet(f"{t.folder}/v00000009/stray")
    assert rows(t.read()) == [("a", 2), ("b", 9), ("c", 1)] and t.unreferenced() == ["v00000009/stray"]


def test_publishing_conflicts(spark, tmp_path):
    a, b = table(spark, tmp_path), table(spark, tmp_path)
    a.publish_base(spark.createDataFrame([("a", 1, "1")], SCHEMA))
    b.version = lambda: 0
    with pytest.raises(Conflict):
        b.publish_base(spark.createDataFrame([("b", 1, "1")], SCHEMA))
    assert rows(a.read()) == [("a", 1)]


def test_concurrent_deltas_all_arrive(spark, tmp_path):
    t = table(spark, tmp_path)
    t.publish_base(spark.createDataFrame([("a", 0, "0")], SCHEMA))
    first = threading.Barrier(3)

    def one(k):
        own = table(spark, tmp_path)
        create = own.files.create

        def together(name, text):  # all three try for version 2 at once
            if name == "manifests/2.json":
                first.wait(60)
            return create(name, text)

        own.files.create = together
        return own.publish_delta(spark.createDataFrame([(f"k{k}", k, "1")], SCHEMA))

    with ThreadPoolExecutor(3) as pool:
        assert sorted(pool.map(one, range(3))) == [2, 3, 4]
    assert rows(t.read()) == [("a", 0), ("k0", 0), ("k1", 1), ("k2", 2)]
    counts = t.inventory()
    assert sorted(counts.values()) == [1, 1, 1, 1] and set(counts) == {t.manifest()["base"], *(d["upserts"] for d in t.manifest()["deltas"])}


def test_a_crash_between_steps_leaves_a_readable_table(spark, tmp_path):
    t = table(spark, tmp_path)
    t.publish_base(spark.createDataFrame([("a", 1, "1")], SCHEMA))
    replace = t.files.replace
    t.files.replace = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        t.publish_delta(spark.createDataFrame([("b", 2, "1")], SCHEMA))
    t.files.replace = replace
    assert t.version() == 2 and rows(t.read()) == [("a", 1), ("b", 2)]
    t.files.delete("current.json")
    assert rows(t.read()) == [("a", 1), ("b", 2)] and t.publish_delta(None, spark.createDataFrame([("b", 0, "")], SCHEMA)) == 3
    assert t.row_count() == 1


def test_future_manifests_fail(spark, tmp_path):
    t = table(spark, tmp_path)
    t.publish_base(spark.createDataFrame([("a", 1, "1")], SCHEMA))
    m = t.manifest() | {"schema_version": 2}
    t.files.replace("manifests/1.json", json.dumps(m))
    with pytest.raises(ValueError):
        t.read()


def test_tenant_folders(spark, tmp_path):
    df = spark.createDataFrame([(o, "w", "r", "t") for o in "ab"], "org_id string, workspace_id string, run_id string, task_key string")
    write_by_tenant(df, str(tmp_path / "x"))
    assert (tmp_path / "x" / "org_id=a").exists()


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    make = lambda *ids: spark.createDataFrame([(i, "T", 1, i, "now", "s", "t", 1, p) for i, p in ids], ledger.EVENT)
    assert ledger.append_events(make(("1", "a"), ("2", "b")), path) == 2
    assert ledger.append_events(make(("2", "b"), ("3", "c")), path) == 1
    with pytest.raises(ValueError):
        ledger.append_events(make(("3", "other")), path)
    got = ledger.read_events(spark, path)
    assert got.count() == 3 and got.first().path.startswith("file:")


def test_bundles(spark, tmp_path):
    cols = "bundle_id string, tenant_id string, workspace_id string, run_id string, task_key string, attempt_id string, producer_id string, event_id string, producer_seq long, bundle_event_count int, bundle_min_producer_seq long, bundle_max_producer_seq long"
    good = [("b", "t", "w", "r", "k", "a", "p", str(i), i, 2, 0, 1) for i in range(2)]
    bad = [("c", "t", "w", "r", "k", "a", "p", "1", 1, 3, 1, 1), ("c", "t", "w", "r2", "k", "a", "p", "1", 1, 3, 1, 1)]
    assert ledger.bundle_problems(spark.createDataFrame(good, cols)).count() == 0
    got = {r.problem for r in ledger.bundle_problems(spark.createDataFrame(bad, cols)).collect()}
    assert got == {"several values of run_id", "repeated event_id", "repeated producer_seq", "wrong event count"}
    ledger.write_bundle(spark.createDataFrame(good, cols), str(tmp_path / "b"))
    with pytest.raises(ValueError):
        ledger.write_bundle(spark.createDataFrame(bad, cols), str(tmp_path / "b"))


def test_bundle_problems_expand_no_rows(spark):
    """Missing ids count as repeated, missing keys as no value; rows aren't multiplied."""
    cols = "bundle_id string, tenant_id string, workspace_id string, run_id string, task_key string, attempt_id string, producer_id string, event_id string, producer_seq long, bundle_event_count int, bundle_min_producer_seq long, bundle_max_producer_seq long"
    rows = [("b", "t", None, "r", "k", "a", "p", None, 0, 2, 0, 1), ("b", "t", "w", "r", "k", "a", "p", "1", 1, 2, 0, 1)]
    rows += [("c", "t", "w", "r", "k", "a", "p", str(i), None if i else 0, 2, 0, 0) for i in range(2)]
    got = ledger.bundle_problems(spark.createDataFrame(rows, cols))
    assert sorted(map(tuple, got.collect())) == [("b", "repeated event_id"), ("c", "repeated producer_seq")]
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()


def test_delta_log(spark, tmp_path):
    log = tableformats.DeltaLog(spark, f"file://{tmp_path}/d")
    add = lambda p: [{"add": {"path": p}}]
    assert log.commit("c1", add("a")) == 0 and log.commit("c1", add("a")) == 0
    with pytest.raises(tableformats.CommitConflict):
        log.commit("c1", add("b"))
    with pytest.raises(tableformats.CommitConflict):
        log.commit("c2", add("b"), read_version=5)
    assert log.commit("c3", [*add("b"), {"remove": {"path": "a"}}], read_version=0) == 1
    assert {r.path for r in log.active(spark).collect()} == {"b"}
    # a commit that stopped after its reservation is finished by the next
    body = log._body(add("z"))
    import hashlib

    log.files.create("_coordinator/lost.json", json.dumps({"version": 2, "digest": hashlib.sha256(body.encode()).hexdigest(), "state": "inflight", "body": body}))
    assert log.commit("c4", add("y")) == 3 and {r.path for r in log.active(spark).collect()} == {"b", "z", "y"}


def test_iceberg(spark, tmp_path):
    t = tableformats.IcebergTable(spark, f"file://{tmp_path}/i")
    schema = {"schema-id": 0, "fields": [{"id": 1, "name": "a", "required": True, "type": "long"}, {"id": 2, "name": "s", "type": {"type": "struct", "fields": [{"id": 3, "name": "x", "type": "string"}]}}], "identifier-field-ids": [1]}
    up = [{"action": "assign-uuid", "uuid": "00000000-0000-0000-0000-000000000001"}, {"action": "add-schema", "schema": schema}, {"action": "set-current-schema", "schema-id": -1}, {"action": "set-properties", "updates": {"k": "v"}}]
    m = t.commit([{"type": "assert-create"}], up, 1)
    assert m["current-schema-id"] == 0 and m["last-column-id"] == 3
    with pytest.raises(tableformats.RequirementFailed):
        t.commit([{"type": "assert-create"}], [], 2)
    snap = {"snapshot-id": 7, "sequence-number": 1}
    m = t.commit([{"type": "assert-table-uuid", "uuid": "00000000-0000-0000-0000-000000000001"}, {"type": "assert-ref-snapshot-id", "ref": "main", "snapshot-id": None}],
                 [{"action": "add-snapshot", "snapshot": snap}, {"action": "set-snapshot-ref", "ref-name": "main", "snapshot-id": 7, "type": "branch"}], 3)
    assert m["current-snapshot-id"] == 7 and m["snapshot-log"] == [{"snapshot-id": 7, "timestamp-ms": 3}] and len(m["metadata-log"]) == 1
    m = t.commit([], [{"action": "remove-snapshots", "snapshot-ids": [7]}], 4)
    assert m["refs"] == {} and m["current-snapshot-id"] is None and m["snapshot-log"] == []
    for bad in ({"action": "upgrade-format-version", "format-version": 1}, {"action": "set-location", "location": "x"}, {"action": "set-current-schema", "schema-id": 9}, {"action": "add-schema", "schema": schema}, {"action": "set-snapshot-ref", "ref-name": "b", "snapshot-id": 1}, {"action": "nonsense"}):
        with pytest.raises(ValueError):
            t.commit([], [bad], 5)
    got = tableformats.project_schema(spark, m["table-uuid"], schema, nested=True).orderBy("ordinal").collect()
    assert [(r.name, r.data_type, r.is_nullable, r.is_identifier) for r in got] == [("a", "int64", False, True), ("s", "struct<x:string>", True, False), ("s.x", "string", True, False)]
    assert got[0].column_id[14] == "4" and len({r.column_id for r in got}) == 3
    assert tableformats.spark_type({"type": "map", "key": "string", "value": {"type": "list", "element": "decimal(9,2)"}}).simpleString() == "map<string,array<decimal(9,2)>>"
    assert tableformats.type_text({"type": "list", "element": {"type": "map", "key": "int", "value": "double"}}) == "list<map<int32, float64>>"


def test_assets(spark):
    reg = assets.Registry()

    @assets.asset("raw.events", registry=reg)
    def raw(ctx):
        """Everything."""
        return ctx.spark.range(10)

    @assets.asset("mart/daily", checks=[RowCount("some", minimum=1)], registry=reg)
    def daily(ctx, events: assets.AssetIn["raw.events"]):
        ctx.metric("x", 1)
        ctx.progress(0.5)
        return ctx.output(events.where("id % 2 = 0"))

    @assets.asset("mart.empty", checks=[RowCount("some", minimum=1)], retries=1, registry=reg)
    def empty(ctx, daily: assets.AssetIn["mart.daily"]):
        return daily.limit(0)

    @assets.asset("mart.after", registry=reg)
    def after(ctx, e: assets.AssetIn["mart.empty"]):
        return e

    assert reg.order(["mart.daily"]) == ["raw.events", "mart.daily"]
    got = reg.run(spark)
    assert {k: r.state for k, r in got.items()} == {"raw.events": "SUCCEEDED", "mart.daily": "SUCCEEDED", "mart.empty": "FAILED", "mart.after": "SKIPPED"}
    assert got["mart.empty"].attempt == 2 and got["mart.daily"].df.count() == 5 and got["mart.daily"].metrics["output"].get["row_count"] == 5
    plan = reg.plan(["mart.daily", "mart.after"], ["date=d:2024-01-01"])
    assert [(t["key"], t["depends_on"]) for t in plan["tasks"]] == [("mart.after", []), ("mart.daily", [])] or plan["tasks"][0]["partition_key"]
    assert reg.plan([])["tasks"][0]["key"] == "materialize" and len(plan["fingerprint"]) == 64
    assert len(reg.manifest()["mart.daily"]["code_version"]) == 16
    with pytest.raises(ValueError):
        assets.asset("raw.events", registry=reg)(lambda ctx: None)
    with pytest.raises(ValueError):
        reg.order(["no.such"])
    seen = assets.sensor_poll(lambda c: ([{"run_key": "k"}], "c2"), {"cursor": "c1", "state_version": 4})
    assert (seen["status"], seen["expected_state_version"], seen["cursor_after"]) == ("TRIGGERED", 4, "c2")
    assert assets.sensor_poll(lambda c: 1 / 0, {})["status"].startswith("ERROR")


def test_streaming_publication(spark, tmp_path):
    t = table(spark, tmp_path, "pub")
    for i in range(4):
        spark.createDataFrame([(f"k{i % 2}", i, str(i))], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = folds.publish_stream(src, t, lambda df: df, str(tmp_path / "cp"), "q", compact_at=3).start()
    q.processAllAvailable()
    q.stop()
    got = rows(t.read())
    assert [k for k, _ in got] == ["k0", "k1"] and {v for _, v in got} == {2, 3}
    assert len(t.manifest()["deltas"]) < 3
    before = t.manifest()["version"]
    q = folds.publish_stream(src, t, lambda df: df, str(tmp_path / "cp"), "q", compact_at=3).start()
    q.processAllAvailable()
    q.stop()
    assert t.manifest()["version"] == before


def test_notifications(spark, tmp_path):
    rows = [("a", k) for k in range(7)] + [("b", 2), ("zz", 3)]
    spark.createDataFrame(rows, "domain string, n int").coalesce(1).write.parquet(str(tmp_path / "n"))
    src = spark.readStream.schema("domain string, n int").parquet(str(tmp_path / "n"))
    got = []
    q = folds.notify_stream(src, ["a", "b"], lambda d, df: got.append((d, sorted(r.n for r in df.collect()))), str(tmp_path / "c"), seconds=2, most=5).start()
    end = time.time() + 40
    while sum(len(x) for _, x in got) < 8 and time.time() < end:
        time.sleep(0.2)
    q.stop()
    # five at once by their number, the rest when their time was up
    assert len(got) >= 3 and sorted(n for d, x in got for n in x if d == "a") == list(range(7)) and ("b", [2]) in got


def test_streaming_windows(spark, tmp_path):
    df = spark.createDataFrame([("u", "2024-01-01 00:05:00"), ("u", "2024-01-01 00:20:00"), ("u", "2024-01-01 03:00:00"), ("u", "2024-01-02 00:00:00")], "user string, t string").selectExpr("user", "cast(t as timestamp) as ts")
    df.coalesce(1).write.parquet(str(tmp_path / "w"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "w"))
    q = windows.tumbling(src, "ts", "1 hour", ["user"], F.count("*").alias("n"), late="10 minutes").writeStream.outputMode("append").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("select n from win").collect()) == [1, 2]
