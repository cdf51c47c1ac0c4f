"""Queries over sources, gates, ids, rules and lists, each with the SQL it must equal."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.functions import encoded
from lakelens.functions import scalars as S
from lakelens.operators import aggregates, fold, graph, joins, listing, merge, metastore, rules, windows
from lakelens.plans import sqlgate
from lakelens.queries import query, read, same_sql
from lakelens.sources import catalog, ledger, schemas
from lakelens.sources.snapshots import VersionedTable, write_by_tenant
from lakelens.sources.tableformats import DeltaLog


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    place = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="surface-")
    return f"{place.rstrip('/')}/surface-{uuid.uuid4().hex}"


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _shaped(df: DataFrame, schema: T.StructType, **values: Column) -> DataFrame:
    """``df`` in a schema's columns: those given, the others null."""
    return df.select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


# -- query surfaces ---------------------------------------------------------------------


@query("SELECT p_brand AS brand, count(*) AS tables FROM part GROUP BY p_brand")
def gate_snapshot_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _shaped(read(spark, sf_dir, "part"), schemas.schema("catalog.tables"), id=F.col("p_partkey"), namespace_id=F.col("p_brand"), name=F.col("p_name"))
    surface = catalog.metadata_surface({"catalog.tables": tables}, "t", "w")
    return surface.bind(spark, "WITH catalogs AS (SELECT * FROM Catalog.tables) SELECT namespace_id AS brand, count(*) AS tables FROM catalogs GROUP BY namespace_id")


@query("SELECT 'r' || CAST(o_orderkey AS VARCHAR) AS run_id, o_orderstatus AS run_status FROM orders WHERE o_custkey % 3 = 1 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 10000")
def gate_system_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run index shows the caller's workspace alone, and its safe columns."""
    orders = read(spark, sf_dir, "orders")
    index = _shaped(
        orders, schemas.schema("orchestration.catalog_run_index"), org_id=F.lit("o"), workspace_id=(F.col("o_custkey") % 3).cast("string"),
        run_id=F.concat(F.lit("r"), _text("o_orderkey")), run_status=F.col("o_orderstatus"), updated_at=F.col("o_orderkey"),
    )
    surface = catalog.metadata_surface({"orchestration.catalog_run_index": index}, "o", "1")
    return surface.bind(spark, "SELECT run_id, run_status FROM system.orchestration.catalog_run_index WHERE run_status = 'F' ORDER BY updated_at")


@query("SELECT c_mktsegment AS segment, count(*) AS n, 'default.sales.orders' AS source FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment")
def gate_user_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface = sqlgate.UserData(lambda c, s, t: (read(spark, sf_dir, t), 1) if (c, s) == ("default", "sales") else None)
    return surface.bind(
        spark,
        """SELECT customer.c_mktsegment AS segment, count(*) AS n, 'default.sales.orders' AS source FROM default.sales.orders AS o
        JOIN default.sales.customer ON default.sales.customer.c_custkey = o.o_custkey GROUP BY c_mktsegment""",
    )


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 10000")
def gate_row_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface = sqlgate.UserData(lambda c, s, t: (read(spark, sf_dir, t), 1))
    return surface.bind(spark, "SELECT l_orderkey, l_linenumber FROM a.b.lineitem ORDER BY l_orderkey, l_linenumber")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def result_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow as pa

    body = sqlgate.collect(read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), sqlgate.wanted_format(None, "*/*"))
    return spark.createDataFrame(pa.ipc.open_stream(body).read_all())


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = sqlgate.collect(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), sqlgate.wanted_format("json", "application/vnd.apache.arrow.stream"))
    return spark.createDataFrame(json.loads(body), "n_nationkey long, n_name string")


# -- sources ----------------------------------------------------------------------------

_CUSTOMER = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("balance", T.DoubleType()), T.StructField("row_version", T.StringType())])


def _customers(spark: SparkSession, sf_dir: str) -> VersionedTable:
    """A base of all customers, a delta that moves odd ones, a delta without every seventh."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("balance"))
    table = VersionedTable(spark, _folder(spark), _CUSTOMER, ("c_custkey",))
    table.publish_base(rows.withColumn("row_version", F.lit("1")))
    moved = rows.where("c_custkey % 2 = 1").withColumn("balance", F.col("balance") + 1)
    table.publish_delta(moved.withColumn("row_version", F.lit("2")), None, {"processed": "5"})
    table.publish_delta(None, rows.where("c_custkey % 7 = 0"))
    return table


@query("SELECT c_custkey, CAST(c_acctbal AS DOUBLE) + CASE WHEN c_custkey % 2 = 1 THEN 1 ELSE 0 END AS balance FROM customer WHERE c_custkey % 7 <> 0")
def versioned_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).read().select("c_custkey", "balance")


@query("SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS balance FROM customer")
def versioned_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).read(1).select("c_custkey", "balance")


@query(
    """SELECT 'base' AS part, count(*) AS row_count FROM customer UNION ALL SELECT 'upserts', count(*) FROM customer WHERE c_custkey % 2 = 1
UNION ALL SELECT 'deletes', count(*) FROM customer WHERE c_custkey % 7 = 0"""
)
def versioned_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _customers(spark, sf_dir).inventory()
    return spark.createDataFrame([(p.split("/")[1].split("-")[0], n) for p, n in counts.items()], "part string, row_count long")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS org_id, count(*) AS n FROM customer GROUP BY 1")
def tenant_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    rows = read(spark, sf_dir, "customer").select(
        _text("c_nationkey").alias("org_id"), F.col("c_mktsegment").alias("workspace_id"), _text("c_custkey").alias("run_id"), F.col("c_name").alias("task_key")
    )
    write_by_tenant(rows, path)
    return spark.read.schema(rows.schema).parquet(path).groupBy("org_id").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def ledger_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended twice are there once."""
    path, e = _folder(spark), read(spark, sf_dir, "events")
    schema = spark.createDataFrame([], ledger.EVENT).schema
    rows = _shaped(e, schema, event_id=_text("event_id"), event_type=F.col("event_type"), payload=F.to_json(F.struct("user_id")))
    ledger.append_events(rows, path)
    ledger.append_events(rows, path)
    return ledger.read_events(spark, path).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    """SELECT l_orderkey AS bundle_id, 'wrong event count' AS problem FROM lineitem GROUP BY 1 HAVING count(*) <> 4
UNION ALL SELECT l_orderkey, 'wrong sequence bounds' FROM lineitem GROUP BY 1 HAVING max(l_linenumber) <> 4 OR min(l_linenumber) <> 1
UNION ALL SELECT l_orderkey, 'repeated producer_seq' FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) < count(*)
UNION ALL SELECT l_orderkey, 'several values of run_id' FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1"""
)
def bundle_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = {c: F.lit("x").alias(c) for c in ledger.BUNDLE_KEY}
    one["run_id"] = F.col("l_returnflag").alias("run_id")
    bundle = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("bundle_id"), *one.values(), F.expr("uuid()").alias("event_id"), F.col("l_linenumber").alias("producer_seq"),
        F.lit(4).alias("bundle_event_count"), F.lit(1).alias("bundle_min_producer_seq"), F.lit(4).alias("bundle_max_producer_seq"),
    )
    return ledger.bundle_problems(bundle)


@query("SELECT n_name AS path FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR) FROM region")
def delta_active_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = DeltaLog(spark, _folder(spark))
    n = read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    add = lambda p: {"add": {"path": p}}
    log.commit("first", [add(r.n_name) for r in n])
    log.commit("second", [add(f"r{r.r_regionkey}") for r in read(spark, sf_dir, "region").collect()])
    log.commit("third", [{"remove": {"path": r.n_name}} for r in n if r.n_regionkey == 1], 1)
    log.commit("first", [add(r.n_name) for r in n])  # a replay
    return log.active(spark)


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'delta' WHEN 1 THEN 'iceberg' WHEN 2 THEN 'parquet' END AS format FROM part")
def table_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(F.lit(" Delta"), F.lit("ICEBERG"), F.lit(None).cast("string"), F.lit("csv")), F.col("p_size") % 4 + 1)
    return read(spark, sf_dir, "part").select("p_partkey", S.table_format(said).alias("format"))


# -- ids, keys and places ---------------------------------------------------------------


@query("SELECT c_custkey, sha256('name=s:' || rtrim(replace(replace(to_base64(encode(c_name)), '+', '-'), '/', '_'), '=')) AS fingerprint FROM customer")
def partition_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = S.partition_key({"name": S.scalar_string("c_name")})
    return read(spark, sf_dir, "customer").select("c_custkey", S.fingerprint(key).alias("fingerprint"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'cron' WHEN o_orderkey % 3 = 1 THEN 'retry' END AS kind,
CASE WHEN o_orderkey % 3 = 1 THEN 'r' || CAST(o_custkey AS VARCHAR) END AS run_id, CASE WHEN o_orderkey % 3 = 1 THEN 't:' || o_orderstatus END AS task_key,
CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey % 5 AS INTEGER) END AS attempt, CASE WHEN o_orderkey % 3 = 0 THEN 's' || CAST(o_custkey AS VARCHAR) END AS schedule_id,
CASE WHEN o_orderkey % 3 < 2 THEN CAST(1700000000 + o_orderkey AS BIGINT) END AS fire_at FROM orders"""
)
def timer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, k = F.lit(1_700_000_000) + F.col("o_orderkey"), F.col("o_orderkey") % 3
    cron = S.timer_id("cron", F.concat(F.lit("s"), _text("o_custkey")), at)
    retry = S.timer_id("retry", F.concat(F.lit("r"), _text("o_custkey")), F.concat(F.lit("t:"), F.col("o_orderstatus")), F.col("o_orderkey") % 5, at)
    name = F.when(k == 0, cron).when(k == 1, retry).otherwise(F.lit("timer:none"))
    return read(spark, sf_dir, "orders").select("o_orderkey", S.parse_timer_id(name).alias("t")).select("o_orderkey", "t.*")


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_partkey % 1024 AS BIGINT) END AS millis FROM part")
def ulid_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters, k = F.lit(S.CROCKFORD), (F.col("p_partkey") % 1024).cast("int")
    at = lambda i: F.substring(letters, i + 1, 1)
    ulid = F.concat(F.lit("00000000"), at((k / 32).cast("int")), at(k % 32), F.lit("0123456789ABCDEF"))
    broken = F.when(F.col("p_partkey") % 10 == 0, F.concat(ulid, F.lit("U"))).otherwise(F.lower(ulid))
    return read(spark, sf_dir, "part").select("p_partkey", S.ulid_millis(broken).alias("millis"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN '{"a":"' || c_mktsegment || '","b":[' || CAST(c_custkey AS VARCHAR) || ',null]}' END AS body FROM customer""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.when(F.col("c_custkey") % 5 == 0, F.lit("1.5")).otherwise(_text("c_custkey"))
    loose = F.concat(F.lit('{ "b" : ['), n, F.lit(', null],  "a": "'), F.col("c_mktsegment"), F.lit('"}'))
    return read(spark, sf_dir, "customer").select("c_custkey", encoded.canonical_json_udf()(loose).alias("body"))


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'data/' || c_name WHEN 1 THEN 'x/' || c_name END AS location FROM customer"""
)
def scoped_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.array(*map(F.lit, ("/tenant=a/workspace=b/data/", "x/", "tenant=z/workspace=b/", "s3://b/")))
    place = F.concat(F.element_at(starts, (F.col("c_custkey") % 4 + 1).cast("int")), F.col("c_name"))
    return read(spark, sf_dir, "customer").select("c_custkey", S.scoped_location(place, "a", "b").alias("location"))


@query("SELECT s_suppkey, 'https://h/p?a=' || s_name || '&X-Goog-Signature=REDACTED&sig=REDACTED#f' AS url FROM supplier")
def redacted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://h/p?a="), F.col("s_name"), F.lit("&X-Goog-Signature="), F.md5("s_name"), F.lit("&sig="), _text("s_suppkey"), F.lit("#f"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", S.redact_url(url).alias("url"))


@query("SELECT p_partkey, p_partkey % 3 <> 0 AND p_size <= 40 AS valid FROM part")
def edges_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("p_partkey") % 3 == 0, F.lit("a\tb")).otherwise(F.col("p_name"))
    kind = F.when(F.col("p_size") <= 40, F.lit("derives")).otherwise(F.repeat(F.lit("k"), 65))
    return read(spark, sf_dir, "part").select("p_partkey", S.valid_edge(source, _text("p_partkey"), kind, F.lit(None).cast("string")).alias("valid"))


def _base32(hexed: str) -> str:
    """SQL for the first 26 base-32 characters of hexadecimal text."""
    nibbles = ", ".join(f"'{k:04b}'" for k in range(16))
    bits = f"array_to_string([[{nibbles}][strpos('0123456789abcdef', c)] FOR c IN string_split(substr({hexed}, 1, 34), '')], '')"
    five = " + ".join(f"{16 >> k} * CAST(substr(b, 5 * i + {k + 1}, 1) AS INTEGER)" for k in range(5))
    return f"(SELECT array_to_string([substr('abcdefghijklmnopqrstuvwxyz234567', 1 + {five}, 1) FOR i IN range(26)], '') FROM (SELECT {bits} AS b))"


_SECRET = b"a secret"


def _padded(x: int) -> str:
    return "".join(f"\\x{c ^ x:02X}" for c in _SECRET.ljust(64, b"\0"))


@query(f"SELECT c_custkey, 'task_' || {_base32('h')} AS task FROM (SELECT c_custkey, sha256(c_name) AS h FROM customer)")
def task_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", encoded.task_name_udf("task")("c_name").alias("task"))


@query(
    f"""SELECT c_custkey, 'run_' || {_base32('h')} AS run_id FROM (SELECT c_custkey, sha256('{_padded(0x5C)}'::BLOB ||
unhex(sha256('{_padded(0x36)}'::BLOB || encode('t:w:' || c_name)))) AS h FROM customer)"""
)
def run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", encoded.run_id_udf("t", "w", _SECRET)("c_name").alias("run_id"))


@query(
    """SELECT c_custkey, CAST(v % (5000 * CAST(power(2, least(c_custkey % 4, 6)) AS BIGINT) + 1) AS BIGINT) AS wait_ms FROM (SELECT c_custkey, list_sum([CAST(256 ** i AS HUGEINT) *
(16 * (strpos('0123456789abcdef', substr(h, 2 * i + 1, 1)) - 1) + strpos('0123456789abcdef', substr(h, 2 * i + 2, 1)) - 1) FOR i IN range(8)]) AS v
FROM (SELECT c_custkey, sha256(encode(c_name || 'task') || unhex('0' || CAST(c_custkey % 4 + 1 AS VARCHAR) || '000000')) AS h FROM customer))"""
)
def retry_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wait = encoded.full_jitter_udf()("c_name", F.lit("task"), (F.col("c_custkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "customer").select("c_custkey", wait.alias("wait_ms"))


# -- watermarks, merges and folds -------------------------------------------------------


@query("SELECT o_orderkey, o_orderkey % 1000 >= 400 AS fresh FROM orders")
def freshness_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", merge.is_fresh(F.col("o_orderkey") % 1000, 1000, 600).alias("fresh"))


@query(
    """SELECT event_id, CASE WHEN user_id % 4 = 1 THEN 'malformed' WHEN user_id % 4 = 2 THEN 'missing event_type' WHEN event_type = 'click' THEN 'unknown event_type' END AS reason
FROM events WHERE user_id % 4 IN (1, 2) OR event_type = 'click'"""
)
def rejected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = read(spark, sf_dir, "events"), F.col("user_id") % 4
    body = F.when(k == 1, F.lit("{")).when(k == 2, F.lit("{}")).otherwise(F.to_json(F.struct("event_type")))
    known = [r[0] for r in e.select("event_type").distinct().collect() if r[0] != "click"]  # the kinds of events
    return merge.split_invalid(e.select("event_id", body.alias("payload")), "event_type string", known)[1].select("event_id", "reason")


@query("SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS path FROM orders WHERE (lpad(CAST(o_orderkey AS VARCHAR), 12, '0') > '000000000300' OR o_custkey > 50) AND o_orderkey > 20 ORDER BY 1 LIMIT 500")
def missed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lpad(_text("o_orderkey"), 12, "0")
    events = read(spark, sf_dir, "orders").select(name.alias("path"), name.alias("event_id"), F.col("o_custkey").alias("modified_at"))
    return merge.missed(events, "000000000300", 50, cursor="000000000020", page=500).select("path")


@query("SELECT 's' || CAST(c_custkey AS VARCHAR) AS sensor_id, 'b' AS cursor, 2 AS state_version, 'e2' AS last_eval_id FROM customer")
def fold_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sensor is evaluated twice, and a third time against a stale version."""
    name, own = F.concat(F.lit("s"), _text("c_custkey")), F.array(*map(F.lit, (1, 2, 3)))
    e = read(spark, sf_dir, "customer").select(name.alias("sensor_id"), F.explode(own).alias("k"))
    after = F.when(F.col("k") == 1, F.lit("a")).when(F.col("k") == 2, F.lit("b")).otherwise(F.lit("c"))
    body = F.to_json(F.struct(F.concat(F.lit("e"), _text("k")).alias("eval_id"), after.alias("cursor_after"), F.least(F.col("k") - 1, F.lit(1)).alias("expected_state_version")))
    rows = e.select("sensor_id", _text("k").alias("event_id"), F.lit("SensorEvaluated").alias("event_type"), F.concat("sensor_id", _text("k")).alias("idempotency_key"), F.lit(0).alias("ts"), body.alias("payload"))
    folded = fold.fold_events(rows, "sensor_id")
    return fold.entity(folded, "sensor", "cursor string, state_version int, last_eval_id string", "sensor_id")


@query(
    """SELECT 'b' || CAST(c_custkey AS VARCHAR) AS backfill_id, CASE WHEN c_custkey % 2 = 0 THEN 'PAUSED' ELSE 'RUNNING' END AS state,
CAST(CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS state_version, 2 AS planned_chunks FROM customer"""
)
def fold_backfills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks 0, 1 and 3 are planned: two without a gap; even ones are paused, and all asked
    to move with a stale version."""
    name = F.concat(F.lit("b"), _text("c_custkey"))
    step = F.explode(F.array(*(F.lit(x) for x in ("1", "2-0", "3-1", "4-3", "5", "6")))).alias("k")
    e = read(spark, sf_dir, "customer").select(name.alias("backfill_id"), "c_custkey", step)
    at = F.substring("k", 3, 1)
    chunk = F.to_json(F.struct(F.concat_ws(":", "backfill_id", at).alias("chunk_id"), at.cast("int").alias("chunk_index")))
    move = lambda v: F.to_json(F.struct(F.lit("RUNNING").alias("from_state"), F.lit("PAUSED").alias("to_state"), F.lit(v).alias("state_version")))
    kind = F.when(F.col("k") == "1", "BackfillCreated").when(at != "", "BackfillChunkPlanned").otherwise("BackfillStateChanged")
    body = F.when(F.col("k") == "1", F.lit('{"chunk_size":10}')).when(at != "", chunk).when(F.col("k") == "5", F.when(F.col("c_custkey") % 2 == 0, move(2)).otherwise(move(7))).otherwise(move(9))
    rows = e.select("backfill_id", F.col("k").alias("event_id"), kind.alias("event_type"), F.concat("backfill_id", "k").alias("idempotency_key"), F.lit(0).alias("ts"), body.alias("payload"))
    folded = fold.fold_events(rows, "backfill_id")
    return fold.entity(folded, "backfill", "state string, state_version int, planned_chunks int", "backfill_id")


@query("SELECT p_name AS name, 'p' || CAST(p_partkey AS VARCHAR) AS object_id, 'TABLE' AS object_type FROM part WHERE p_partkey % 5 > 1")
def metastore_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects are renamed; every fifth is deleted, another fifth inactive."""
    part, k = read(spark, sf_dir, "part"), F.col("p_partkey") % 5
    both = part.withColumn("sequence", F.explode(F.array(F.lit(1), F.lit(2))))
    last = F.col("sequence") == 2
    records = both.select(
        F.lit("securable").alias("kind"), F.concat(F.lit("p"), _text("p_partkey")).alias("object_id"), F.lit("TABLE").alias("object_type"),
        F.when(last, F.col("p_name")).otherwise(F.lit("old")).alias("name"), F.when(last & (k == 1), "DELETED").otherwise("ACTIVE").alias("lifecycle_state"),
        "sequence", F.lit(0).alias("position"), (last & (k == 0)).alias("deleted"),
    )
    return metastore.object_names(metastore.replay(records))


@query(
    """SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS name, 'r' || CAST(n_regionkey AS VARCHAR) AS namespace_id
FROM nation WHERE n_nationkey % 5 <> 4"""
)
def catalog_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each nation in its region's namespace; even ones are renamed, every
    fifth is dropped, and all creations come twice."""
    tag = lambda t, c: F.concat(F.lit(t), _text(c))
    nation, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    table = F.struct(tag("n", "n_nationkey").alias("id"), F.col("n_name").alias("name"), tag("r", "n_regionkey").alias("namespace_id"))
    spaces = read(spark, sf_dir, "region").select(tag("1", "r_regionkey").alias("event_id"), F.lit("namespace.created").alias("kind"), F.to_json(F.struct(tag("r", "r_regionkey").alias("id"), F.col("r_name").alias("name"))).alias("payload"))
    at = lambda n: F.concat(F.lit(n), F.lpad(_text("n_nationkey"), 3, "0"))
    made = [nation.select(at(n), F.lit("table.created"), F.to_json(table)) for n in ("2", "3")]
    renamed = nation.where(k % 2 == 0).select(at("4"), F.lit("table.renamed"), F.to_json(F.struct(tag("n", "n_nationkey").alias("id"), F.lower("n_name").alias("name"))))
    dropped = nation.where(k % 5 == 4).select(at("5"), F.lit("table.deleted"), F.to_json(F.struct(tag("n", "n_nationkey").alias("id"))))
    state = metastore.fold_catalog(spaces.union(made[0]).union(made[1]).union(renamed).union(dropped))
    return spark.createDataFrame([(t["id"], t["name"], t["namespace_id"]) for t in state.rows["table"].values()], "id string, name string, namespace_id string")


@query(
    """SELECT 's' || CAST(s_suppkey AS VARCHAR) AS object_id, CASE s_suppkey % 3 WHEN 0 THEN 'PRINCIPAL' WHEN 1 THEN 'CREDENTIAL' ELSE 'TABLE' END AS object_type, s_name AS name, '9' AS ledger_watermark FROM supplier"""
)
def metastore_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three kinds, without the columns that stay inside."""
    k, none = F.col("s_suppkey") % 3, F.lit(None).cast("string")
    kind = F.when(k == 0, "principal").when(k == 1, "credential").otherwise("securable")
    records = read(spark, sf_dir, "supplier").select(
        kind.alias("kind"), F.concat(F.lit("s"), _text("s_suppkey")).alias("object_id"), F.when(k == 2, "TABLE").alias("object_type"), F.col("s_name").alias("name"), none.alias("owner"),
        F.lit("ACTIVE").alias("lifecycle_state"), F.lit(1).alias("updated_at"), F.lit(1).alias("sequence"), F.lit(0).alias("position"), F.lit(False).alias("deleted"), F.lit("hush").alias("secret"),
    )
    return metastore.safe_objects(metastore.replay(records), "9").select("object_id", "object_type", "name", "ledger_watermark")


@query("SELECT CAST(c_custkey AS VARCHAR) AS snapshot_id, c_custkey AS created_at FROM customer")
def exact_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = schemas.schema("catalog.snapshots")
    rows = _shaped(read(spark, sf_dir, "customer"), want, snapshot_id=F.col("c_custkey"), created_at=F.col("c_custkey"))
    return schemas.require_exact(rows, "catalog.snapshots").select("snapshot_id", "created_at")


# -- rules ------------------------------------------------------------------------------


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'SKIP' ELSE 'CREATE' END AS action, CASE WHEN o_orderstatus = 'P' THEN 'already_created' END AS reason FROM orders"""
)
def dispatch_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "P", "CREATED").otherwise("PENDING")
    return rules.dispatcher(read(spark, sf_dir, "orders").select("o_orderkey", state.alias("status"))).select("o_orderkey", "action", "reason")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'CREATE' ELSE 'SKIP' END AS action,
CASE WHEN o_orderstatus = 'F' THEN 'already_fired' WHEN o_orderstatus = 'P' THEN 'cancelled' WHEN o_orderkey % 2 = 1 THEN 'already_has_cloud_task_id' END AS reason FROM orders"""
)
def timer_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "FIRED").when(F.col("o_orderstatus") == "P", "CANCELLED").otherwise("SCHEDULED")
    task = F.when(F.col("o_orderkey") % 2 == 1, _text("o_orderkey"))
    timers = read(spark, sf_dir, "orders").select("o_orderkey", state.alias("state"), task.alias("cloud_task_id"))
    return rules.timer_outbox(timers).select("o_orderkey", "action", "reason")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND (c_custkey % 10 = 0 OR c_custkey % 10 >= 4)")
def sensors_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("c_mktsegment") == "BUILDING", "ACTIVE").otherwise("PAUSED")
    last = F.when(F.col("c_custkey") % 10 != 0, F.lit(100_000) - F.col("c_custkey") % 10 * 1000)
    sensors = read(spark, sf_dir, "customer").select("c_custkey", status.alias("status"), last.alias("last_evaluation_at"))
    return rules.due_sensors(sensors, 100_000, 4).select("c_custkey")


@query(
    """SELECT o_orderkey, o_orderkey % 4 <> 0 AND o_orderstatus = 'O' AS accepted, CASE WHEN o_orderkey % 4 = 0 THEN 'version_conflict' WHEN o_orderstatus <> 'O' THEN 'invalid_transition' END AS reason FROM orders"""
)
def backfill_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("SUCCEEDED")
    expected = F.when(F.col("o_orderkey") % 4 == 0, 3).otherwise(F.lit(7))
    move = rules.backfill_transition(state, F.lit(7), F.lit("pause"), expected)
    return read(spark, sf_dir, "orders").select("o_orderkey", move.alias("m")).select("o_orderkey", "m.accepted", "m.reason")


def _requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, sf_dir, "orders")
    asked = orders.select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") != "P", "schedule").alias("source"))
    return asked, orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("run_id"))


@query("SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'P' THEN 'SKIP' ELSE 'TRIGGER' END AS action FROM orders WHERE o_orderkey % 3 <> 0")
def bridge_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.run_bridge(*_requests(spark, sf_dir)).select("run_id", "action")


@query("SELECT o_orderkey AS run_id FROM orders WHERE o_orderkey % 3 <> 0")
def requests_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.pending_requests(*_requests(spark, sf_dir)).select("run_id")


@query(
    """SELECT o_orderkey AS run_id, o_orderkey % 3 <> 0 AS emit_triggered, o_orderkey % 2 <> 0 AS emit_plan FROM orders
WHERE o_orderstatus <> 'P' AND o_orderkey % 5 > 0 AND (o_orderkey % 3 <> 0 OR o_orderkey % 2 <> 0)"""
)
def requests_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, runs = _requests(spark, sf_dir)
    orders = read(spark, sf_dir, "orders")
    tasks = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("run_id"))
    sizes = orders.select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 5).alias("planned"))
    return rules.run_requests_missing(asked, runs, tasks, sizes).select("run_id", "emit_triggered", "emit_plan")


@query("SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS task_key FROM orders WHERE o_orderstatus <> 'F'")
def rerun_from_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").otherwise("FAILED")
    return rules.rerun_selection(read(spark, sf_dir, "orders").select(_text("o_orderkey").alias("task_key"), state.alias("state")), "FROM_FAILURE", "FAILED")


@query("SELECT event_id FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) AND user_id % 100 < 50")
def ledger_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    middle = e.agg(F.max("event_id")).first()[0] // 2
    files = e.select("event_id", (F.col("user_id") % 100 * 3_600_000).alias("modified_at"))
    return rules.ledger_garbage(files, middle, 98 * 3_600_000, 48).select("event_id")


@query(
    """SELECT l_orderkey AS table_id, 'm' || CAST(l_linenumber AS VARCHAR) || '.metadata.json' AS path FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
WHERE n > 2 AND l_linenumber <> 1"""
)
def orphan_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last two metadata files of each table stay."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    name = F.concat(_text("l_orderkey"), F.lit("/m"), _text("l_linenumber"), F.lit(".metadata.json"))
    files = line.select(F.col("l_orderkey").alias("table_id"), name.alias("path"), F.col("l_linenumber").alias("timestamp"))
    none = F.lit(None).cast("string")
    tables = files.groupBy("table_id").agg(F.concat(F.first("table_id").cast("string"), F.lit("/m1.metadata.json")).alias("stable"))
    tables = tables.select("table_id", none.alias("current"), "stable", none.alias("pending"), none.alias("previous"))
    out = rules.orphan_metadata(files, rules.metadata_allowlist(tables, files, 2))
    return out.select("table_id", F.split_part("path", F.lit("/"), F.lit(2)).alias("path"))


@query("SELECT o_orderkey AS run_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'O')")
def outputs_unmet(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").otherwise("RUNNING")
    runs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), state.alias("state"))
    seen = F.when(F.col("l_linestatus") == "O", "VISIBLE")
    tasks = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_returnflag") == "R").alias("requires_visible_output"), seen.alias("output_visibility_state"))
    return aggregates.unmet_outputs(runs, tasks).select("run_id")


@query(
    """SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0) AS pending_requests, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending_dispatches,
(SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS pending_timers, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A') AS ready_tasks, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS running_tasks"""
)
def backlog_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, runs = _requests(spark, sf_dir)
    outbox = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise("CREATED").alias("status"))
    timers = read(spark, sf_dir, "customer").select(F.when(F.col("c_mktsegment") == "BUILDING", "SCHEDULED").otherwise("FIRED").alias("state"), F.lit(None).cast("string").alias("cloud_task_id"))
    tasks = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "A", "READY").when(F.col("l_returnflag") == "R", "RUNNING").otherwise("SUCCEEDED").alias("state"))
    return aggregates.backlog(asked, runs, outbox, timers, tasks)


# -- lists, order and graphs ------------------------------------------------------------


@query("SELECT l_orderkey AS version, max(l_partkey) AS modified_at FROM lineitem GROUP BY 1")
def newest_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.newest_by_version(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version"), F.col("l_partkey").alias("modified_at")))


@query("SELECT l_orderkey, list(DISTINCT l_returnflag ORDER BY l_returnflag) AS modes FROM lineitem GROUP BY 1")
def selections_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(aggregates.sorted_set(F.collect_list("l_returnflag")).alias("modes"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 3")
def earliest_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.earliest(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lit(3).alias("most")), "o_custkey", "o_orderkey", "most").drop("most")


@query("SELECT 'b' || CAST(c_custkey AS VARCHAR) AS backfill_id, CAST(c_nationkey AS BIGINT) AS created_at FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_nationkey DESC, 1 LIMIT 50 OFFSET 50")
def backfill_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a list, by the first one's token."""
    rows = read(spark, sf_dir, "customer").select(F.concat(F.lit("b"), _text("c_custkey")).alias("backfill_id"), F.col("c_nationkey").cast("long").alias("created_at"), F.col("c_mktsegment").alias("state"))
    _, token = listing.page(rows, "backfills", state="BUILDING")
    got = listing.page(rows, "backfills", token, state="BUILDING")[0] if token else []
    return spark.createDataFrame([(r.backfill_id, r.created_at) for r in got], "backfill_id string, created_at long")


@query("SELECT p_name AS name, p_partkey AS id FROM part ORDER BY p_name, p_partkey LIMIT 100 OFFSET 20")
def offset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))
    return listing.offset_page(rows, ["name", "id"], "20", windows.page_size(None, 100, 500))[0]


@query(
    """SELECT name, CAST(row_number() OVER (ORDER BY r, k) - 1 AS BIGINT) AS position FROM (SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS name, r_regionkey AS r, -1 AS k FROM region
UNION ALL SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0'), n_regionkey, n_nationkey FROM nation)"""
)
def plan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = {f"r{r.r_regionkey}": [] for r in read(spark, sf_dir, "region").collect()}
    plan |= {f"n{r.n_nationkey:03d}": [f"r{r.n_regionkey}"] for r in read(spark, sf_dir, "nation").collect()}
    return spark.createDataFrame(list(enumerate(graph.topological_order(plan))), "position long, name string")


@query(
    """WITH RECURSIVE w AS (SELECT max(n_nationkey) AS k, 0 AS step FROM nation UNION ALL SELECT w.k // 3, step + 1 FROM w WHERE w.k > 0) SELECT 'm' || CAST(k AS VARCHAR) AS path, step FROM w"""
)
def metadata_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    logs = read(spark, sf_dir, "nation").select(F.concat(F.lit("m"), _text("n_nationkey")).alias("path"), F.concat(F.lit("m"), F.floor(k / 3).cast("string")).alias("previous"))
    return graph.walk_log(logs, f"m{read(spark, sf_dir, 'nation').agg(F.max('n_nationkey')).first()[0]}")


# -- the SQL function library -----------------------------------------------------------

same_sql(
    "sql_regression",
    """SELECT l_returnflag, regr_count(l_tax, l_discount) AS n, round(regr_avgx(l_tax, l_discount), 6) AS ax, round(regr_avgy(l_tax, l_discount), 6) AS ay,
round(regr_sxx(l_extendedprice, l_quantity) / 1000, 3) AS sxx, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS icept,
round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(covar_pop(l_tax, l_discount), 9) AS cp, round(covar_samp(l_tax, l_discount), 9) AS cs FROM lineitem GROUP BY l_returnflag""",
)
same_sql(
    "sql_bit_and_bool_aggregates",
    """SELECT p_brand, bit_and(p_size) AS ba, bit_or(p_size) AS bo, bit_xor(p_size) AS bx, bool_and(p_size > 0) AS al, bool_or(p_size > 49) AS an,
max_by(p_partkey, p_partkey) AS mx, min_by(p_name, p_partkey) AS mn, round(var_pop(p_size), 6) AS vp, round(stddev_pop(p_size), 6) AS sp FROM part GROUP BY p_brand""",
)
same_sql(
    "sql_conditional_functions",
    """SELECT s_suppkey, coalesce(nullif(s_nationkey, 3), -1) AS c, ifnull(nullif(s_nationkey, 4), -2) AS i, if(s_acctbal > 0, 'pos', 'neg') AS f,
CASE s_nationkey WHEN 1 THEN 'one' ELSE 'more' END AS k, s_acctbal IS NOT DISTINCT FROM NULL AS d FROM supplier""",
)


@query("SELECT l_orderkey, list_sort(list(l_linenumber)) AS s, len(list(l_linenumber)) AS n, list_contains(list(l_linenumber), 3) AS h, list_sort(list_distinct(list(l_returnflag))) AS d, array_to_string(list_sort(list(l_returnflag)), '-') AS j FROM lineitem GROUP BY l_orderkey")
def sql_array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of another dialect, translated."""
    sql = """SELECT l_orderkey, list_sort(collect_list(l_linenumber)) AS s, array_length(collect_list(l_linenumber)) AS n, array_has(collect_list(l_linenumber), 3) AS h,
    list_sort(list_distinct(collect_list(l_returnflag))) AS d, array_to_string(list_sort(collect_list(l_returnflag)), '-') AS j FROM lineitem GROUP BY l_orderkey"""
    parsed = sqlgate.parse(spark, sqlgate.translate_functions(sql))
    return sqlgate.bind_views(spark, parsed, {r: read(spark, sf_dir, r[-1]) for r in parsed.relations})


@query("SELECT o_custkey, map_keys(m) AS k, element_at(m, 'O')[1] AS o FROM (SELECT o_custkey, map_from_entries(list({'k': s, 'v': n} ORDER BY s)) AS m FROM (SELECT o_custkey, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1)")
def sql_map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = """SELECT o_custkey, map_keys(m) AS k, map_extract(m, 'O') AS o FROM (SELECT o_custkey, map_from_entries(array_sort(collect_list(struct(s, n)))) AS m FROM
    (SELECT o_custkey, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1)"""
    parsed = sqlgate.parse(spark, sqlgate.translate_functions(sql))
    return sqlgate.bind_views(spark, parsed, {r: read(spark, sf_dir, r[-1]) for r in parsed.relations})
