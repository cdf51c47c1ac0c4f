"""Rules, joins, checks and folds over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.functions import cron
from lakelens.operators import checks, fold, joins, rules
from lakelens.queries import query, read

_NOW = 1_700_000_000_000


# -- staleness and partitions --------------------------------------------------


@query(
    """WITH p AS (SELECT c_custkey AS a, max(epoch_ms(o_orderdate)) AS tm, max(o_orderstatus) AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
u AS (SELECT c_custkey AS a, n_nationkey AS k, CASE WHEN n_nationkey <> 7 THEN 850000000000 + n_nationkey * 5000000000 END AS tm FROM customer JOIN nation ON n_nationkey = c_nationkey OR n_nationkey = 0),
g AS (SELECT p.a, bool_or(u.tm IS NULL) AS never, arg_min(u.tm, u.k) FILTER (WHERE u.tm > p.tm) AS newer FROM p JOIN u ON u.a = p.a GROUP BY p.a)
SELECT p.a AS asset_key, CASE WHEN p.tm IS NULL THEN 'NEVER_MATERIALIZED' WHEN p.v <> 'P' THEN 'CODE_CHANGED' WHEN never THEN 'UPSTREAM_NEVER_MATERIALIZED'
 WHEN newer IS NOT NULL THEN 'UPSTREAM_CHANGED' WHEN 980000000000 > p.tm + 17280000000 THEN 'FRESHNESS_POLICY' END AS stale_reason,
CASE WHEN p.tm IS NULL THEN NULL WHEN p.v <> 'P' THEN 980000000000 WHEN never THEN NULL WHEN newer IS NOT NULL THEN newer
 WHEN 980000000000 > p.tm + 17280000000 THEN p.tm + 17280000000 END AS stale_at FROM p LEFT JOIN g ON g.a = p.a"""
)
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    parts = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_custkey").alias("asset_key")).agg(
        F.max(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("last_materialization_at"),
        F.max("o_orderstatus").alias("last_materialization_code_version"),
    )
    parts = parts.withColumn("partition_key", F.lit("p"))
    n = F.col("n_nationkey")
    at = F.when(n != 7, F.lit(850_000_000_000) + n * F.lit(5_000_000_000))
    nations = read(spark, sf_dir, "nation").select(n, at.alias("upstream_at"))
    own = c.select(F.col("c_custkey").alias("asset_key"), F.explode(F.array_distinct(F.array(F.col("c_nationkey"), F.lit(0)))).alias("n_nationkey"))
    ups = own.join(nations, "n_nationkey").select("asset_key", F.lit("p").alias("partition_key"), F.col("n_nationkey").alias("upstream_key"), "upstream_at")
    out = rules.staleness(parts, ups, 980_000_000_000, "P", 1440 * 200)
    return out.select("asset_key", "stale_reason", "stale_at")


@query(
    """SELECT user_id AS run_key, event_type AS existing_fingerprint, other AS conflicting_fingerprint, event_id AS conflicting_event_id FROM (
SELECT event_id, user_id, event_type AS other, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS event_type FROM events) WHERE other <> event_type"""
)
def run_key_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_key"), "event_id", F.col("event_type").alias("request_fingerprint"), F.lit("v1").alias("code_version"), "ts"
    )
    return fold.run_requests(requests)[1].drop("detected_at")


@query(
    """SELECT user_id AS asset_key, event_type AS partition_key, arg_max(event_id, event_id) FILTER (WHERE value > 20) AS last_materialization_at,
arg_max(CASE WHEN value > 20 THEN 'SUCCEEDED' ELSE 'FAILED' END, event_id) AS last_attempt_outcome, max(event_id) AS row_version FROM events GROUP BY 1, 2"""
)
def partition_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    finishes = e.select(
        F.col("user_id").alias("asset_key"), F.col("event_type").alias("partition_key"), "event_id", F.col("event_id").alias("at"), F.lit("r").alias("run_id"),
        F.when(F.col("value") > 20, "SUCCEEDED").otherwise("FAILED").alias("outcome"),
        *(none.alias(c) for c in ("code_version", "delta_table", "delta_version", "delta_partition", "execution_lineage_ref")),
    )
    return fold.partition_status(finishes).select("asset_key", "partition_key", "last_materialization_at", "last_attempt_outcome", "row_version")


@query(
    """SELECT o_orderkey AS run_id, l_linenumber AS task_key, o_orderstatus AS run_status, l_returnflag AS task_status, CASE WHEN o_orderkey % 2 = 0 THEN 'manual' END AS kind,
'sales' AS target_namespace, 'p' || CAST(l_partkey AS VARCHAR) AS target_table, greatest(o_orderpriority, l_linestatus) AS row_version
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey % 3 = 0"""
)
def catalog_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.lit("p").alias("plan_id"), F.lit("k").alias("run_key"), F.col("o_orderstatus").alias("state"),
        F.lit(False).alias("cancel_requested"), F.when(F.col("o_orderkey") % 2 == 0, '{"run_kind":"manual"}').otherwise("{}").alias("labels"),
        F.lit(0).alias("triggered_at"), F.lit(0).alias("completed_at"), F.col("o_orderpriority").alias("row_version"),
    )
    asset = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("sales."), F.lit("p"), F.col("l_partkey").cast("string")))
    tasks = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("task_key"), F.col("l_returnflag").alias("state"), asset.alias("asset_key"),
        F.lit(None).cast("string").alias("partition_key"), F.lit(1).alias("attempt"), F.lit(None).cast("string").alias("output_visibility_state"),
        F.lit(0).alias("completed_at"), F.col("l_linestatus").alias("row_version"),
    )
    out = fold.catalog_run_index(runs, tasks)
    return out.select("run_id", "task_key", "run_status", "task_status", "kind", "target_namespace", "target_table", "row_version")


# -- rules ------------------------------------------------------------------------

_TASKS = """SELECT l_orderkey AS run_id, CAST(l_partkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS task_key,
CASE l_linenumber % 5 WHEN 0 THEN 'READY' WHEN 1 THEN 'DISPATCHED' WHEN 2 THEN 'RETRY_WAIT' WHEN 3 THEN 'RUNNING' ELSE 'SUCCEEDED' END AS state,
CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE l_linenumber % 3 + 1 END AS attempt, CASE WHEN l_quantity < 45 THEN 'a' END AS attempt_id, 3 AS max_attempts,
1700000000000 - CAST(l_quantity AS BIGINT) * 20000 AS tm FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)"""
_OUTBOX = f"SELECT run_id, task_key, greatest(attempt, 1) AS attempt, tm, CASE WHEN run_id % 2 = 0 THEN 'PENDING' ELSE 'CREATED' END AS status FROM ({_TASKS}) WHERE run_id % 3 = 0"


def _rule_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey").agg(F.min("l_quantity").alias("q"))
    n = F.col("l_linenumber")
    state = F.element_at(F.array(*map(F.lit, ("READY", "DISPATCHED", "RETRY_WAIT", "RUNNING", "SUCCEEDED"))), (n % 5 + 1).cast("int"))
    at = F.lit(_NOW) - F.col("q").cast("long") * 20_000
    return rows.select(
        F.col("l_orderkey").alias("run_id"), F.concat_ws("-", F.col("l_partkey").cast("string"), n.cast("string"), F.col("l_suppkey").cast("string")).alias("task_key"),
        state.alias("state"), F.when(n % 5 == 0, 0).otherwise(n % 3 + 1).alias("attempt"), F.when(F.col("q") < 45, "a").alias("attempt_id"), F.lit(3).alias("max_attempts"),
        at.alias("ready_at"), at.alias("retry_not_before"), at.alias("last_heartbeat_at"), at.alias("started_at"), F.lit(300).alias("heartbeat_timeout_sec"),
    )


def _rule_outbox(tasks: DataFrame) -> DataFrame:
    from lakelens.functions.scalars import dispatch_id

    attempt = F.greatest("attempt", F.lit(1))
    return tasks.where(F.col("run_id") % 3 == 0).select(
        "run_id", "task_key", attempt.alias("attempt"), F.col("ready_at").alias("created_at"), dispatch_id("run_id", "task_key", attempt).alias("dispatch_id"),
        F.when(F.col("run_id") % 2 == 0, "PENDING").otherwise("CREATED").alias("status"),
    )


@query(
    f"""SELECT t.run_id, t.task_key, CASE WHEN t.run_id % 7 = 0 OR o.status IS NOT NULL THEN 'SKIP' ELSE 'EMIT' END AS action,
CASE WHEN t.run_id % 7 = 0 THEN 'run_cancel_requested' WHEN o.status = 'PENDING' THEN 'existing_dispatch:Pending' WHEN o.status IS NOT NULL THEN 'existing_dispatch:Created' END AS reason
FROM ({_TASKS}) t LEFT JOIN ({_OUTBOX}) o ON o.run_id = t.run_id AND o.task_key = t.task_key AND o.attempt = 1 WHERE t.state = 'READY'"""
)
def ready_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _rule_tasks(spark, sf_dir)
    runs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 7 == 0).alias("cancel_requested"))
    return rules.ready_dispatch(tasks, runs, _rule_outbox(tasks)).select("run_id", "task_key", "action", "reason")


@query(
    f"""WITH t AS ({_TASKS}), o AS ({_OUTBOX}), j AS (SELECT t.*, o.status, o.tm AS made FROM (SELECT *, CASE state WHEN 'READY' THEN greatest(attempt, 1) WHEN 'RETRY_WAIT' THEN attempt + 1 ELSE attempt END AS target FROM t) t
LEFT JOIN o ON o.run_id = t.run_id AND o.task_key = t.task_key AND o.attempt = t.target)
SELECT run_id, task_key, CASE WHEN state = 'DISPATCHED' AND made IS NOT NULL THEN 'REDISPATCH_STUCK_TASK' WHEN state = 'RUNNING' THEN 'FAIL_STALE_RUNNING_TASK' ELSE 'CREATE_DISPATCH_OUTBOX' END AS repair,
CAST(target AS INTEGER) AS attempt FROM j WHERE state = 'READY' AND 1700000000000 - tm > 300000 AND status IS NULL OR state = 'DISPATCHED' AND (made IS NULL OR 1700000000000 - made > 600000)
OR state = 'RETRY_WAIT' AND attempt < max_attempts AND 1700000000000 >= tm AND status IS NULL OR state = 'RUNNING' AND 1700000000000 - tm > 360000 AND attempt_id IS NOT NULL"""
)
def anti_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _rule_tasks(spark, sf_dir)
    return rules.anti_entropy(tasks, _rule_outbox(tasks), _NOW).select("run_id", "task_key", "repair", "attempt")


@query(
    f"""SELECT run_id, task_key, CASE WHEN state <> 'RUNNING' THEN 'NOOP' WHEN age > 330 AND attempt_id IS NOT NULL THEN 'FAIL' ELSE 'RESCHEDULE' END AS action,
CASE WHEN state = 'SUCCEEDED' THEN 'terminal' WHEN state <> 'RUNNING' THEN 'not_running' WHEN age > 330 AND attempt_id IS NULL THEN 'missing_attempt_id' WHEN age > 330 THEN 'heartbeat_timeout' ELSE 'task_healthy' END AS reason,
CASE WHEN state <> 'RUNNING' OR age > 330 AND attempt_id IS NOT NULL THEN NULL WHEN age > 330 THEN 10.0 ELSE greatest(10.0, 300 - age + 30) END AS delay_s
FROM (SELECT *, CAST((1700000000000 - tm) / 1000 AS DOUBLE) AS age FROM ({_TASKS}))"""
)
def heartbeat_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.heartbeat_check(_rule_tasks(spark, sf_dir), _NOW)


@query(
    f"""SELECT run_id, task_key, CASE WHEN state = 'RETRY_WAIT' AND attempt < 3 THEN 'INCREMENT' ELSE 'NOOP' END AS action,
CASE WHEN state = 'SUCCEEDED' THEN 'terminal' WHEN state <> 'RETRY_WAIT' THEN 'not_in_retry_wait' WHEN attempt >= 3 THEN 'max_attempts_reached' END AS reason FROM ({_TASKS})"""
)
def retry_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.retry_fire(_rule_tasks(spark, sf_dir)).drop("delay_s")


@query(
    """WITH b AS (SELECT n_nationkey AS id, n_nationkey % 3 AS planned, 1 + n_nationkey % 4 AS slots FROM nation WHERE n_nationkey % 5 <> 0),
k AS (SELECT s_nationkey AS id, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos FROM supplier),
n AS (SELECT id, count(*) AS total FROM k GROUP BY id), c AS (SELECT b.id, b.planned, b.slots - CASE WHEN b.id % 2 = 0 THEN 1 ELSE 0 END AS free, CAST(ceil(n.total / 2.0) AS BIGINT) AS chunks FROM b JOIN n ON n.id = b.id),
x AS (SELECT c.id, unnest(range(c.planned, c.chunks)) AS i, c.free FROM c), y AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS rn FROM x WHERE NOT (id % 2 = 0 AND i = 2))
SELECT CAST(y.id AS VARCHAR) AS backfill_id, CAST(y.i AS INTEGER) AS chunk_index, string_agg(CAST(k.s_suppkey AS VARCHAR), ',' ORDER BY k.pos) AS keys
FROM y JOIN k ON k.id = y.id AND k.pos // 2 = y.i WHERE rn <= free GROUP BY y.id, y.i"""
)
def backfill_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.col("n_nationkey")
    s = read(spark, sf_dir, "supplier")
    keys = s.select(
        F.col("s_nationkey").cast("string").alias("backfill_id"),
        (F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1).alias("position"),
        F.col("s_suppkey").cast("string").alias("key"),
    )
    totals = keys.groupBy("backfill_id").agg(F.count("*").alias("total_partitions"))
    b = read(spark, sf_dir, "nation").select(
        n.cast("string").alias("backfill_id"), F.when(n % 5 == 0, "PAUSED").otherwise("RUNNING").alias("state"), F.lit(2).alias("chunk_size"),
        (1 + n % 4).alias("max_concurrent_runs"), (n % 3).alias("planned_chunks"),
    ).join(totals, "backfill_id")
    chunks = read(spark, sf_dir, "nation").where(n % 2 == 0).select(
        n.cast("string").alias("backfill_id"), F.concat(n.cast("string"), F.lit(":2")).alias("chunk_id"), F.lit("RUNNING").alias("state"), F.lit(None).cast("string").alias("run_id")
    )
    runs = spark.createDataFrame([], "run_id string, state string")
    out = rules.backfill_plan(b, chunks, runs, keys)
    return out.select("backfill_id", "chunk_index", F.array_join("keys", ",").alias("keys"))


@query(
    """SELECT CAST(n_nationkey AS VARCHAR) AS schedule_id, CAST(1700000000000 // 3600000 * 3600000 - i * 3600000 AS BIGINT) AS scheduled_for,
CASE WHEN n_nationkey % 4 = 0 THEN 'PAUSED' ELSE 'TRIGGERED' END AS status FROM (
SELECT n_nationkey, unnest(range(n_nationkey)) AS i FROM nation) WHERE n_nationkey - i <= 6"""
)
def schedule_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    defs = read(spark, sf_dir, "nation").select(
        n.cast("string").alias("schedule_id"), F.lit("0 * * * *").alias("cron_expression"), F.lit("Europe/Berlin").alias("timezone"),
        F.lit(100_000).alias("catchup_window_minutes"), F.lit(6).alias("max_catchup_ticks"), (n % 4 != 0).alias("enabled"), n,
    )
    hour = 3_600_000
    state = defs.select("schedule_id", (F.lit(_NOW // hour * hour) - n * hour).alias("last_scheduled_for"))
    return cron.schedule_ticks(defs.drop("n_nationkey"), state, _NOW).select("schedule_id", "scheduled_for", "status")


@query(
    """SELECT o_orderkey AS run_key, CASE WHEN o_orderkey % 4 = 0 THEN 'schedule' WHEN o_orderkey % 3 = 0 THEN 'sensor' WHEN o_orderkey % 2 = 0 THEN 'backfill' END AS source,
CASE WHEN o_orderkey % 4 = 0 THEN 2 WHEN o_orderkey % 3 = 0 THEN 3 WHEN o_orderkey % 2 = 0 THEN 1 END AS source_ref FROM orders WHERE o_orderkey % 5 <> 0"""
)
def resolve_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders")
    base = o.select(k.alias("run_key"), F.lit("f").alias("request_fingerprint"), k.alias("run_id"))

    def source(mod: int, refs: list[int], fp: str = "f") -> DataFrame:
        rows = o.where(k % mod == 0).select(k.alias("run_key"), F.lit(fp).alias("request_fingerprint"), F.explode(F.array(*map(F.lit, refs))).alias("source_ref"))
        return rows.withColumn("row_version", F.col("source_ref"))

    other = source(1, [9], "other")
    resolved = joins.resolve_requests(base, source(4, [1, 2]), source(3, [3]).union(other), source(2, [1]))
    runs = o.where(k % 5 == 0).select(k.alias("run_id"))
    return rules.run_bridge(resolved, runs).select("run_key", "source", "source_ref")


# -- files and inventories -----------------------------------------------------------


@query(
    """WITH e AS (SELECT DISTINCT 's/v' || CAST(l_linenumber AS VARCHAR) || '/' || CAST(l_suppkey AS VARCHAR) AS path FROM lineitem WHERE l_linenumber = 4 AND l_suppkey % 3 <> 0),
a AS (SELECT DISTINCT 's/v' || CAST(l_linenumber AS VARCHAR) || '/' || CAST(l_suppkey AS VARCHAR) AS path, l_linenumber AS v FROM lineitem WHERE l_linenumber >= 3 AND l_suppkey % 5 <> 0)
SELECT coalesce(a.path, e.path) AS path, CASE WHEN a.path IS NULL THEN 'missing_snapshot' WHEN v < 4 THEN 'old_snapshot_version' ELSE 'orphaned_snapshot' END AS issue_type
FROM e FULL OUTER JOIN a ON a.path = e.path WHERE a.path IS NULL OR e.path IS NULL"""
)
def reconcile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("s/v"), F.col("l_linenumber").cast("string"), F.lit("/"), F.col("l_suppkey").cast("string")).alias("path")
    line = read(spark, sf_dir, "lineitem")
    expected = line.where("l_linenumber = 4 and l_suppkey % 3 <> 0").select(path).distinct()
    actual = line.where("l_linenumber >= 3 and l_suppkey % 5 <> 0").select(path).distinct()
    return joins.file_issues(expected, actual, 4).select("path", "issue_type")


@query(
    """SELECT CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) AS path, 'beyond_retention' AS reason FROM (
SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)
WHERE rn > 10 AND epoch_ms(o_orderdate) < 946684800000 - 86400000 AND o_orderkey % 6 <> 0"""
)
def snapshot_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("domain"), F.col("o_orderkey").alias("version"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("modified_at"),
        F.concat_ws("/", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("path"),
    )
    kept = dirs.where("version % 6 = 0").select("path")
    return rules.snapshot_garbage(dirs, kept, 1 << 40, 946_684_800_000)


@query(
    """SELECT coalesce(a.k, b.k) AS path, CASE WHEN a.k IS NULL THEN 'UNEXPECTED' WHEN b.k IS NULL THEN 'MISSING' WHEN a.n <> b.n THEN 'MISMATCH' ELSE 'MATCH' END AS status
FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_custkey % 7 <> 0 GROUP BY 1) a FULL OUTER JOIN
(SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 50 <> 0 AND o_custkey % 11 <> 0 GROUP BY 1) b ON a.k = b.k"""
)
def inventory_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    count = lambda df: df.groupBy(F.col("o_custkey").alias("path")).agg(F.count("*").alias("row_count"))
    return rules.inventory_diff(count(o.where("o_custkey % 7 <> 0")), count(o.where("o_orderkey % 50 <> 0 and o_custkey % 11 <> 0"))).select("path", "status")


@query(
    """WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) || regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/$', '') AS u FROM pages),
h AS (SELECT DISTINCT regexp_extract(u, '^([a-z]+://[^/]*)', 1) AS place FROM p), g AS (SELECT place FROM h UNION SELECT DISTINCT regexp_extract(u, '^([a-z]+://[^/]*/[^/]+)', 1) FROM p WHERE page_id % 3 = 0 AND regexp_extract(u, '^([a-z]+://[^/]*/[^/]+)', 1) <> '')
SELECT page_id, place FROM (SELECT p.page_id, g.place, row_number() OVER (PARTITION BY p.page_id ORDER BY length(g.place) DESC) AS rn FROM p JOIN g ON p.u = g.place OR starts_with(p.u, g.place || '/')) WHERE rn = 1"""
)
def path_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakelens.functions.scalars import canonical_uri

    pages = read(spark, sf_dir, "pages").select("page_id", canonical_uri(F.regexp_replace("url", "[?#].*$", "")).alias("path"))
    hosts = pages.select(F.regexp_extract("path", "^([a-z]+://[^/]*)", 1).alias("place"))
    deep = pages.where("page_id % 3 = 0").select(F.regexp_extract("path", "^([a-z]+://[^/]*/[^/]+)", 1).alias("place")).where("place <> ''")
    return joins.path_authority(pages, hosts.union(deep).distinct()).select("page_id", "place")


# -- permissions ------------------------------------------------------------------------


@query(
    """WITH o AS (SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS id, NULL AS parent FROM region UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation
 UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR) FROM supplier),
a AS (WITH RECURSIVE w AS (SELECT id AS node, id AS anc FROM o UNION ALL SELECT w.node, o.parent FROM w JOIN o ON o.id = w.anc WHERE o.parent IS NOT NULL) SELECT * FROM w),
m AS (SELECT 'u' || CAST(c_custkey AS VARCHAR) AS u, 'g' || CAST(c_nationkey % 5 AS VARCHAR) AS g FROM customer WHERE c_custkey % 9 <> 0)
SELECT m.u AS principal_id, a.node AS object_id, 'SELECT' AS privilege, 'grant' AS source FROM m JOIN a ON a.anc = 'r' || substr(m.g, 2, 1)
UNION ALL SELECT 'g' || CAST(r_regionkey AS VARCHAR), a.node, 'SELECT', 'grant' FROM region JOIN a ON a.anc = 'r' || CAST(r_regionkey AS VARCHAR)
UNION ALL SELECT 'u' || CAST(n_nationkey AS VARCHAR), 'n' || CAST(n_nationkey AS VARCHAR), 'MANAGE', 'owner' FROM nation WHERE n_nationkey % 9 <> 0 AND n_nationkey > 0"""
)
def perm_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _permissions(spark, sf_dir, read(spark, sf_dir, "customer"))


def _permissions(spark: SparkSession, sf_dir: str, users: DataFrame) -> DataFrame:
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    objects = (
        read(spark, sf_dir, "region").select(tag("r", "r_regionkey").alias("object_id"), F.lit("CATALOG").alias("object_type"), none.alias("parent_object_id"), none.alias("owner_principal_id"))
        .union(read(spark, sf_dir, "nation").select(tag("n", "n_nationkey"), F.lit("SCHEMA"), tag("r", "n_regionkey"), tag("u", "n_nationkey")))
        .union(read(spark, sf_dir, "supplier").select(tag("s", "s_suppkey"), F.lit("TABLE"), tag("n", "s_nationkey"), none))
    )
    members = users.select(tag("u", "c_custkey").alias("child"), F.concat(F.lit("g"), (F.col("c_nationkey") % 5).cast("string")).alias("parent"))
    grants = read(spark, sf_dir, "region").select(tag("grant", "r_regionkey").alias("grant_id"), tag("r", "r_regionkey").alias("object_id"), tag("g", "r_regionkey").alias("principal_id"), F.lit("SELECT").alias("privilege"), F.lit(False).alias("grant_option"))
    state = F.when(F.col("c_custkey") % 9 == 0, "DISABLED").otherwise("ACTIVE")
    principals = users.select(tag("u", "c_custkey").alias("principal_id"), state.alias("lifecycle_state"), F.lit("USER").alias("principal_kind")).union(
        grants.select("principal_id", F.lit("ACTIVE"), F.lit("GROUP"))
    )
    out = joins.compile_permissions(objects, grants, members, principals)
    return out.select("principal_id", "object_id", "privilege", "source")


# -- dependency mappings -------------------------------------------------------------------


def _days(spark: SparkSession, sf_dir: str, table: str, column: str) -> DataFrame:
    return read(spark, sf_dir, table).select(F.date_format(column, "yyyy-MM-dd").alias("key")).distinct()


_DAYS = "SELECT DISTINCT strftime({1}, '%Y-%m-%d') AS key FROM {0}"
_ORDER_DAYS, _SHIP_DAYS = _DAYS.format("orders", "o_orderdate"), _DAYS.format("lineitem", "l_shipdate")


@query(f"SELECT d.key AS downstream_key, u.key AS upstream_key FROM ({_SHIP_DAYS}) d JOIN ({_ORDER_DAYS}) u ON u.key = d.key")
def dep_mapping_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.map_partitions(_days(spark, sf_dir, "lineitem", "l_shipdate"), _days(spark, sf_dir, "orders", "o_orderdate"), "identity")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS downstream_key, CAST(n_nationkey AS VARCHAR) AS upstream_key FROM region, nation")
def dep_mapping_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    down = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("key"))
    return joins.map_partitions(down, read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key")), "all")


@query(f"SELECT d.key AS downstream_key, max(u.key) AS upstream_key FROM ({_SHIP_DAYS}) d JOIN ({_ORDER_DAYS}) u ON u.key <= d.key GROUP BY d.key")
def dep_mapping_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.map_partitions(_days(spark, sf_dir, "lineitem", "l_shipdate"), _days(spark, sf_dir, "orders", "o_orderdate"), "latest")


@query(
    f"""SELECT d.key AS downstream_key, u.key AS upstream_key FROM ({_SHIP_DAYS}) d JOIN ({_ORDER_DAYS}) u
ON CAST(u.key AS DATE) BETWEEN CAST(d.key AS DATE) - 6 AND CAST(d.key AS DATE)"""
)
def dep_mapping_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.map_partitions(_days(spark, sf_dir, "lineitem", "l_shipdate"), _days(spark, sf_dir, "orders", "o_orderdate"), "window", -6, 0)


# -- checks -------------------------------------------------------------------------------


@query(
    """SELECT 'rows' AS name, CAST(count(*) AS DOUBLE) AS observed, count(*) BETWEEN 1 AND 1000000000 AS passed FROM orders
UNION ALL SELECT 'ids', CAST(count(*) FILTER (WHERE o_orderkey IS NULL) AS DOUBLE), count(*) FILTER (WHERE o_orderkey IS NULL) = 0 FROM orders
UNION ALL SELECT 'one per customer', CAST(count(*) AS DOUBLE), count(*) = 0 FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'key', CAST(count(*) AS DOUBLE), count(*) = 0 FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'no negative totals', CAST(count(*) AS DOUBLE), count(*) = 0 FROM orders WHERE o_totalprice < 0
UNION ALL SELECT 'fresh', date_diff('second', max(o_orderdate), TIMESTAMP '2001-09-01 00:00:00') / 3600.0, date_diff('second', max(o_orderdate), TIMESTAMP '2001-09-01 00:00:00') / 3600.0 <= 1000 FROM orders"""
)
def checks_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo = [
        checks.RowCount("rows", minimum=1, maximum=10**9), checks.NotNull("ids", columns=("o_orderkey",)), checks.Unique("one per customer", columns=("o_custkey",)),
        checks.Unique("key", columns=("o_orderkey",)), checks.CustomSql("no negative totals", sql="SELECT count(*) FROM {table} WHERE o_totalprice < 0"),
        checks.Freshness("fresh", column="o_orderdate", max_age_hours=1000),
    ]
    return checks.run_checks(read(spark, sf_dir, "orders"), todo, now="2001-09-01 00:00:00").select("name", "observed", "passed")


# -- folds ----------------------------------------------------------------------------------


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of runs: each order is triggered and planned with a chain of its lines as
    tasks; every task starts and finishes, line 3 of returned orders without success."""
    line = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("l_linenumber")).alias("n"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("bad")
    )
    run = F.col("l_orderkey").cast("string")
    task = "named_struct('key', concat('t', x), 'depends_on', if(i = 0, array(), array(concat('t', n[i - 1]))), 'max_attempts', 1)"
    plan = F.to_json(F.struct(F.expr(f"transform(n, (x, i) -> {task})").alias("tasks")))
    head = F.array(
        F.struct(F.lit("0000").alias("o"), F.lit("RunTriggered").alias("event_type"), F.lit('{"plan_id":"p"}').alias("payload")),
        F.struct(F.lit("0001").alias("o"), F.lit("PlanCreated").alias("event_type"), plan.alias("payload")),
    )
    ids = "'task_key', concat('t', x), 'attempt', 1, 'attempt_id', concat('a', x)"
    done = f"to_json(named_struct({ids}, 'outcome', if(x = bad, 'FAILED', 'SUCCEEDED'), 'retryable', false))"
    steps = F.expr(
        f"flatten(transform(n, x -> array(struct(lpad(string(2 * x + 2), 4, '0') as o, 'TaskStarted' as event_type, to_json(named_struct({ids})) as payload),"
        f" struct(lpad(string(2 * x + 3), 4, '0') as o, 'TaskFinished' as event_type, {done} as payload))))"
    )
    each = line.select(run.alias("run_id"), F.explode(F.concat(head, steps)).alias("e"))
    event_id = F.concat(F.lpad("run_id", 10, "0"), F.col("e.o"))
    return each.select("run_id", event_id.alias("event_id"), "e.event_type", event_id.alias("idempotency_key"), F.lit(_NOW).alias("ts"), "e.payload")


@query(
    """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS x, max(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS bad FROM lineitem),
d AS (SELECT DISTINCT k, x, bad FROM l)
SELECT CAST(k AS VARCHAR) AS run_id, CASE WHEN bad IS NULL THEN 'SUCCEEDED' ELSE 'FAILED' END AS state, count(*) AS tasks_total,
count(*) FILTER (WHERE bad IS NULL OR x < bad) AS tasks_succeeded, count(*) FILTER (WHERE x = bad) AS tasks_failed, count(*) FILTER (WHERE x > bad) AS tasks_skipped
FROM d GROUP BY k, bad"""
)
def fold_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = fold.fold_events(_ledger(spark, sf_dir), "run_id", only=("run",))
    schema = "state string, tasks_total long, tasks_succeeded long, tasks_failed long, tasks_skipped long"
    return fold.entity(folded, "run", schema, "run_id")
