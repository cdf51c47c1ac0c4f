"""State tables, merges, aggregates and functions over the synthetic tables.

The tables stand in for metadata: ``events`` for a ledger, orders and their lines
for runs and their tasks, nations for schedules and tenants, parts for a task
graph (part p depends on p div 2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.functions import scalars as S
from lakelens.operators import aggregates, graph, joins, merge, windows
from lakelens.operators.search import postings
from lakelens.queries import query, read


# -- search ----------------------------------------------------------------------


@query(
    """SELECT lower(t) AS token_norm, count(*) AS n FROM (
  SELECT unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]')) AS t FROM documents) WHERE length(t) >= 2 GROUP BY 1"""
)
def search_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = postings(docs, "doc_id", {"text": 0.5}, "document")
    return found.groupBy("token_norm").agg(F.count("*").alias("n"))


# -- merges ----------------------------------------------------------------------

_RANKS = "CASE event_type WHEN 'signup' THEN 'PLANNED' WHEN 'view' THEN 'READY' WHEN 'click' THEN 'RUNNING' WHEN 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END"


def _layers(events: DataFrame) -> DataFrame:
    """Even events as a base, odd ones in three deltas; coarse versions make ties."""
    return events.select(
        "user_id",
        "event_type",
        "event_id",
        F.expr(_RANKS).alias("state"),
        F.lpad((F.col("event_id") / 50).cast("long").cast("string"), 12, "0").alias("row_version"),
        F.when(F.col("event_id") % 2 == 0, 0).otherwise(1 + F.col("event_id") % 3).cast("long").alias("delta_ordinal"),
    )


_LAYERS_SQL = f"""SELECT user_id, event_type, event_id, {_RANKS} AS state, CASE {_RANKS} WHEN 'PLANNED' THEN 0 WHEN 'READY' THEN 2 WHEN 'RUNNING' THEN 4
  WHEN 'FAILED' THEN 12 ELSE 13 END AS rk, lpad(CAST(event_id // 50 AS VARCHAR), 12, '0') AS row_version,
  CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 + event_id % 3 END AS delta_ordinal FROM events"""


@query(
    f"""SELECT user_id, row_version, state FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY row_version DESC, rk DESC, delta_ordinal DESC) AS rn FROM ({_LAYERS_SQL})) WHERE rn = 1"""
)
def latest_wins_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _layers(read(spark, sf_dir, "events"))
    return merge.merge_layers(rows, ["user_id"], "tasks").select("user_id", "row_version", "state")


@query(
    f"""WITH l AS ({_LAYERS_SQL}), gone AS (SELECT user_id, max(delta_ordinal) AS o FROM l WHERE event_type = 'error' GROUP BY user_id)
SELECT user_id, row_version, delta FROM (SELECT l.user_id, l.row_version, l.delta_ordinal AS delta, row_number() OVER (PARTITION BY l.user_id
  ORDER BY l.row_version DESC, l.delta_ordinal DESC, l.event_id DESC) AS rn
  FROM l LEFT JOIN gone g ON g.user_id = l.user_id WHERE l.event_type <> 'error' AND (g.o IS NULL OR l.delta_ordinal > g.o)) WHERE rn = 1"""
)
def merge_with_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _layers(read(spark, sf_dir, "events"))
    gone = rows.where("event_type = 'error'").select("user_id", "delta_ordinal")
    live = rows.where("event_type <> 'error'").withColumn("delta", F.col("delta_ordinal"))
    return merge.merge_layers(live, ["user_id"], "", gone).select("user_id", "row_version", "delta")


@query(
    """SELECT user_id, k, min(event_id) AS event_id FROM (
  SELECT user_id, json_extract_string(props, '$.k') AS k, event_id FROM events) GROUP BY user_id, k"""
)
def idempotent_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").alias("k"), "event_id")
    return merge.first_write(events, ["user_id", "k"], ["event_id"])


@query(
    """SELECT CASE WHEN event_id > 6000 THEN 'process' ELSE 'late' END AS kind, event_type, count(*) AS n FROM events
WHERE event_id > 6000 OR ts > TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1, 2"""
)
def watermark_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    now, late = merge.split_late(read(spark, sf_dir, "events"), 6000, datetime.datetime(2024, 1, 15), "quarantine")
    both = now.withColumn("kind", F.lit("process")).union(late.withColumn("kind", F.lit("late")))
    return both.groupBy("kind", "event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type FROM events WHERE event_id > 4000")
def watermark_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.rebuild(read(spark, sf_dir, "events"), processed=4000).select("event_id", "event_type")


@query(
    """WITH a AS (SELECT o_custkey, sum(o_orderkey) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1),
b AS (SELECT o_custkey, sum(o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CAST(b.v AS BIGINT) AS v, CASE WHEN b.o_custkey IS NULL THEN 'DELETE' ELSE 'UPSERT' END AS change
FROM a FULL OUTER JOIN b ON a.o_custkey = b.o_custkey WHERE a.v IS DISTINCT FROM b.v"""
)
def state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    sums = lambda df: df.groupBy("o_custkey").agg(F.sum("o_orderkey").alias("v"))
    old = sums(orders.where("o_orderdate < timestamp_ntz '1999-01-01'"))
    new = sums(orders.where("o_orderstatus <> 'F'"))
    return merge.state_diff(old, new, ["o_custkey"]).withColumnRenamed("_change", "change")


@query(
    """SELECT count(*) AS deltas, CAST(sum(c) AS BIGINT) AS changes, count(*) >= 10 OR sum(c) >= 100000 AS due
FROM (SELECT count(*) AS c FROM events GROUP BY user_id)"""
)
def compaction_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("rows"))
    deltas = deltas.withColumn("deletions", F.lit(0)).withColumn("created_at", F.lit(0))
    return merge.compaction_due(deltas, 0).select("deltas", "changes", "due")


@query(
    """WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 11 END AS seq FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM e),
f AS (WITH RECURSIVE w AS (SELECT user_id, n, event_id, seq FROM r WHERE n = 1
  UNION ALL SELECT r.user_id, r.n, CASE WHEN w.seq IS NULL OR (r.seq IS NOT NULL AND r.seq >= w.seq) THEN r.event_id ELSE w.event_id END,
  CASE WHEN w.seq IS NULL OR (r.seq IS NOT NULL AND r.seq >= w.seq) THEN r.seq ELSE w.seq END FROM w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1)
  SELECT * FROM w)
SELECT f.user_id, f.event_id, f.seq FROM f JOIN (SELECT user_id, max(n) AS n FROM r GROUP BY user_id) m ON m.user_id = f.user_id AND m.n = f.n"""
)
def sequence_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(
        "event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("event_id") % 11).alias("seq")
    )
    return merge.upsert_by_sequence(events, "user_id", "seq").select("user_id", "event_id", F.col("seq").cast("long").alias("seq"))


@query(
    """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'conflict' ELSE 'fresh' END AS kind FROM events
WHERE event_id % 10 = 0 AND event_id < 5000 OR event_id >= 5000 AND NOT event_id % 10 = 0 OR event_id >= 5000 AND event_id % 10 = 0 AND false"""
)
def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("payload"))
    ledger = events.where("event_id < 5000")
    incoming = events.withColumn("payload", F.when(F.expr("event_id % 10 = 0 and event_id < 5000"), "other").otherwise(F.col("payload")))
    incoming = incoming.where("not (event_id >= 5000 and event_id % 10 = 0)")
    fresh, conflicts = merge.append_once(ledger, incoming)
    named = lambda df, k: df.select("event_id", F.lit(k).alias("kind"))
    return named(fresh, "fresh").union(named(conflicts, "conflict"))


# -- runs and tasks ----------------------------------------------------------------

_STATE = "CASE l_returnflag WHEN 'A' THEN 'SUCCEEDED' WHEN 'R' THEN CASE l_linestatus WHEN 'F' THEN 'FAILED' ELSE 'CANCELLED' END ELSE CASE l_linestatus WHEN 'O' THEN 'RUNNING' ELSE 'SKIPPED' END END"


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")).alias("task_key"),
        F.expr(_STATE).alias("state"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("completed_at"),
        (F.col("l_suppkey") % 3 == 0).alias("requires_visible_output"),
        F.expr("CASE WHEN l_linenumber % 3 = 0 THEN 'VISIBLE' WHEN l_linenumber % 3 = 1 THEN 'FAILED' END").alias("output_visibility_state"),
    )


_COUNTS = f"""SELECT l_orderkey AS run_id, count(*) AS tasks_total, count(*) FILTER (WHERE s <> 'RUNNING') AS tasks_completed,
count(*) FILTER (WHERE s = 'SUCCEEDED') AS tasks_succeeded, count(*) FILTER (WHERE s = 'FAILED') AS tasks_failed,
count(*) FILTER (WHERE s = 'SKIPPED') AS tasks_skipped, count(*) FILTER (WHERE s = 'CANCELLED') AS tasks_cancelled
FROM (SELECT *, {_STATE} AS s FROM lineitem) GROUP BY l_orderkey"""


@query(_COUNTS)
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.run_counters(_tasks(spark, sf_dir)).drop("state", "completed_at")


@query(
    f"""SELECT state, count(*) AS runs FROM (SELECT CASE WHEN tasks_completed < tasks_total THEN 'RUNNING' WHEN tasks_cancelled > 0 THEN 'CANCELLED'
WHEN tasks_failed > 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS state FROM ({_COUNTS})) GROUP BY state"""
)
def run_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.run_counters(_tasks(spark, sf_dir)).groupBy("state").agg(F.count("*").alias("runs"))


@query(
    f"""WITH t AS (SELECT l_orderkey AS run_id, {_STATE} AS s, l_suppkey % 3 = 0 AS req,
  CASE WHEN l_linenumber % 3 = 0 THEN 'VISIBLE' WHEN l_linenumber % 3 = 1 THEN 'FAILED' ELSE 'PENDING' END AS v FROM lineitem),
c AS ({_COUNTS}), r AS (SELECT run_id, CASE WHEN tasks_completed < tasks_total THEN 'RUNNING' WHEN tasks_cancelled > 0 THEN 'CANCELLED'
  WHEN tasks_failed > 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS state, run_id % 5 = 0 AS cancel FROM c),
o AS (SELECT run_id, bool_or(req AND s = 'SUCCEEDED' AND v = 'FAILED') AS f, bool_or(req AND s = 'SUCCEEDED' AND v = 'PENDING') AS p FROM t GROUP BY run_id)
SELECT r.run_id, CASE WHEN cancel AND state = 'RUNNING' THEN 'CANCELLING' WHEN state = 'CANCELLED' THEN 'CANCELLED' WHEN state = 'FAILED' OR f THEN 'FAILED'
  WHEN state = 'SUCCEEDED' AND p THEN 'RUNNING' ELSE state END AS public_state FROM r JOIN o ON o.run_id = r.run_id"""
)
def public_run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _tasks(spark, sf_dir)
    runs = aggregates.run_counters(tasks).withColumn("cancel_requested", F.col("run_id") % 5 == 0)
    return aggregates.public_run_state(runs, tasks).select("run_id", "public_state")


@query(
    f"""SELECT o_orderkey AS run_id, count(l.s) FILTER (WHERE l.s = 'RUNNING') AS running FROM orders
LEFT JOIN (SELECT l_orderkey, {_STATE} AS s FROM lineitem) l ON l.l_orderkey = o_orderkey GROUP BY 1"""
)
def task_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"))
    return aggregates.public_task_counts(runs, _tasks(spark, sf_dir)).select("run_id", "running")


@query(
    """SELECT l_partkey AS task_key, cause, why FROM (SELECT l_partkey, l_suppkey AS cause, l_returnflag AS why, row_number() OVER (PARTITION BY l_partkey
  ORDER BY epoch_ms(l_shipdate), lpad(CAST(l_suppkey AS VARCHAR), 9, '0'), lpad(CAST(l_orderkey AS VARCHAR), 12, '0')) AS rn FROM lineitem WHERE l_returnflag <> 'A') WHERE rn = 1"""
)
def skip_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    edges = line.select(
        F.lit("r").alias("run_id"),
        F.lpad(F.col("l_suppkey").cast("string"), 9, "0").alias("upstream_task_key"),
        F.col("l_partkey").alias("downstream_task_key"),
        F.when(F.col("l_returnflag") == "A", "SUCCESS").otherwise(F.col("l_returnflag")).alias("resolution"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("satisfied_at"),
        F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("row_version"),
    )
    tasks = line.select(F.lit("r").alias("run_id"), F.col("l_partkey").alias("task_key"), F.lit("SKIPPED").alias("state")).distinct()
    out = aggregates.skip_causes(edges, tasks)
    return out.select("task_key", F.col("cause").cast("long").alias("cause"), F.col("cause_resolution").alias("why"))


@query(
    """SELECT c_custkey AS asset_key, count(*) AS total, count(o_orderkey) AS materialized, count(*) FILTER (WHERE o_orderstatus = 'F') AS stale,
count(*) - count(o_orderkey) AS missing FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""
)
def partition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    parts = rows.select(
        F.col("c_custkey").alias("asset_key"),
        F.col("o_orderkey").alias("last_materialization_run_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit(1)).alias("stale_since"),
    )
    return aggregates.partition_summary(parts)


@query(
    """SELECT event_type, value AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn,
count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE rn = CAST(ceil(0.95 * n) AS BIGINT)"""
)
def p95_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(aggregates.nearest_rank("value").alias("p95"))


@query(
    """SELECT o_orderkey, greatest(0, epoch_ms(min(l_shipdate)) - epoch_ms(o_orderdate)) / 1000 AS latency_s FROM orders
JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate HAVING greatest(0, epoch_ms(min(l_shipdate)) - epoch_ms(o_orderdate)) / 1000 > 864000"""
)
def latency_slo(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    index = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), ms("o_orderdate").alias("created_at"))
    runs = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.min(ms("l_shipdate")).alias("triggered_at"))
    late = aggregates.slo_breaches(aggregates.trigger_latency(index, runs), 864000)
    return late.select(F.col("run_id").alias("o_orderkey"), "latency_s")


@query("SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus IN ('O')) AS pending, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed FROM orders GROUP BY o_custkey")
def backfill_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "PLANNED").when(F.col("o_orderstatus") == "F", "FAILED").otherwise("SUCCEEDED")
    chunks = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("backfill_id"), state.alias("state"))
    return aggregates.chunk_counts(chunks).select(F.col("backfill_id").alias("o_custkey"), "total", "pending", "failed")


# -- ordering ----------------------------------------------------------------------


@query(
    """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01' OR (o_orderdate = TIMESTAMP '1998-06-01' AND o_orderkey > 100)
ORDER BY o_orderdate DESC, o_orderkey LIMIT 51"""
)
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return windows.keyset_page(orders, [("o_orderdate", False), ("o_orderkey", True)], [datetime.datetime(1998, 6, 1), 100], 50)


@query(
    """SELECT s_suppkey, s_nationkey, CAST(row_number() OVER (ORDER BY k // w, (w - k % w) DESC, s_nationkey) AS INTEGER) AS fair_rank FROM (
  SELECT s_suppkey, s_nationkey, 1 + s_nationkey % 3 AS w, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS k FROM supplier)
QUALIFY fair_rank <= 40"""
)
def fair_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (1 + F.col("s_nationkey") % 3).alias("w"))
    return windows.fair_select(tasks, "s_nationkey", "w", ["s_suppkey"], 40).drop("w")


@query(
    """SELECT chunk_index, substr(sha256(string_agg(d || '|', '' ORDER BY d)), 1, 32) AS request_fingerprint, count(*) AS n FROM (
  SELECT d, CAST((row_number() OVER (ORDER BY d) - 1) // 10 AS INTEGER) AS chunk_index FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders))
GROUP BY chunk_index"""
)
def backfill_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).distinct()
    cut = windows.chunks(days.withColumn("g", F.lit(1)), "d", 10, ["g"])
    return cut.select("chunk_index", S.request_fingerprint("keys").alias("request_fingerprint"), F.size("keys").cast("long").alias("n"))


@query(
    """SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn > 10"""
)
def gc_keep_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.keep_last(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 10)


@query(
    """SELECT l_suppkey, count(*) FILTER (WHERE l_linenumber = rn) AS prefix FROM (SELECT l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber) AS rn
  FROM (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem)) GROUP BY l_suppkey"""
)
def contiguous_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_linenumber") - 1).alias("i"))
    return windows.contiguous_prefix(rows, "l_suppkey", "i")


@query(
    """SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS s, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)
WHERE rn <= 50 AND (s <= 60000 OR rn = 1)"""
)
def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return windows.budget_page(docs, "doc_id", "n_chars", 60000).select("doc_id", "n_chars")


# -- graphs --------------------------------------------------------------------------


def _part_edges(spark: SparkSession, sf_dir: str, least: int = 1) -> DataFrame:
    """Part p waits for p div 2."""
    p = F.col("p_partkey")
    return read(spark, sf_dir, "part").where(p > least).select(F.floor(p / 2).cast("long").alias("src"), p.alias("dst"))


@query(
    """WITH RECURSIVE e AS (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey > 1),
w AS (SELECT CAST(3 AS BIGINT) AS node, 0 AS depth UNION ALL SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node)
SELECT node, min(depth) AS depth FROM w GROUP BY node"""
)
def lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = spark.range(3, 4).toDF("node")
    return graph.closure(_part_edges(spark, sf_dir), roots)


@query(
    """SELECT n_nationkey AS table_id, 'upstream' AS direction, n_regionkey AS neighbour FROM nation
UNION ALL SELECT n.n_nationkey, 'downstream', 10000 + s_suppkey FROM nation n JOIN supplier ON s_nationkey = n.n_nationkey"""
)
def lineage_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all nations; suppliers' ids are apart from nations' at any size."""
    nation, tag = read(spark, sf_dir, "nation"), (1000 + F.col("n_nationkey")).cast("long")
    n = nation.select(F.col("n_regionkey").cast("long").alias("source_id"), tag.alias("target_id"))
    s = read(spark, sf_dir, "supplier").select((1000 + F.col("s_nationkey")).cast("long").alias("source_id"), (10000 + F.col("s_suppkey")).alias("target_id"))
    out = joins.lineage_neighbours(n.union(s).withColumn("edge_type", F.lit("derives")), nation.select(tag.alias("table_id")))
    return out.select((F.col("table_id") - 1000).cast("int").alias("table_id"), "direction", "neighbour")


@query("SELECT p_partkey AS node, CAST(floor(log2(p_partkey)) AS INTEGER) AS stage FROM part WHERE p_partkey >= 1")
def stage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = read(spark, sf_dir, "part").where("p_partkey >= 1").select(F.col("p_partkey").alias("node"))
    return graph.stage_levels(nodes, _part_edges(spark, sf_dir))


@query(
    """WITH RECURSIVE e AS (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey > 1),
s AS (SELECT p_partkey AS node, CASE WHEN p_partkey IN (5, 6) THEN 'FAILED' WHEN p_size % 10 = 3 THEN 'SUCCEEDED' ELSE 'BLOCKED' END AS state FROM part WHERE p_partkey >= 1),
w AS (SELECT CAST(5 AS BIGINT) AS node UNION ALL SELECT CAST(6 AS BIGINT) UNION ALL SELECT e.dst FROM w JOIN e ON e.src = w.node JOIN s ON s.node = e.dst AND s.state = 'BLOCKED')
SELECT s.node, CASE WHEN s.state = 'BLOCKED' AND s.node IN (SELECT node FROM w) THEN 'SKIPPED' ELSE s.state END AS state FROM s"""
)
def fail_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    state = F.when(p.isin(5, 6), "FAILED").when(F.col("p_size") % 10 == 3, "SUCCEEDED").otherwise("BLOCKED")
    tasks = read(spark, sf_dir, "part").where("p_partkey >= 1").select(p.alias("node"), state.alias("state"))
    failed = spark.range(5, 7).toDF("node").withColumn("resolution", F.lit("FAILED"))
    return graph.propagate_failures(tasks, _part_edges(spark, sf_dir), failed)[0]


@query(
    """SELECT p_partkey AS node, CASE WHEN p_partkey > 1 AND (p_partkey // 2) % 4 <> 0 AND p_partkey // 2 >= 1 THEN [p_partkey // 2] ELSE [] END AS depends_on
FROM part WHERE p_partkey >= 1 AND p_partkey % 4 <> 0"""
)
def task_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = read(spark, sf_dir, "part").where("p_partkey >= 1 and p_partkey % 4 <> 0").select(F.col("p_partkey").alias("node"))
    edges = _part_edges(spark, sf_dir).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    out = graph.task_definitions(planned.select(F.col("node").cast("string").alias("node")), edges)
    return out.select(F.col("node").cast("long").alias("node"), F.col("depends_on").cast("array<bigint>").alias("depends_on"))


@query(
    f"""SELECT l_orderkey AS node, count(*) AS deps_total, count(*) FILTER (WHERE s = 'SUCCEEDED') AS deps_satisfied, count(*) = count(*) FILTER (WHERE s = 'SUCCEEDED') AS ready
FROM (SELECT l_orderkey, {_STATE} AS s FROM lineitem) GROUP BY l_orderkey"""
)
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _tasks(spark, sf_dir).select(F.col("run_id").alias("dst"), (F.col("state") == "SUCCEEDED").alias("satisfied"))
    return graph.readiness(edges)


# -- functions -------------------------------------------------------------------------


@query(
    """SELECT n_nationkey, sha256(CAST('edge-v1' AS BLOB) || unhex(lpad(hex(strlen(r_name)), 16, '0')) || CAST(r_name AS BLOB)
 || unhex(lpad(hex(strlen(n_name)), 16, '0')) || CAST(n_name AS BLOB) || unhex(lpad(hex(7), 16, '0')) || CAST('derives' AS BLOB) || unhex('00')) AS id
FROM nation JOIN region ON r_regionkey = n_regionkey"""
)
def edge_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return both.select("n_nationkey", S.edge_id("edge-v1", "r_name", "n_name", F.lit("derives"), F.lit(None).cast("string")).alias("id"))


@query(
    """SELECT o_orderkey, 'date=d:' || strftime(o_orderdate, '%Y-%m-%d') || ',num=i:' || CAST(o_custkey AS VARCHAR) || ',status=s:'
|| translate(rtrim(to_base64(CAST(o_orderpriority AS BLOB)), '='), '+/', '-_') AS pkey,
sha256('date=d:' || strftime(o_orderdate, '%Y-%m-%d') || ',num=i:' || CAST(o_custkey AS VARCHAR) || ',status=s:'
|| translate(rtrim(to_base64(CAST(o_orderpriority AS BLOB)), '='), '+/', '-_')) AS fingerprint FROM orders"""
)
def canonical_partition_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = S.partition_key({"status": S.scalar_string("o_orderpriority"), "date": S.scalar_date("o_orderdate"), "num": S.scalar_int("o_custkey")})
    return read(spark, sf_dir, "orders").select("o_orderkey", key.alias("pkey"), S.fingerprint(key).alias("fingerprint"))


@query(
    """SELECT s, CASE WHEN instr(s, '/') > 0 THEN nullif(substr(s, 1, instr(s, '/') - 1), '') WHEN instr(s, '.') > 0 THEN nullif(substr(s, 1, instr(s, '.') - 1), '') END AS ns,
CASE WHEN instr(s, '/') > 0 THEN nullif(substr(s, instr(s, '/') + 1), '') WHEN instr(s, '.') > 0 THEN nullif(substr(s, instr(s, '.') + 1), '') ELSE nullif(s, '') END AS tbl
FROM (SELECT CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN n_name || '.' || CAST(n_regionkey AS VARCHAR) WHEN 2 THEN 'a.b/' || n_name ELSE '.' || n_name END AS s FROM nation)"""
)
def asset_key_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.expr("CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN n_name || '.' || CAST(n_regionkey AS STRING) WHEN 2 THEN 'a.b/' || n_name ELSE '.' || n_name END")
    rows = read(spark, sf_dir, "nation").select(s.alias("s"))
    part = S.asset_namespace_table("s")
    return rows.select("s", part["namespace"].alias("ns"), part["table"].alias("tbl"))


@query(
    """SELECT o_orderkey, least(900, 30 * CAST(power(2, least(greatest(a - 1, 0), 6)) AS BIGINT)) AS backoff_s FROM (SELECT o_orderkey, o_custkey % 12 AS a FROM orders)"""
)
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", S.retry_backoff_seconds(F.col("o_custkey") % 12).alias("backoff_s"))


@query(
    """SELECT o_orderkey, 'att_' || substr(sha256('dispatch:' || CAST(o_custkey AS VARCHAR) || ':' || o_orderstatus || ':1'), 1, 24) AS attempt_id,
'dispatch:' || CAST(o_custkey AS VARCHAR) || ':' || o_orderstatus || ':1' AS dispatch_id FROM orders"""
)
def dispatch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = (F.col("o_custkey").cast("string"), F.col("o_orderstatus"), F.lit(1))
    return read(spark, sf_dir, "orders").select("o_orderkey", S.attempt_id(*args).alias("attempt_id"), S.dispatch_id(*args).alias("dispatch_id"))


@query(
    """SELECT event_id, greatest(lag, 0) AS lag, CASE WHEN greatest(lag, 0) >= 5000 THEN 'REJECT' WHEN greatest(lag, 0) >= 1000 THEN 'WARN' ELSE 'ACCEPT' END AS decision,
CASE WHEN greatest(lag, 0) >= 5000 THEN least(60, 5 + (lag - 5000) // 5000) END AS retry_after_s FROM (SELECT event_id, event_id * 3 - 2000 AS lag FROM events)"""
)
def backpressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.backpressure(F.col("event_id") * 3, F.lit(2000), 1000, 5000)
    return read(spark, sf_dir, "events").select("event_id", d["lag"].alias("lag"), d["decision"].alias("decision"), d["retry_after_s"].alias("retry_after_s"))


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%Y-%m') AS m, strftime(o_orderdate, '%Y-%m-%dT%H:00:00Z') AS h,
strftime(make_timestamp(epoch_ms(o_orderdate) * 1000), '%Y-%m-%dT%H:%M:%S.000Z') AS iso,
CAST(abs(date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE))) + 1 AS INTEGER) AS days FROM orders"""
)
def time_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        S.time_dimension(d, "year").alias("y"),
        S.time_dimension(d, "month").alias("m"),
        S.time_dimension(d, "hour").alias("h"),
        S.rfc3339(F.unix_millis(d.cast("timestamp"))).alias("iso"),
        S.inclusive_days(F.lit("1998-01-01").cast("date"), d.cast("date")).alias("days"),
    )


@query(
    """SELECT p_partkey, gcd(p_partkey, p_size) AS g, lcm(p_partkey, p_size) AS l FROM part WHERE p_size > 0"""
)
def gcd_lcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").where("p_size > 0")
    return rows.select("p_partkey", S.gcd("p_partkey", "p_size").alias("g"), S.lcm("p_partkey", "p_size").alias("l"))
