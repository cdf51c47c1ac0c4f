"""Lists, permissions, catalogs and text functions over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.functions import scalars as S
from lakelens.operators import joins, listing, merge, rules
from lakelens.queries import query, read


@query(
    """SELECT CASE WHEN n_regionkey % 2 = 0 THEN 'c0' ELSE 'default' END AS catalog_name, r_name AS namespace_name, n_name AS table_name, s.cols AS columns FROM nation
JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT s_nationkey, list(s_name ORDER BY s_suppkey, s_name) AS cols FROM supplier GROUP BY 1) s ON s.s_nationkey = n_nationkey"""
)
def catalog_read_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    cats = spark.createDataFrame([("a", "c0"), ("b", "default")], "id string, name string")
    r = read(spark, sf_dir, "region")
    ns = r.select(F.col("r_regionkey").cast("string").alias("id"), F.when(F.col("r_regionkey") % 2 == 0, "a").alias("catalog_id"), F.col("r_name").alias("name"), F.lit(0).alias("created_at"))
    again = ns.select(F.concat("id", F.lit("x")).alias("id"), "catalog_id", "name", F.lit(1).alias("created_at"))  # later namesakes do not count
    n = read(spark, sf_dir, "nation")
    tables = n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_regionkey").cast("string").alias("namespace_id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("format"))
    hidden = tables.select(F.concat("id", F.lit("x")).alias("id"), F.concat("namespace_id", F.lit("x")).alias("namespace_id"), "name", "location", "format")
    cols = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("table_id"), F.col("s_suppkey").alias("ordinal"), F.col("s_name").alias("name"))
    out = joins.read_model(cats, ns.union(again), tables.union(hidden), cols)
    return out.select("catalog_name", "namespace_name", "table_name", "columns")


@query(
    """WITH can AS (SELECT s_suppkey AS p, s_nationkey AS o, CASE WHEN s_suppkey % 5 = 0 THEN 'MANAGE' ELSE 'SELECT' END AS priv FROM supplier)
SELECT s.s_suppkey AS principal_id, s.s_nationkey AS object_id, w.priv AS privilege, CASE WHEN s.s_suppkey % 5 = 0 OR w.priv = 'SELECT' THEN 'allowed' ELSE 'absence_of_allow' END AS reason
FROM supplier s, (SELECT 'SELECT' AS priv UNION ALL SELECT 'MODIFY') w"""
)
def perm_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("principal_id"), F.col("s_nationkey").alias("object_id"), F.lit("TABLE").alias("object_type"))
    compiled = s.withColumn("privilege", F.when(F.col("principal_id") % 5 == 0, "MANAGE").otherwise("SELECT"))
    asked = s.withColumn("privilege", F.explode(F.array(F.lit("SELECT"), F.lit("MODIFY"))))
    return joins.decide(asked, compiled).select("principal_id", "object_id", "privilege", "reason")


@query(
    """SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1"""
)
def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return listing.distinct_on(o, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")])


@query(
    """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-01-01'"""
)
def list_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    runs = read(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "state")
    times = ("o_orderdate", datetime.datetime(1996, 1, 1), datetime.datetime(1997, 1, 1))
    return listing.select_rows(runs, "runs", state="F", times=times).select("o_orderkey", F.col("state").alias("o_orderstatus"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_custkey, o_orderkey LIMIT 25")
def ready_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "READY").otherwise("RUNNING")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", state.alias("state"), F.col("o_custkey").alias("priority"), F.col("o_orderkey").alias("position"), F.lit("t").alias("task_key"))
    return listing.ready_list(o, 25).select("o_orderkey", "o_custkey")


@query(
    """SELECT user_id AS schedule_id, arg_max(event_type, event_id) AS cron_expression, min(event_id) AS created_at, max(event_id) AS row_version FROM (
SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2) GROUP BY user_id"""
)
def schedule_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("schedule_id"), "event_id", F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("idempotency_key"),
        F.col("event_type").alias("cron_expression"), F.col("event_id").alias("ts"),
    )
    return listing.schedule_definitions(e).select("schedule_id", "cron_expression", "created_at", "row_version")


@query("SELECT user_id AS schedule_id, arg_max(event_type, event_id) AS last_tick_id, max(event_id) AS row_version FROM events GROUP BY user_id")
def schedule_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "events").select(F.col("user_id").alias("schedule_id"), F.col("event_type").alias("tick_id"), "event_id", F.col("event_id").alias("scheduled_for"), F.lit("k").alias("run_key"))
    return listing.schedule_state(t)[0].select("schedule_id", "last_tick_id", "row_version")


@query(
    """SELECT n_nationkey AS domain, t.issue_type FROM nation, (SELECT 'missing_manifest' AS issue_type UNION ALL SELECT 'missing_current_head_legacy_mirror' UNION ALL SELECT 'stale_current_head_legacy_mirror'
 UNION ALL SELECT 'missing_current_head_commit_record') t WHERE t.issue_type = 'missing_manifest' AND n_nationkey % 4 = 0 OR n_nationkey % 4 <> 0 AND (
 t.issue_type = 'missing_current_head_legacy_mirror' AND n_nationkey % 3 = 0 OR t.issue_type = 'stale_current_head_legacy_mirror' AND n_nationkey % 3 = 1
 OR t.issue_type = 'missing_current_head_commit_record' AND n_nationkey % 2 = 0)"""
)
def head_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    mirror = F.when(n % 3 == 1, 4).when(n % 3 == 2, 5)
    heads = read(spark, sf_dir, "nation").select(n.alias("domain"), (n % 4 != 0).alias("has_manifest"), F.lit(5).alias("version"), mirror.alias("mirror_version"), (n % 2 != 0).alias("has_commit_record"))
    return listing.head_issues(heads).select("domain", "issue_type")


@query(
    """WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]')) AS x FROM documents WHERE doc_id % 7 <> 3)
SELECT doc_id, count(*) AS n FROM t WHERE length(x) >= 2 GROUP BY doc_id"""
)
def live_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakelens.operators.search import postings

    docs = read(spark, sf_dir, "documents")
    found = postings(docs, "doc_id", {"text": 1.0}, "document")
    changes = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_id") % 7 == 3, "deleted").otherwise("created").alias("change"), F.lit(0).alias("at"))
    gone = listing.tombstones(changes, 1000)
    return rules.live_postings(found, gone, 1000).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages), q AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(u, '^[A-Za-z]+://([^/]*)', 1)) AS host,
 regexp_replace(regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/]*(.*)$', 1), '/+', '/', 'g'), '/$', '') AS path FROM p) SELECT page_id, host || path AS uri FROM q"""
)
def canonical_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", S.canonical_uri(F.regexp_replace("url", "[?#].*$", "")).alias("uri"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders"""
)
def partition_key_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = S.partition_key({"d": S.scalar_date("o_orderdate"), "p": S.scalar_string("o_orderpriority")})
    broken = F.when(F.col("o_orderkey") % 4 == 0, F.concat(key, F.lit(",Bad=x"))).otherwise(key)
    rows = read(spark, sf_dir, "orders").select("o_orderkey", S.parse_partition_key(broken).alias("m"))
    return rows.select("o_orderkey", S.decode_scalar(F.col("m")["d"]).alias("day"), S.decode_scalar(F.col("m")["p"]).alias("priority"))


@query(
    """SELECT s, s[6:7] <= '12' AND s[6:7] >= '01' AND s[9:10] >= '01' AND s[1:4] >= '1970' AND s[9:10] <= CASE WHEN s[6:7] IN ('04', '06', '09', '11') THEN '30' WHEN s[6:7] = '02' THEN '29' ELSE '31' END AS ok
FROM (SELECT DISTINCT CAST(1960 + p_partkey % 30 AS VARCHAR) || '-' || lpad(CAST(p_partkey % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(p_partkey % 33 AS VARCHAR), 2, '0') AS s FROM part)"""
)
def date_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    s = F.concat_ws("-", (1960 + p % 30).cast("string"), pad(p % 14), pad(p % 33))
    return read(spark, sf_dir, "part").select(s.alias("s")).distinct().select("s", S.is_date_literal("s").alias("ok"))


@query(
    """SELECT o_custkey, count(*) AS tasks FROM orders WHERE NOT (o_custkey % 3 = 0) GROUP BY o_custkey"""
)
def retention_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every third customer are long over; their tasks go with them."""
    old, new = "01ARZ3NDEKTSV4RRFFQ69G5FAV", "01HMZ3NDEKTSV4RRFFQ69G5FAV"
    runs = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.lit("SUCCEEDED").alias("state"), F.when(F.col("c_custkey") % 3 == 0, old).otherwise(new).alias("row_version"))
    tasks = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), "o_orderkey")
    _, kept = merge.prune_runs(runs, {"tasks": tasks}, 1_708_000_000_000)
    return kept["tasks"].groupBy(F.col("run_id").alias("o_custkey")).agg(F.count("*").alias("tasks"))


@query(
    """WITH RECURSIVE e AS (SELECT c_custkey AS child, c_custkey // 3 AS parent FROM customer),
w AS (SELECT child, parent FROM e UNION SELECT w.child, e.parent FROM w JOIN e ON e.child = w.parent)
SELECT child AS node, parent AS ancestor FROM w UNION SELECT child, child FROM e UNION SELECT parent, parent FROM e"""
)
def membership_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakelens.operators.graph import pairs_closure

    c = F.col("c_custkey")
    return pairs_closure(read(spark, sf_dir, "customer").select(c.alias("child"), F.floor(c / 3).cast("long").alias("parent")))


@query(
    """SELECT a.n_name AS name, b.s_name AS other FROM (SELECT n_name, 's3://b/' || CAST(n_regionkey AS VARCHAR) || '/' || CAST(n_nationkey AS VARCHAR) AS p FROM nation) a JOIN
(SELECT s_name, 's3://b/' || CAST(n_regionkey AS VARCHAR) || '/' || CAST(n_nationkey AS VARCHAR) || '/' || CAST(s_suppkey AS VARCHAR) AS p FROM supplier JOIN nation ON n_nationkey = s_nationkey) b ON starts_with(b.p, a.p || '/')"""
)
def path_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    base = F.concat(F.lit("s3://b/"), F.col("n_regionkey").cast("string"), F.lit("/"), F.col("n_nationkey").cast("string"))
    places = n.select(F.col("n_name").alias("name"), base.alias("place")).union(
        s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_name", F.concat(base, F.lit("/"), F.col("s_suppkey").cast("string")))
    )
    out = joins.path_conflicts(places)
    nation = F.col("name").startswith("Supplier")
    return out.select(F.when(nation, F.col("other")).otherwise(F.col("name")).alias("name"), F.when(nation, F.col("name")).otherwise(F.col("other")).alias("other"))


@query(
    """SELECT s_nationkey AS parent_backfill_id, list(DISTINCT k ORDER BY k) AS keys FROM (SELECT s_nationkey, CAST(s_suppkey % 10 AS VARCHAR) AS k FROM supplier WHERE s_suppkey % 4 = 0 AND s_nationkey % 2 = 0) GROUP BY 1"""
)
def retry_failed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    chunks = s.select(F.col("s_nationkey").alias("backfill_id"), F.when(F.col("s_suppkey") % 4 == 0, "FAILED").otherwise("SUCCEEDED").alias("state"), F.to_json(F.array((F.col("s_suppkey") % 10).cast("string"))).alias("partition_keys"))
    backfills = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("backfill_id"), F.when(F.col("n_nationkey") % 2 == 0, "FAILED").otherwise("RUNNING").alias("state"))
    return rules.retry_failed_keys(backfills, chunks)
