"""The SQL surface: the same text runs through the gate and on the other engine."""

from __future__ import annotations

from lakelens.queries import same_sql

same_sql(
    "sql_three_way_join",
    """SELECT r.r_name, n.n_name, count(*) AS suppliers, CAST(round(sum(s.s_acctbal), 2) AS DECIMAL(18, 2)) AS balance
FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN supplier s ON s.s_nationkey = n.n_nationkey
GROUP BY r.r_name, n.n_name ORDER BY r.r_name, n.n_name""",
)
same_sql(
    "sql_projection",
    "SELECT c_custkey, c_name AS name, c_acctbal * 2 AS twice, c_acctbal > 0 AS positive FROM customer",
)
same_sql(
    "sql_filters",
    """SELECT o_orderkey, o_totalprice FROM orders
WHERE (o_totalprice >= 1000 AND o_orderstatus <> 'F') OR NOT (o_totalprice < 400000) OR o_orderkey = 7""",
)
same_sql("sql_in_list", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
same_sql("sql_is_null", "SELECT event_id, props IS NULL AS no_props, user_id IS NOT NULL AS has_user FROM events")
same_sql(
    "sql_case_like_between",
    """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class,
coalesce(nullif(p_brand, 'Brand#11'), 'other') AS brand, CAST(p_size AS VARCHAR(10)) AS size_text
FROM part WHERE p_size BETWEEN 5 AND 45 AND p_type LIKE '%E%'""",
)
same_sql(
    "sql_distinct_from",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus IS DISTINCT FROM 'O' AND o_orderpriority IS NOT DISTINCT FROM '1-URGENT'",
)
same_sql(
    "sql_joins_outer",
    """SELECT coalesce(c.c_custkey, o.o_custkey) AS custkey, count(o.o_orderkey) AS orders, count(c.c_custkey) AS customers
FROM customer c FULL OUTER JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY 1""",
)
same_sql(
    "sql_joins_left_right",
    """SELECT n.n_name, count(s.s_suppkey) AS suppliers FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey
GROUP BY n.n_name""",
)
same_sql(
    "sql_semi_anti",
    """SELECT c_custkey, 'with' AS kind FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT c_custkey, 'without' AS kind FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""",
)
same_sql(
    "sql_in_subquery",
    "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
)
same_sql(
    "sql_using_natural",
    """SELECT a.n_nationkey, a.n_name, b.n_regionkey FROM nation a JOIN nation b USING (n_nationkey)""",
)
same_sql(
    "sql_theta_join",
    """SELECT a.r_name AS low, b.r_name AS high FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey""",
)
same_sql(
    "sql_lateral",
    """SELECT n.n_name, t.best FROM nation n, LATERAL (SELECT max(s.s_acctbal) AS best FROM supplier s WHERE s.s_nationkey = n.n_nationkey) t""",
)
same_sql(
    "sql_cte",
    """WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT o_custkey FROM big WHERE n > 12)
SELECT c.c_custkey, c.c_mktsegment FROM customer c JOIN top t ON t.o_custkey = c.c_custkey""",
)
same_sql(
    "sql_aggregates",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(l_quantity) AS DECIMAL(18, 2)) AS quantity,
round(avg(l_extendedprice), 4) AS avg_price, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
bool_and(l_quantity > 0) AS all_positive, bool_or(l_discount > 0.05) AS some_discount, count(*) FILTER (WHERE l_tax > 0.04) AS taxed
FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
same_sql(
    "sql_statistics",
    """SELECT p_brand, round(stddev_samp(p_retailprice), 4) AS sd, round(var_pop(p_retailprice), 2) AS vp,
round(corr(p_size, p_retailprice), 6) AS cor, round(median(p_retailprice), 4) AS med, bit_xor(p_size) AS bx
FROM part GROUP BY p_brand""",
)
same_sql(
    "sql_having",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15 AND max(o_totalprice) > 1000",
)
same_sql(
    "sql_cube",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INT) AS g1, CAST(grouping(o_orderpriority) AS INT) AS g2
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
)
same_sql(
    "sql_rollup",
    "SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)",
)
same_sql(
    "sql_grouping_sets",
    """SELECT event_type, user_id, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())""",
)
same_sql(
    "sql_window_rank",
    """SELECT s_suppkey, s_nationkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr,
round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd, ntile(4) OVER w AS quarter
FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)""",
)
same_sql(
    "sql_window_frames",
    """SELECT event_id, user_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after, first_value(event_id) OVER w AS first_id,
count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS three,
sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS near,
nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)
same_sql(
    "sql_order_limit_offset",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 10",
)
same_sql(
    "sql_set_operations",
    """(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
UNION ALL (SELECT n_regionkey FROM nation EXCEPT ALL SELECT r_regionkey FROM region)
UNION ALL (SELECT n_regionkey FROM nation INTERSECT ALL SELECT n_nationkey FROM nation)""",
)
same_sql("sql_union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
same_sql("sql_distinct", "SELECT DISTINCT event_type, user_id FROM events")
same_sql(
    "sql_recursive",
    """WITH RECURSIVE up(node, pos, depth) AS (
  SELECT CAST(p_partkey AS BIGINT), CAST(p_partkey AS BIGINT), 0 FROM part
  UNION ALL SELECT node, CAST(floor(pos / 2) AS BIGINT), depth + 1 FROM up WHERE pos > 0)
SELECT node, max(depth) AS depth FROM up GROUP BY node""",
)
same_sql(
    "sql_string_functions",
    """SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name) AS n, reverse(c_name) AS r, substr(c_name, 2, 4) AS s,
replace(c_name, '#', '-') AS rep, lpad(CAST(c_custkey AS VARCHAR(20)), 8, '0') AS pad, concat(c_mktsegment, '/', c_name) AS cc,
split_part(c_name, '#', 2) AS part2, trim(concat(' ', c_name, ' ')) AS t, md5(c_name) AS h, translate(c_name, 'Cu', 'xy') AS tr,
regexp_replace(c_name, '^[A-Z]', 'z') AS rx, left(c_name, 3) AS le, right(c_name, 3) AS ri, repeat('ab', 2) AS rp, levenshtein(c_name, 'Customer') AS lv
FROM customer""",
)
same_sql(
    "sql_math_functions",
    """SELECT p_partkey, abs(p_size - 25) AS a, sign(p_size - 25) AS sg, CAST(ceil(p_retailprice) AS BIGINT) AS ce, CAST(floor(p_retailprice) AS BIGINT) AS fl,
round(sqrt(p_size), 6) AS sq, round(ln(p_size + 1), 6) AS ln1, round(power(p_size, 2), 2) AS pw, round(exp(p_size / 100.0), 6) AS ex, p_size % 7 AS md,
greatest(p_size, 10) AS gr, least(p_size, 10) AS le, round(degrees(radians(p_size)), 6) AS dg, round(cbrt(p_size), 6) AS cb, round(atan2(p_size, 3), 6) AS at2
FROM part""",
)
same_sql(
    "sql_date_functions",
    """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, date_trunc('month', o_orderdate) AS mon,
CAST(o_orderdate AS DATE) AS dt, extract(quarter FROM o_orderdate) AS q, o_orderdate + INTERVAL '1' DAY AS nxt, make_date(2020, 1, 2) AS mk
FROM orders""",
)
