import pyarrow as pa
import pytest

from lakelens.plans import sqlgate as g

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def user(spark):
    tables = {("default", "sales", t): spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "customer")}
    return g.UserData(lambda *n: (tables[n], 10) if n in tables else None)


@pytest.fixture(scope="module")
def snap(spark):
    return g.Snapshot({"catalog.tables": spark.range(3).toDF("id"), "system.lineage.edges": spark.range(2).toDF("id")})


@pytest.mark.parametrize("sql", [
    "drop table x", "set a=1", "explain select 1", "insert into t values (1)", "create view v as select 1", "show tables", "describe x", "cache table x",
    "delete from t", "update t set a = 1", "use x", "refresh table x", "analyze table x compute statistics", "with a as (select 1) insert into t select * from a",
])
def test_only_queries_pass(spark, user, sql):
    with pytest.raises(g.QueryError, match="Only SELECT/CTE"):
        user.bind(spark, sql)


@pytest.mark.parametrize("sql", ["", "   ", "select 1; select 2", "selec 1", "select * from orders", "select * from sales.orders", "select * from parquet.`/tmp/x`",
                                 "select reflect('java.lang.System', 'exit', 1)", "select java_method('a', 'b')", "x" * 10_001, "select 'é" + "é" * 5000 + "'"])
def test_client_errors(spark, user, sql):
    with pytest.raises(g.QueryError) as e:
        user.bind(spark, sql)
    assert e.value.status == 400


def test_missing_and_unrelated_tables(spark, user):
    with pytest.raises(g.NotFound):
        user.bind(spark, "select * from default.sales.nothing")
    assert user.bind(spark, "select count(*) as n from default.sales.orders").first().n > 0


def test_names_keep_case(spark, user):
    with pytest.raises(g.NotFound):
        user.bind(spark, "select * from DEFAULT.sales.orders")


def test_ctes_and_subqueries(spark, user):
    sql = """with o as (select * from default.sales.orders where o_orderkey < 10), n as (with inside as (select * from o) select count(*) as c from inside)
    select n.c, (select max(c_custkey) from default.sales.customer) as m from n where exists (select 1 from default.sales.orders)"""
    assert user.bind(spark, sql).first().c == 10


def test_qualified_columns_and_text(spark, user):
    row = user.bind(spark, "select orders.o_orderkey, 'default.sales.orders' as t from default.sales.orders where orders.o_orderkey = 1").first()
    assert (row.o_orderkey, row.t) == (1, "default.sales.orders")


def test_only_relations_are_bound(spark, user, snap):
    spark.range(7).createOrReplaceTempView("orders")
    before = {t.name for t in spark.catalog.listTables()}
    row = snap.bind(spark, 'select "catalog.tables" as a, \'it\\\'s catalog.tables\' as b, count(*) as n from catalog . `tables` -- catalog.tables').first()
    assert tuple(row) == ("catalog.tables", "it's catalog.tables", 3)
    sql = """select default.sales.orders.o_orderkey as k, x.c_custkey, 'é 😀' as t from default.sales.orders
        join default.sales.customer as x on default.sales.orders.o_custkey = x.c_custkey where /* default.sales.orders */ o_orderkey = 1"""
    assert user.bind(spark, sql).first().k == 1
    assert user.bind(spark, "select default.sales.orders.* from default.sales.orders limit 1").columns[0] == "o_orderkey"
    assert user.bind(spark, "select orders.o_orderkey from default.sales.orders tablesample (100 percent)").count() > 0
    assert user.bind(spark, "table default.sales.customer").count() > 0
    one = g.bind_views(spark, g.parse(spark, "select count(*) as n from orders"), {("orders",): spark.range(2)})
    assert one.first().n == 2 and spark.table("orders").count() == 7
    assert {t.name for t in spark.catalog.listTables()} == before
    spark.catalog.dropTempView("orders")
    with pytest.raises(g.QueryError):
        user.bind(spark, "select * from identifier('default.sales.orders')")


def test_known_names_without_snapshots(spark):
    empty = g.Snapshot({}, frozenset({"catalog.tables", "catalog.columns"}))
    with pytest.raises(g.NotFound):
        empty.bind(spark, "select * from catalog.tables")
    some = g.Snapshot({"catalog.tables": spark.range(1)}, frozenset({"catalog.tables", "catalog.columns"}))
    with pytest.raises(g.QueryError) as e:
        some.bind(spark, "select * from catalog.columns join catalog.tables")
    assert e.value.status == 400


def test_byte_cap_stops_the_task(spark, user):
    from types import SimpleNamespace

    seen = list(g._up_to(100)(iter([SimpleNamespace(nbytes=60, k=k) for k in range(5)])))
    assert [b.k for b in seen] == [0, 1]


def test_snapshot_names(spark, snap):
    assert snap.bind(spark, "select count(*) as n from Catalog.Tables").first().n == 3
    assert snap.bind(spark, "select count(*) as n from system.lineage.edges").first().n == 2
    for bad in ("catalog.columns", "system.catalog.tables", "search.postings"):
        with pytest.raises(g.QueryError):
            snap.bind(spark, f"select * from {bad}")


def test_limits(spark, user):
    assert user.bind(spark, "select * from range(20000)").count() == 10_000
    with pytest.raises(g.TooLarge):
        g.UserData(lambda *n: (spark.range(1), 1 << 40)).bind(spark, "select * from a.b.c")
    many = " union all ".join(f"select * from a.b.t{i}" for i in range(26))
    with pytest.raises(g.QueryError):
        g.UserData(lambda *n: (spark.range(1), 1)).bind(spark, many)
    with pytest.raises(g.TooLarge):
        g.collect(user.bind(spark, "select repeat('x', 20000) as x from range(1000)"), "arrow")


def test_results(spark, user):
    df = user.bind(spark, "select id, cast(id as string) as t from range(3)")
    assert pa.ipc.open_stream(g.collect(df, "arrow")).read_all().num_rows == 3
    assert g.collect(df, "json") == b'[{"id":0,"t":"0"},{"id":1,"t":"1"},{"id":2,"t":"2"}]'
    assert g.wanted_format(None, None) == "arrow" and g.wanted_format("json", "x") == "json" and g.wanted_format(None, "application/json") == "json"
    with pytest.raises(g.QueryError):
        g.wanted_format("csv", None)


def test_timeout(spark, user):
    slow = user.bind(spark, "select sum(a.id * b.id) as s from range(300000) a cross join range(300000) b")
    with pytest.raises(g.TimedOut):
        g.collect(slow, "json", timeout_s=1.0)


def test_dialect(spark):
    assert g.nulls_last("a, b desc, c nulls first") == "a NULLS LAST, b desc NULLS FIRST, c nulls first"
    sql = g.translate_functions("select strpos('ab', 'b') as x, 'strpos(' as t, array_to_string(make_array('a', 'b'), '-') as y")
    assert tuple(spark.sql(sql).first()) == (2, "strpos(", "a-b")


def test_recursion_beyond_sparks_row_limit(spark):
    """The whole result, while the session's limit is the same after as before."""
    key = "spark.sql.cteRecursionRowLimit"
    text = "WITH RECURSIVE up(node, pos) AS (SELECT id, id FROM t UNION ALL SELECT node, pos - 1 FROM up WHERE pos > 0) SELECT node, count(*) AS n FROM up GROUP BY node"
    old = spark.conf.get(key)
    spark.conf.set(key, "50")
    try:
        parsed = g.parse(spark, text)
        got = g.bind_views(spark, parsed, {("t",): spark.range(20)}).collect()
        assert spark.conf.get(key) == "50"
    finally:
        spark.conf.set(key, old)
    assert sorted(map(tuple, got)) == [(i, i + 1) for i in range(20)]
