"""Every query with SQL gives the rows that SQL gives."""

import datetime
import decimal

import pytest

from lakelens import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat(" ")
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    at = [want.columns.index(c) for c in cols]
    left = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    right = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert left == right


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_queries_over_whole_tables(spark):
    def values(name, column):
        return {r[0] for r in registry.queries()[name](spark, SF).select(column).distinct().collect()}

    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    customers = {r[0] for r in table("customer").select("c_custkey").collect()}
    assert customers <= values("membership_closure", "node")
    assert {f"u{c}" for c in customers if c % 9} <= values("perm_compile", "principal_id")
    assert values("lineage_neighbors", "table_id") == {r[0] for r in table("nation").select("n_nationkey").collect()}
    assert values("sql_recursive", "node") == {r[0] for r in table("part").select("p_partkey").collect()}
    days = {str(r[0])[:10] for r in table("orders").select("o_orderdate").distinct().collect()}
    shipped = {str(r[0])[:10] for r in table("lineitem").select("l_shipdate").distinct().collect()}
    assert {(d, max((u for u in days if u <= d), default=None)) for d in shipped if d >= min(days)} == {
        (r.downstream_key, r.upstream_key) for r in registry.queries()["dep_mapping_latest"](spark, SF).collect()
    }
    day = datetime.date.fromisoformat
    assert {(d, u) for d in shipped for u in days if 0 <= (day(d) - day(u)).days <= 6} == {
        (r.downstream_key, r.upstream_key) for r in registry.queries()["dep_mapping_window"](spark, SF).collect()
    }
