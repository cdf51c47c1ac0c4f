import random
import zlib

from lakelens.llm import sharding
from tests.llm.conftest import ODD


def check(spark, docs, rows, params=sharding.Params()):
    got = sharding.shard(spark, docs, params).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    groups, loads = {}, [0] * params.shards
    for r in got:
        groups.setdefault((r.size, r.text_crc32), set()).add(r.shard)
        loads[r.shard] += r.size
    assert all(len(s) == 1 for s in groups.values())
    for k in range(params.shards):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))
    return loads


def test_differencing_loads():
    r = random.Random(1)
    for _ in range(300):
        sizes = [r.randint(0, 60) for _ in range(r.randint(0, 40))]
        k = r.randint(1, 6)
        where, loads = sharding.differencing(sizes, k)
        real = [0] * k
        for s, w in zip(sizes, where):
            real[w] += s
        assert sorted(real) == sorted(loads)


def test_balance(spark, make_docs):
    r = random.Random(2)
    rows = [(i, "x" * int(r.paretovariate(1.2) * 20) + str(i), "s") for i in range(1500)] + [(5000 + i, "copy " * 8, "s") for i in range(80)]
    params = sharding.Params(bucket_groups=200, finish=64)
    loads = check(spark, make_docs(rows, extra=True), rows, params)
    assert max(loads) - min(loads) <= max(2, 0.001 * sum(loads) / 16) or max(loads) == max(len(t) + 1 for _, t, _ in rows)


def test_levels_of_buckets(spark, make_docs):
    r = random.Random(3)
    rows = [(i, "y" * r.randint(1, 60) + str(i), "s") for i in range(3000)]
    params = sharding.Params(shards=4, bucket_groups=20, most_buckets=4, finish=32)
    loads = check(spark, make_docs(rows), rows, params)
    assert max(loads) - min(loads) <= 2


def test_small_and_odd(spark, make_docs):
    check(spark, make_docs(ODD, extra=True), ODD)
    check(spark, make_docs([(1, "a", "s")]), [(1, "a", "s")])
    assert sharding.shard(spark, make_docs([])).count() == 0
