import math
import random

import pytest

from lakelens.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score double"


def brute(rows, p):
    good = [(i, [math.floor(p.scale * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % p.every == 0}):
        raw = min(v for i, v, *_ in rows if i == q and v is not None and all(x is not None and math.isfinite(x) for x in v))
        vec = [math.floor(p.scale * x) for x in raw]
        found = sorted((-sum(a * b for a, b in zip(vec, v)), i) for i, v in good if i != q and len(v) == len(vec))
        out += [(q, k, i, -s) for k, (s, i) in enumerate(found[: p.k], 1)]
    return out


def check(spark, rows, p):
    df = spark.createDataFrame([(i, v, 0, 1, 0.5) for i, v in rows], SCHEMA)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]  # as floats hold them
    got = topk.search(spark, df.repartition(3), p).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, p)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    vecs = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(200)]
    rows = [(i, vecs[i] if r.random() < 0.6 else vecs[0]) for i in range(200)]  # many ties
    check(spark, rows, topk.Params(k=5, every=10, query_block=7, bins=16))


def test_odd_rows(spark):
    rows = [(0, [0.5, 0.5]), (50, [0.1, -0.2]), (50, [0.3, 0.3]), (1, None), (2, [None, 0.5]), (3, [float("nan"), 0.1]), (4, [float("inf"), 1.0]), (None, [0.1, 0.2]), (100, [1.0]), (5, [0.0, 0.0]), (6, [-3000.0, 7.5])]
    check(spark, rows, topk.Params())


def test_few_and_none(spark):
    check(spark, [(0, [0.5]), (1, [0.25])], topk.Params())
    check(spark, [(0, [0.5])], topk.Params())
    assert topk.search(spark, spark.createDataFrame([], SCHEMA)).count() == 0
