import re

from lakelens.llm import mixing
from tests.llm.conftest import ODD


def targets(sizes):
    """sizes: words by source in order."""
    weight = [(3, 1, 2)[k % 3] for k in range(len(sizes))]
    cap, whole = [2 * s for s in sizes], 1.5 * sum(sizes)
    fixed = {}
    while True:
        rest = [k for k in range(len(sizes)) if k not in fixed]
        w = sum(weight[k] for k in rest)
        share = {k: (whole - sum(fixed.values())) * weight[k] / w for k in rest} if w else {}
        over = [k for k in rest if share[k] > cap[k]]
        if not over:
            return [fixed.get(k, share.get(k)) for k in range(len(sizes))]
        fixed |= {k: cap[k] for k in over}


def check(spark, docs, rows, params=mixing.Params()):
    got = mixing.mix(spark, docs, params).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    want = dict(zip(names, targets([total[s] for s in names])))
    of = {}
    for i, t, s in rows:
        of.setdefault((i, size(t)), set()).add(s)
    taken = {s: 0 for s in names}
    for r in got:
        sources = of[r.doc_id, r.size]
        assert any(r.source_size == total[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) for s in sources)
        assert 0 <= r.taken <= 2 * r.size
        if len(sources) == 1:
            taken[next(iter(sources))] += r.taken
    return taken, want


def test_quotas(spark, make_docs):
    rows = [(i, "w " * (i % 37), f"src{i % 7}" if i % 3 else "big") for i in range(900)] + [(2000 + i, "v " * 9, None) for i in range(30)]
    docs = make_docs(rows, extra=True)
    taken, want = check(spark, docs, rows)
    for s in want:
        assert abs(taken[s] - want[s]) <= 2
    small, _ = check(spark, docs, rows, mixing.Params(blocks=200, shard_rows=40))
    for s in want:
        assert abs(small[s] - want[s]) <= max(2, 0.01 * want[s])


def test_targets_at_any_ratio_of_blocks_and_streams(spark, make_docs):
    rows = [(i, "w " * (i * 7 % 61), f"src{i % 5}" if i % 3 else "big") for i in range(4000)] + [(9000 + i, "v " * 3, "tiny") for i in range(3)]
    docs = make_docs(rows)
    for blocks, shard_rows in ((64, 20), (64, 5), (16, 2), (65536, 2000)):
        taken, want = check(spark, docs, rows, mixing.Params(blocks=blocks, shard_rows=shard_rows))
        for s in want:
            assert abs(taken[s] - want[s]) <= max(1, 0.01 * want[s])


def test_clashing_names(spark, make_docs):
    from pyspark.sql import functions as F

    rows = [(i, "w " * (i % 9 + 1), f"s{i % 2}") for i in range(60)]
    docs = make_docs(rows).withColumn("_draw", F.lit(1)).withColumn("_TIMES", F.lit("x")).withColumn("_copy", F.lit(2))
    out = mixing.take(spark, docs)
    assert out.columns == docs.columns
    assert {(r._draw, r._TIMES, r._copy) for r in out.collect()} == {(1, "x", 2)}


def test_reruns_agree(spark, make_docs):
    rows = [(i, "w " * (i % 11), f"s{i % 3}") for i in range(200)]
    a = sorted(map(tuple, mixing.mix(spark, make_docs(rows)).drop("draw").collect()))
    b = sorted(map(tuple, mixing.mix(spark, make_docs(rows[::-1]).repartition(3)).drop("draw").collect()))
    assert a == b


def test_odd_rows(spark, make_docs):
    rows = [(i, t, s) for i, t, s in ODD]
    check(spark, make_docs(rows, extra=True), rows)
    assert mixing.mix(spark, make_docs([])).count() == 0
    check(spark, make_docs([(1, None, None), (2, " ", "a")]), [(1, None, None), (2, " ", "a")])


def test_apportionment_is_sainte_lague(spark):
    votes = [("a", 53.0), ("b", 24.0), ("c", 23.0), ("d", 0.0)]
    df = spark.createDataFrame([(k, v, 1) for k, v in votes], "k string, v double, one int")
    from pyspark.sql import functions as F

    for seats in (0, 1, 2, 7, 50, 1000):
        got = {r.k: r.quota for r in mixing._apportion(df, ["one"], F.col("v"), F.lit(seats), ["k"]).collect()}
        want = {k: 0 for k, _ in votes}
        for _ in range(seats):
            k = max((x for x in votes if x[1]), key=lambda x: (x[1] / (2 * want[x[0]] + 1), -ord(x[0])))[0]
            want[k] += 1
        assert got == want


def test_whole_documents(spark, make_docs):
    rows = [(i, "w " * (i % 20 + 1), f"s{i % 4}") for i in range(400)]
    docs = make_docs(rows, extra=True)
    out = mixing.take(spark, docs)
    assert out.columns == docs.columns
    texts = {i: t for i, t, _ in rows}
    got = out.collect()
    assert all(r.text == texts[r.doc_id] for r in got)
    assert abs(sum(len(r.text.split()) for r in got) / (1.5 * sum(len(t.split()) for t in texts.values())) - 1) < 0.05
