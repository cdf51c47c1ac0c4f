import random
import re

from lakelens.llm import minhash
from tests.llm.conftest import ODD


def brute(rows, percent=85):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(frozenset(s))
    ids = [i for i in sets if i is not None]
    comp = {i: i for i in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    flat = [(i, s) for i in ids for s in sets[i] if s]
    for a in range(len(flat)):
        for b in range(a):
            (i, s), (j, t) = flat[a], flat[b]
            if 100 * len(s & t) >= percent * len(s | t):
                lo, hi = sorted((find(i), find(j)))
                comp[hi] = lo
    return {i: (find(i), {len(s) for s in sets[i]}) for i in ids}


def near(r, words, share):
    return " ".join(w if r.random() > share else f"x{r.randint(0, 9**6)}" for w in words)


def cases(seed, groups=12, size=14):
    r = random.Random(seed)
    rows, n = [], 0
    for g in range(groups):
        words = [f"w{r.randint(0, 4000)}" for _ in range(r.choice([3, 5, 6, 40, 150, 300]))]
        for _ in range(r.randint(1, size)):
            rows.append((n, near(r, words, r.choice([0, 0, 0.003, 0.01, 0.02, 0.05])), "s"))
            n += 1
    r.shuffle(rows)
    return rows


def check(spark, make_docs, rows, params=minhash.Params()):
    want = brute(rows)
    got = minhash.near_duplicates(spark, make_docs(rows, extra=True), params).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        comp, sizes = want[r.doc_id]
        assert r.component_id == comp and r.kept == (r.doc_id == comp) and r.n_shingles in sizes


def test_against_brute_force(spark, make_docs):
    check(spark, make_docs, cases(1))


def test_blocks_of_hot_buckets(spark, make_docs):
    check(spark, make_docs, cases(2, groups=3, size=60), minhash.Params(block=4))


def test_odd_rows(spark, make_docs):
    check(spark, make_docs, ODD)


def test_empty_table(spark, make_docs):
    assert minhash.near_duplicates(spark, make_docs([])).count() == 0


def test_threshold_is_exact(spark, make_docs):
    """20 shingles, 17 shared of 20: exactly 85 in the hundred."""
    w = [f"t{i}" for i in range(24)]
    a, b = " ".join(w), " ".join(w[:21])  # 20 and 17 shingles
    rows = [(1, a, "s"), (2, b, "s"), (3, " ".join(w[:20]), "s")]
    assert brute(rows)[2][0] == 1
    check(spark, make_docs, rows)


def test_one_of_each_group_stays(spark, make_docs):
    rows = [*cases(3), (10_000, None, "s"), (None, "no id", "s"), (0, "again", "s")]
    rows += [rows[0]]
    docs = make_docs(rows, extra=True)
    out = minhash.drop_near_duplicates(spark, docs)
    assert out.columns == docs.columns
    want = brute(rows)
    ids = [r.doc_id for r in out.collect()]
    # a row for each kept id and text; two unlike texts under one id are two documents
    heads = {(i, t) for i, t, *_ in rows if i is not None and want[i][0] == i}
    assert sorted(i for i in ids if i is not None) == sorted(i for i, _ in heads) and ids.count(None) == 1


def test_clashing_names_and_texts_of_one_id(spark, make_docs):
    from pyspark.sql import functions as F

    words = " ".join(f"w{i}" for i in range(60))
    rows = [(3, words, "s"), (5, "quite another text of its own here", "s"), (5, words, "s")]
    docs = make_docs(rows).withColumn("_row_hash", F.lit(1)).withColumn("_kept_id", F.lit("x"))
    out = minhash.drop_near_duplicates(spark, docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted((i, t) for i, t, _ in rows[:2])
