import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lakelens.llm import lm
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5


def check_base(rows, got):
    c = Counter()
    for i, t, *_ in rows:
        if fold(i) != 1:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), fold(i) == 1, len(w := tokens(t)), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


def test_counts_and_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = lm.score(spark, docs, lm.Params(chunk=1 << 16)).collect()
    check_base(rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)
    # chunks don't matter
    again = {r.doc_id: r.score for r in lm.score(spark, docs).collect()}
    assert all(math.isclose(r.score, again[r.doc_id], rel_tol=1e-6) for r in got)


def test_model_against_brute_force(spark, make_docs):
    rows = [(i, " ".join(f"w{(i * k) % 7}" for k in range(i % 9 + 2)), "s") for i in range(60)]
    got = {r.doc_id: r for r in lm.score(spark, make_docs(rows)).collect()}
    uni, bi, parts = Counter(), Counter(), {"full": (Counter(), Counter()), "kept": (Counter(), Counter())}
    for i, t, _ in rows:
        w = tokens(t)
        for name, skip in (("full", {1}), ("kept", {1, 2})):
            if fold(i) not in skip:
                parts[name][0].update(w)
                parts[name][1].update(zip([None, *w[:-1]], w))
    uni, bi = parts["full"]
    n, v = sum(uni.values()), len(uni)
    kept_uni, kept_bi = parts["kept"]
    nk = sum(kept_uni.values())
    cells, counts, s2, s1 = [], [], [], []
    for i, t, _ in rows:
        if fold(i) == 2:
            w = tokens(t)
            for h, x in zip([None, *w[:-1]], w):
                b = int(lm._bucket(np.array([kept_uni[h]]))[0])
                cells.append(b * lm._CELLS * lm._CELLS + len(cells) % 1)
                counts.append(1)
                s2.append(kept_bi[h, x] / max(kept_uni[h], 1))
                s1.append(kept_uni[x] / nk)
    weights = lm.learn_weights(np.array(cells), np.array(counts, float), np.array(s2), np.array(s1), lm.Totals(nk, n, v), lm.Params().rounds)
    assert np.allclose(weights.sum(axis=1), 1)
    for i, t, _ in rows:
        w = tokens(t)
        total = 0.0
        for h, x in zip([None, *w[:-1]], w):
            a = weights[int(lm._bucket(np.array([uni[h]]))[0])]
            total += math.log10(a[0] * bi[h, x] / max(uni[h], 1) + a[1] * uni[x] / n + a[2] / (v + 1))
        assert got[i].score == pytest.approx(total, rel=0.02)  # the grid's cells are means


def test_tree_of_chunks(spark, make_docs):
    rows = [(i, " ".join(f"w{(i * k) % 31}" for k in range(i % 40 + 2)), "s") for i in range(80)]
    docs = make_docs(rows).repartition(4)
    flat = {r.doc_id: r for r in lm.score(spark, docs).collect()}
    for p in (lm.Params(chunk=400, fan=3), lm.Params(chunk=150, fan=5)):
        tree = lm.score(spark, docs, p).collect()
        assert len(tree) == len(rows)
        for r in tree:
            f = flat[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (f.n_tokens, f.n_known, f.train_tokens)
            assert math.isclose(r.base_score, f.base_score, rel_tol=1e-9) and math.isclose(r.score, f.score, rel_tol=1e-6)


def test_odd_rows(spark, make_docs):
    check_base(ODD, lm.score(spark, make_docs(ODD, extra=True)).collect())
    assert lm.score(spark, make_docs([])).count() == 0


def test_weights_prefer_what_predicts():
    cells = np.arange(3) + 5 * lm._CELLS * lm._CELLS
    w = lm.learn_weights(cells, np.array([100.0, 100, 100]), np.array([90.0, 80, 95]), np.array([1.0, 1, 1]), lm.Totals(1000, 1000, 100), 50)
    assert w[5, 0] > 0.9 and w[0, 0] == 0
