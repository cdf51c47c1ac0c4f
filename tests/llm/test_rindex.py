import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from lakelens.llm import rindex
from tests.llm.conftest import ODD


def brute(texts, length):
    c = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if c[t[i : i + length]] > 1:
                cover[i : i + length] = True
        left = np.frombuffer(t, np.uint8)[~cover].tobytes() if t else b""
        edges = np.diff(np.concatenate(([0], cover.astype(int), [0])))
        out.append((len(t), int(cover.sum()), int((edges == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


def brute_words(texts, n):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", t) for t in texts]
    c = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        cover = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            if c[tuple(w[i : i + n])] > 1:
                cover[i : i + n] = True
        out.append(int(cover.sum()))
    return out


def check(spark, make_docs, rows, params):
    got = rindex.remove_repeats(spark, make_docs(rows, extra=True), params).collect()
    want = brute([(t or "").encode() for _, t, *_ in rows], params.length)
    told = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert told == sorted((str(i), *w) for (i, *_), w in zip(rows, want))
    if not params.words:
        return
    words = brute_words([(t or "").encode() for _, t, *_ in rows], params.words)
    assert sorted((str(r.doc_id), r.n_passage_words) for r in got) == sorted((str(i), n) for (i, *_), n in zip(rows, words))


def corpus(seed, n=60):
    r = random.Random(seed)
    shared = ["".join(r.choice("abcdé ") for _ in range(r.randint(20, 160))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = ["".join(r.choice("abcdefgh ü") for _ in range(r.randint(0, 60))) if r.random() < 0.6 else r.choice(shared) for _ in range(r.randint(0, 8))]
        rows.append((i, "".join(parts), "s"))
    rows += [(1000 + k, rows[k][1], "s") for k in range(5)]
    rows += [(2000, "ab" * 300, "s"), (2001, "z" * 41, "s"), (2002, "q" * 40, "s"), (2003, ("k" * 39 + "j") * 9, "s")]
    return rows


@pytest.mark.parametrize("seed,most,words", [(1, 256, 6), (2, 2, 6), (3, 1, 0), (4, 256, 0), (5, 256, 0)])
def test_against_brute_force(spark, make_docs, seed, most, words):
    check(spark, make_docs, corpus(seed), rindex.Params(length=40, gram=12, most=most, words=words, gram_words=2))


def test_odd_rows(spark, make_docs):
    small = [(i, t if t is None or len(t) < 1000 else t[:900], s) for i, t, s in ODD]
    check(spark, make_docs, small, rindex.Params(length=40, gram=12))
    assert rindex.remove_repeats(spark, make_docs([])).count() == 0


def test_production_length(spark, make_docs):
    r = random.Random(4)
    base = "".join(r.choice("abcdefghij ") for _ in range(1500))
    rows = [(1, base, "s"), (2, "x" + base[300:700] + "y", "s"), (3, base[800:1199], "s"), (4, base[1000:1400] * 2, "s")]
    check(spark, make_docs, rows, rindex.Params())


def test_planted_passages(spark, make_docs):
    """Passages of over 50 words, under and over 400 bytes, in documents of their own."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(1, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in (51, 55, 60, 70, 90)]
    rows = []
    for i in range(120):
        own = [word() for _ in range(r.randint(60, 300))]
        if i % 3 == 0:
            own.insert(r.randint(0, len(own)), passages[i // 3 % 5])
        rows.append((i, " ".join(own), "s"))
    rows.append((500, " ".join(passages[0].split()[:50]), "s"))
    check(spark, make_docs, rows, rindex.Params())
    got = {x.doc_id: x.n_passage_words for x in rindex.remove_repeats(spark, make_docs(rows)).collect()}
    assert {i for i, n in got.items() if n} == set(range(0, 120, 3))


def test_matching_statistics():
    r = np.random.default_rng(2)
    text = r.integers(97, 100, size=400).astype(np.uint8)
    cuts = np.array([0, 50, 51, 130, 400])
    left = np.concatenate([np.arange(b - a, 0, -1) for a, b in zip(cuts, cuts[1:])])
    got = rindex.matching_statistics(text, left)
    raw = text.tobytes()
    for p in range(400):
        best = 0
        for q in range(400):
            if q != p:
                k = 0
                most = min(left[p], left[q])
                while k < most and raw[p + k] == raw[q + k]:
                    k += 1
                best = max(best, k)
        assert got[p] == best


def test_matching_statistics_to_a_depth():
    """The same up to the depth; beyond it, only that they reach it."""
    r = np.random.default_rng(3)
    part = r.integers(97, 100, size=90).astype(np.uint8)
    pieces = [part, part[20:], part[30:70], np.full(60, 97, np.uint8), r.integers(97, 99, size=300).astype(np.uint8), part]
    text = np.concatenate(pieces)
    left = np.concatenate([np.arange(len(x), 0, -1) for x in pieces])
    whole = rindex.matching_statistics(text, left)
    for depth in range(1, 80):
        got = rindex.matching_statistics(text, left, depth)
        assert (np.minimum(got, depth) == np.minimum(whole, depth)).all()
        assert (got <= whole).all()


def test_segments_that_share_only_their_minimizer_are_not_indexed():
    p = rindex.Params(length=40, gram=12, words=0)
    r = random.Random(6)
    made = lambda n: "".join(r.choice("abcdefgh") for _ in range(n)).encode()
    gram = made(12)
    tail = made(28)
    # one key: unlike surroundings, a shared window at the end, one at the start, a repeat of its own
    parts = [made(28) + gram + made(28) for _ in range(40)]
    parts += [made(9) + gram + tail + made(5), made(20) + gram + tail, tail + gram + made(7), made(3) + tail + gram]
    parts += [gram + made(16) + gram + made(16) + gram, (gram + tail[:10]) * 4]
    other = [made(4) + gram + tail]  # in another key
    size = np.array([len(x) for x in parts + other])
    pivot = np.array([x.index(gram) for x in parts + other])
    key = np.array([-5] * len(parts) + [7])
    got = rindex.may_match(np.frombuffer(b"".join(parts + other), np.uint8), size, key, pivot, p)
    assert np.flatnonzero(got).tolist() == [40, 41, 42, 43, 45]
