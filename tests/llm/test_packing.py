import random
import zlib

import numpy as np
import pytest

from lakelens.llm import packing, tokens
from tests.llm.conftest import ODD


def optimum(items, capacity):
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        tried = set()
        for k, b in enumerate(bins):
            if b + items[i] <= capacity and b not in tried:
                tried.add(b)
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    items = sorted(items, reverse=True)
    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(6))
def test_reduction_keeps_the_optimum(seed):
    r = random.Random(seed)
    for _ in range(120):
        capacity = r.choice([12, 20, 30, 50])
        pool = [r.randint(1, capacity) for _ in range(r.randint(1, 6))]
        items = [r.choice(pool) if r.random() < 0.5 else r.randint(1, capacity) for _ in range(r.randint(1, 9))]
        plan, fixed = packing.reduce_and_fit({x: items.count(x) for x in set(items)}, capacity)
        assert sorted(x for p in plan for x in p.lengths for _ in range(p.times)) == sorted(items)
        assert all(sum(p.lengths) <= capacity for p in plan)
        rest, seen = [], 0
        for p in plan:
            if seen < fixed:
                seen += p.times
            else:
                rest += list(p.lengths) * p.times
        assert fixed + (optimum(rest, capacity) if rest else 0) == optimum(items, capacity)


def test_large_counts_are_cheap():
    plan, _ = packing.reduce_and_fit({k: 10**9 + k for k in range(1, 1025)}, 1024)
    assert len(plan) < 10_000
    used = sum(p.times for p in plan)
    ids = sum(k * (10**9 + k) for k in range(1, 1025))
    assert used <= ids / 1024 * 1.001 + 1


def test_pack(spark, make_docs):
    r = random.Random(1)
    rows = [*ODD] + [(100 + i, " ".join(r.choice(["the", "of", "Öl", "x9", "don't", "\n\n"]) for _ in range(r.randint(0, 2500))), "s") for i in range(60)]
    docs = make_docs(rows, extra=True)
    got = packing.pack(spark, docs).collect()
    tok = tokens.tokenizer(tokens.default_path())
    want = []
    for i, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        want += [(str(i), k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r_ in got:
        by.setdefault(r_.sequence_id, []).append((r_.offset, r_.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= -(-sum(r_.length for r_ in got) // 1024) + 2


def test_empty(spark, make_docs):
    assert packing.pack(spark, make_docs([])).count() == 0


def test_reduction_goes_on_past_a_length_without_partners():
    # three short ones fit beside 90, whose fill is not proven; 60 and 40 fill up exactly
    counts = {90: 2, 60: 5, 40: 5, 3: 2, 2: 9}
    plan, fixed = packing.reduce_and_fit(counts, 100)
    assert fixed >= 5 and packing.Pattern((60, 40), 5) in plan
    assert sorted(x for p in plan for x in p.lengths for _ in range(p.times)) == sorted(x for x, n in counts.items() for _ in range(n))
