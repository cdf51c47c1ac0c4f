import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs

from lakelens.llm import tokenfile, tokens
from tests.llm.conftest import ODD


def test_encoder_is_exact():
    tok = tokens.tokenizer(tokens.default_path())
    r = random.Random(3)
    bits = [*"ab Zé\n\t .,'!0× 　ß<|>日\r\u0085​", "  ", "don't", "'s", " <|endoftext|>", "\n\n", " é", "it's "]
    for _ in range(60):
        texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(40)] + [None, ""]
        ids, off = tokens.encode(pa.array(texts, pa.string()), tokens.default_path(), 0)
        for i, t in enumerate(texts):
            assert ids[off[i] : off[i + 1]].tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 0]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, size=50_000))
    index = tokenfile.PerfectHash.build(keys, 1.7, 64)
    assert np.array_equal(np.sort(index.slots(keys)), np.arange(len(keys)))
    assert len(index.words) * 64 < 4 * len(keys)
    empty = tokenfile.PerfectHash.build(np.zeros(0, np.int64), 1.7, 64)
    assert empty.slots(np.array([5])).tolist() == [-1]


def check(spark, docs, rows, params=None):
    manifest = tokenfile.write(spark, docs, params)
    got = tokenfile.read_digests(spark, manifest, params).collect()
    tok = tokens.tokenizer(tokens.default_path())
    made = [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for i, t, *_ in rows]
    told = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in told] == sorted((i for i, _ in made), key=lambda i: (i is not None, i or 0))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(x), zlib.crc32(x.tobytes())) for i, x in made)
    at = 0
    for r in told:
        assert r.start == at
        at += r.n_tokens
    return manifest, made


def test_round_trip(spark, make_docs):
    rows = [*ODD] + [(i * 7 % 101 + 50, f"text {i} " * (i % 9), "s") for i in range(100)]
    p = tokenfile.Params(shards=5, read_ids=300)
    manifest, made = check(spark, make_docs(rows, extra=True), rows, p)
    fs, root = pafs.FileSystem.from_uri(manifest.folder)
    want = {}
    for i, x in made:
        want.setdefault(i, []).append(x.tolist())
    for name in manifest.names:
        with fs.open_input_file(f"{root}/{name}") as f:
            shard = tokenfile.Shard(f)
            held = shard.keys[shard.about["null_keys"] :]
            first, run = shard.find(held)
            for key, a, n in zip(held.tolist(), first.tolist(), run.tolist()):
                assert n >= 1 and all(shard.ids(a + k, a + k + 1).tolist() in want[key] for k in range(n))
            absent = np.array([10**12, -3, 10**15 + 1])
            assert shard.find(absent)[0].tolist() == [-1, -1, -1]
    again = tokenfile.Manifest.load(manifest.folder)
    assert again == manifest
    for key in (4, 6, 50, 101):
        assert sorted(x.tolist() for x in again.get(key)) == sorted(want[key])
    assert again.get(10**12) == [] and again.get(-3) == []


def test_empty(spark, make_docs):
    manifest = tokenfile.write(spark, make_docs([]))
    assert manifest.names == [] and tokenfile.read_digests(spark, manifest).count() == 0
