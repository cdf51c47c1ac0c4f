import itertools
import re
from collections import Counter

import numpy as np

from lakelens.llm import linecrf
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    dup, seen = 0, set()
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def best_path(field, features):
    n = len(features)
    score = features @ field.weights

    def value(path):
        return sum(score[i] for i in range(n) if path[i]) + sum(field.moves[a, b] for a, b in zip(path, path[1:]))

    return max(itertools.product((0, 1), repeat=n), key=value)


def test_viterbi_against_all_paths():
    r = np.random.default_rng(1)
    for _ in range(30):
        field = linecrf.Field(r.normal(size=len(linecrf.FEATURES)), r.normal(size=(2, 2)))
        lengths = r.integers(1, 7, size=5)
        x = r.normal(size=(int(lengths.sum()), len(linecrf.FEATURES)))
        first = np.concatenate(([0], np.cumsum(lengths)))
        got = field.viterbi(x, first)
        for a, z in zip(first[:-1], first[1:]):
            assert tuple(got[a:z]) == best_path(field, x[a:z])


def test_counts(spark, make_docs):
    rows = [*ODD, (20, "a b c a b c\n\na b c\r\na b c\n x | y #*\nx | y #*", "s"), (21, "\n\n\n", "s"), (22, "a\n" * 500, "s")]
    got = linecrf.score(make_docs(rows, extra=True), linecrf.Field.prior()).collect()
    told = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert told == sorted((str(i), *counts(t)) for i, t, *_ in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    field = linecrf.train(docs, train)
    got = linecrf.score(docs.where("doc_id % 3 = 0"), field).join(held, "doc_id").where("not base_failed").collect()
    right = sum(r.kept == bool(r.quality) for r in got)
    assert len(got) > 50 and right / len(got) > 0.97


def test_training_needs_both_labels(spark, make_docs):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    field = linecrf.train(make_docs(ODD), empty)
    assert np.array_equal(field.weights, linecrf.Field.prior().weights)


def test_filter_keeps_columns(spark, make_docs):
    good = " ".join(f"word{i}" for i in range(80)) + "."
    rows = [*ODD, (30, good, "s"), (31, good.upper().replace(" ", "!! "), "s"), (32, "** " * 90, "s")]
    docs = make_docs(rows, extra=True)
    out = linecrf.keep_good(docs, linecrf.Field.prior())
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [30]
    assert linecrf.keep_good(make_docs([]), linecrf.Field.prior()).count() == 0
