"""Quality rules with line sequence labelling by a linear-chain CRF.

Each line of a text is content or boilerplate.  A linear-chain conditional
random field scores line features and transitions between neighbouring lines;
Viterbi decoding labels a document's lines, and the share of word characters in
content lines decides whether it stays.  Fixed rules on length and repetition
come first.

The field is trained here, by gradient ascent on the exact conditional
likelihood (forward-backward), on a bounded sample of labelled documents:
``Params.sample`` documents of each quality at most, those whose ids hash
lowest.  A line takes its document's quality as its label.  All statistics used
for the decision are the document's own, over its whole text.

Defined cases: a null text is an empty one; empty or blank texts fail the base
rule; without labels of both qualities the field stays at its prior weights,
where symbols, shouting and word runs speak against a line; rows that repeat
get equal verdicts; an empty table gives an empty result.  The filter returns
its input's own columns, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.llm import textvec as tv
from lakelens.llm.common import bounded_batches

U64 = tv.U64
_SLICE = 2 << 20
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Params:
    """sample: labelled documents of each quality to fit on, at most; sample_lines: lines
    of a document to fit on, at most; rounds, rate, ridge: of the gradient ascent;
    min_share: least share of content."""

    sample: int = 1000
    sample_lines: int = 4096
    rounds: int = 300
    rate: float = 0.1
    ridge: float = 1.0
    min_share: float = 0.5
    min_words: int = 50
    max_repeat_percent: int = 50


def _flags(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(members)] = 1
    return out


_HIGH = np.int64(1) << 32
_POINT = (np.arange(256) & 0xC0 != 0x80).astype(np.int64)
_POINT[[0x20, *range(0x09, 0x0E)]] = 0  # code points in words
_UPPER = _flags(bytes(range(0x41, 0x5B)))
_LETTER = _flags(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]))
_COUNTED = (
    _POINT + _HIGH * _flags(_SYMBOLS),
    _UPPER + _HIGH * _LETTER,
    _flags(b"0123456789") + _HIGH * _flags(b"!?"),
)

FEATURES = ("bias", "symbols", "shouting", "digits", "marks", "runs", "distinct", "repeated", "short", "long_words", "ended")


@dataclass
class Lines:
    """Per-line and per-document statistics of a batch."""

    row: np.ndarray
    features: np.ndarray
    points: np.ndarray
    counts: dict[str, np.ndarray]
    first: np.ndarray


def _group(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of its value in order, value found more than once) for each element."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), dtype=bool)
    again[order[1:][same]] = True  # equal to an earlier one
    many = again.copy()
    many[order[:-1][same]] = True
    return ~again, many


def analyse(buf: np.ndarray, off: np.ndarray) -> Lines:
    rows = len(off) - 1
    words = tv.words_of(buf, off)
    prefix = tv.prefix_hash(buf)
    h = tv.span_hash(prefix, words.start, words.end)
    of = words.row_of()
    breaks = np.flatnonzero(buf == 10)
    # a line begins at a row's start and after each line feed
    lines_in = np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1]) + 1
    first = np.concatenate(([0], np.cumsum(lines_in)))
    row = np.repeat(np.arange(rows), lines_in)
    start = np.empty(len(row), dtype=np.int64)
    head = np.zeros(len(row), dtype=bool)
    head[first[:-1]] = True
    start[head] = off[:-1]
    start[~head] = breaks + 1
    end = np.empty(len(row), dtype=np.int64)
    tail = np.zeros(len(row), dtype=bool)
    tail[first[1:] - 1] = True
    end[tail] = off[1:]
    end[~tail] = breaks
    sums = []
    total = np.zeros(len(buf) + 1, dtype=np.int64)
    for code in _COUNTED:
        np.cumsum(code[buf], out=total[1:])
        part = total[end] - total[start]
        sums += [part & (_HIGH - 1), part >> 32]
    points, symbols, upper, letters, digits, marks = sums
    w0, w1 = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    n = w1 - w0
    # words equal to the one before in the same line, and to an earlier one in it
    line_of = np.repeat(np.arange(len(row)), n)
    twin = np.zeros(len(h) + 1, dtype=np.int64)
    if len(h) > 1:
        twin[2:] = np.cumsum((h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1]))
    runs = np.where(n > 0, twin[w1] - twin[np.minimum(w0 + 1, len(h))], 0)
    with np.errstate(over="ignore"):
        fresh, _ = _group(tv.mix64(h + line_of.astype(U64) * U64(0x9E3779B97F4A7C15)))
        line_key = tv.mix64(tv.span_hash(prefix, start, end) + row.astype(U64) * U64(0x9E3779B97F4A7C15))
    seen = np.concatenate(([0], np.cumsum(fresh)))
    distinct = seen[w1] - seen[w0]
    busy = n > 0
    earlier = np.zeros(len(row), dtype=bool)
    first_line, _ = _group(line_key[busy])
    earlier[busy] = ~first_line
    # three-word windows found again in the same document
    covered = np.zeros(len(h) + 1, dtype=np.int64)
    if len(h) >= 3:
        with np.errstate(over="ignore"):
            key = tv.mix64(h[:-2] * U64(3) + tv.mix64(h[1:-1] * U64(5) + tv.mix64(h[2:] + of[2:].astype(U64))))
        inside = np.flatnonzero(of[:-2] == of[2:])
        _, many = _group(key[inside])
        at = inside[many]
        edge = np.zeros(len(h) + 1, dtype=np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + 3, -1)
        covered[1:] = np.cumsum(np.cumsum(edge)[:-1] > 0)
    per_row = lambda x: np.add.reduceat(x, first[:-1]) if rows else np.zeros(0, np.int64)
    counts = {
        "n_words": words.counts().astype(np.int64),
        "word_chars": per_row(points),
        "n_symbols": per_row(symbols),
        "n_dup_lines": per_row(earlier.astype(np.int64)),
        "n_repeat_words": covered[words.first[1:]] - covered[words.first[:-1]],
    }
    safe = np.maximum(points, 1)
    last = np.where(n > 0, words.end[np.maximum(w1 - 1, 0)] - 1 if len(h) else 0, 0)
    ended = np.isin(buf[last], list(b".!?:;\"'")) if len(buf) else np.zeros(len(row), bool)
    features = np.stack(
        [
            np.ones(len(row)),
            np.minimum(symbols / safe * 5, 3),
            upper / np.maximum(letters, 1),
            digits / safe,
            np.minimum(marks / safe * 5, 3),
            runs / np.maximum(n, 1),
            distinct / np.maximum(n, 1),
            earlier.astype(float),
            1 / (1.0 + n),
            np.minimum(points / np.maximum(n, 1) / 20, 3),
            ended & (n > 0),
        ],
        axis=1,
    ).astype(np.float64)
    return Lines(row, features, points, counts, first)


@dataclass
class Field:
    """Linear-chain CRF over two labels: 0 content, 1 boilerplate.  ``weights`` score
    label 1 against 0 on a line; ``moves[i, j]`` scores label j after i."""

    weights: np.ndarray
    moves: np.ndarray

    @staticmethod
    def prior() -> Field:
        start = {"bias": -2.0, "symbols": 2.0, "shouting": 3.0, "marks": 1.0, "runs": 4.0}
        return Field(np.array([start.get(k, 0.0) for k in FEATURES]), np.array([[0.5, -0.5], [-0.5, 0.5]]))

    def viterbi(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best label sequence of each row's lines; all rows step together."""
        score = features @ self.weights
        counts = np.diff(first)
        order = np.argsort(-counts, kind="stable")
        at, n = first[:-1][order], counts[order]
        back = np.zeros((len(score), 2), dtype=np.int8)
        best = np.zeros((len(n), 2))
        alive = int(np.searchsorted(-n, 0))
        best[:alive, 1] = score[at[:alive]]
        for t in range(1, int(n[0]) if len(n) else 0):
            alive = int(np.searchsorted(-n, -t))  # rows with more than t lines
            ways = best[:alive, :, None] + self.moves
            pick = ways.argmax(axis=1)
            back[at[:alive] + t] = pick
            best[:alive] = np.take_along_axis(ways, pick[:, None, :], axis=1)[:, 0]
            best[:alive, 1] += score[at[:alive] + t]
        labels = np.zeros(len(score), dtype=np.int8)
        state = best.argmax(axis=1).astype(np.int8)
        for t in range((int(n[0]) if len(n) else 0) - 1, -1, -1):
            alive = int(np.searchsorted(-n, -t))
            labels[at[:alive] + t] = state[:alive]
            if t:
                state[:alive] = back[at[:alive] + t, state[:alive]]
        return labels


def fit(sequences: list[tuple[np.ndarray, int]], p: Params) -> Field:
    """Maximise the regularised conditional log likelihood of line labels."""
    field = Field.prior()
    if len({label for _, label in sequences}) < 2:
        return field
    n = np.array([len(x) for x, _ in sequences])
    longest, size, width = int(n.max()), len(n), len(FEATURES)
    order = np.argsort(-n, kind="stable")
    n = n[order]
    alive = [int(np.searchsorted(-n, -t)) for t in range(longest)]
    x = np.zeros((int(n.sum()), width))
    y = np.zeros(size, dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(n)))
    for k, i in enumerate(order):
        x[first[k] : first[k + 1]], y[k] = sequences[i]
    # a document counts once, however many lines it has
    share = np.repeat(1.0 / n, n)
    truth = np.repeat(y, n)
    theta = np.concatenate([field.weights, field.moves.ravel()])
    target = theta.copy()
    m = v = np.zeros_like(theta)
    moved = np.bincount(y * 3, weights=(n - 1) / n, minlength=4)  # label to itself
    for step in range(1, p.rounds + 1):
        w, moves = theta[:width], theta[width:].reshape(2, 2)
        score = np.stack([np.zeros(len(x)), x @ w], axis=1)
        fore, hind = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        fore[first[:-1]] = score[first[:-1]]
        for t in range(1, longest):
            i = first[: alive[t]] + t
            fore[i] = np.logaddexp(fore[i - 1, :1] + moves[0], fore[i - 1, 1:] + moves[1]) + score[i]
        for t in range(longest - 1, 0, -1):
            i = first[: alive[t]] + t
            ahead = hind[i] + score[i]
            hind[i - 1] = np.logaddexp(ahead[:, :1] + moves[:, 0], ahead[:, 1:] + moves[:, 1])
        whole = np.logaddexp(fore[first[1:] - 1, 0], fore[first[1:] - 1, 1])
        z = np.repeat(whole, n)
        p1 = np.exp(fore[:, 1] + hind[:, 1] - z)
        grad = np.empty_like(theta)
        grad[:width] = x.T @ (share * (truth - p1))
        i = np.ones(len(x), dtype=bool)
        i[first[:-1]] = False
        i = np.flatnonzero(i)
        pair = np.exp(fore[i - 1][:, :, None] + moves + (hind[i] + score[i])[:, None, :] - z[i][:, None, None])
        grad[width:] = moved - (pair * share[i][:, None, None]).sum(axis=0).ravel()
        grad -= p.ridge * 0.01 * (theta - target)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Field(theta[:width], theta[width:].reshape(2, 2))


def _line_features(most: int):
    """Each document's line features; of one with more than ``most`` lines a run of that
    many from a place its own features decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices_by_bytes(batch, "text", _SLICE):
                got = analyse(*tv.column_bytes(part.column("text")))
                rows = []
                for a, z in zip(got.first[:-1].tolist(), got.first[1:].tolist()):
                    if z - a > most:
                        a += zlib.crc32(got.features[a:z].tobytes()) % (z - a - most + 1)
                        z = a + most
                    rows.append(got.features[a:z].tobytes())
                yield pa.record_batch([pa.array(rows, pa.binary()), part.column("quality")], names=["features", "quality"])

    return run


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Field:
    """Fit on at most ``p.sample`` labelled documents of each quality, and of each at most
    ``p.sample_lines`` lines; equal rows of an id count once."""
    bounded_batches(docs.sparkSession)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = None
    for quality in (0, 1):
        some = labels.where((F.col("quality") == quality) & F.col("doc_id").isNotNull()).distinct()
        some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample)
        picked = some if picked is None else picked.union(some)
    # at most 2 * sample ids are broadcast
    rows = docs.join(F.broadcast(picked), "doc_id").select("text", "quality")
    rows = rows.mapInArrow(_line_features(p.sample_lines), "features binary, quality int").distinct()
    fitted = []
    for quality in (0, 1):
        some = rows.where(F.col("quality") == quality).orderBy(F.xxhash64("features"), "features").limit(p.sample)
        fitted += [(np.frombuffer(r.features).reshape(-1, len(FEATURES)), 1 - quality) for r in some.collect()]
    return fit(fitted, p)


def _verdict(part: pa.RecordBatch, field: Field, p: Params) -> tuple[Lines, dict[str, np.ndarray]]:
    col = part.column(part.schema.get_field_index("text"))
    got = analyse(*tv.column_bytes(col))
    label = field.viterbi(got.features, got.first)
    rows = part.num_rows
    content = np.bincount(got.row, weights=np.where(label == 0, got.points, 0), minlength=rows)
    c = got.counts
    share = content / np.maximum(c["word_chars"], 1)
    failed = (c["n_words"] < p.min_words) | (100 * c["n_repeat_words"] > p.max_repeat_percent * c["n_words"])
    return got, c | {"content_share": share, "base_failed": failed, "kept": ~failed & (share >= p.min_share)}


_VERDICT = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(k, T.LongType()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("content_share", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
)


def score(docs: DataFrame, field: Field, p: Params = Params()) -> DataFrame:
    """Counts and verdict of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices_by_bytes(batch, "text", _SLICE):
                _, out = _verdict(part, field, p)
                names = _VERDICT.fieldNames()[1:]
                yield pa.record_batch([part.column(0), *(pa.array(out[k]) for k in names)], names=["doc_id", *names])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, _VERDICT)


def keep_good(docs: DataFrame, field: Field, p: Params = Params()) -> DataFrame:
    """The documents that pass, in their own columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices_by_bytes(batch, "text", _SLICE):
                yield part.filter(pa.array(_verdict(part, field, p)[1]["kept"]))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
