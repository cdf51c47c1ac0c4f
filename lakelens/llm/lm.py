"""Language-model scoring with deleted interpolation.

Bigram, unigram and uniform maximum-likelihood estimates are mixed,

    p(w | h) = a2 * c(h w) / c(h)  +  a1 * c(w) / N  +  a0 / (V + 1),

with weights that depend on how often the context h was seen (buckets of powers
of two) and are learned by expectation-maximisation on held-out counts: a fixed
part of the training documents is left out of the counts while the weights are
learned, and joins them for scoring.

*How it is spread.*  Texts are stored once in compressed chunks.  Every chunk
asks for the counts of its distinct words and bigrams: sorted 64-bit (words) and
48-bit (bigrams) hashes, cut into hash ranges and packed, go to the ranges'
tasks together with the chunk's own counts; those sum them over all chunks and
answer each chunk in its own order.  What is shuffled grows with the number of
distinct bigrams of the chunks, and no task holds more than a hash range or a
chunk, whatever the skew of words.  More than ``fan`` chunks are counted in a tree:
``fan`` chunks are merged into one in each of ``fan`` hash ranges, which are cut again as
finely, until at most ``fan`` merged chunks are left; answers go down the same way.  So
each level has ``fan`` rows a chunk, never a row for every pair of chunk and range.  Weights are learned from a histogram of the
held-out tokens over a fixed grid of estimate pairs (an eighth of a nat wide,
each cell with its mean), which is all that reaches the driver.

Two words share a hash by a chance of n**2 / 2**65 for n distinct words; a given
bigram shares its own by n / 2**48 for n distinct bigrams.

Defined cases: a null text is an empty one, whose only token is the end; words
never seen in training have a count of 0; a null doc_id counts as training; rows
that repeat count as often as they occur; an empty table gives an empty result.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm import textvec as tv
from lakelens.llm.common import Scratch, shared_folder, shuffle_tasks

U64 = tv.U64


@dataclass(frozen=True)
class Params:
    """folds: documents fall into by their id's crc32; held_out: the fold that is never
    learned from; deleted: the training fold that weights are learned on; chunk: text
    bytes of a chunk; fan: chunks merged at once, and parts of a hash range; rounds: of
    the expectation-maximisation."""

    folds: int = 5
    held_out: int = 1
    deleted: int = 2
    chunk: int = 6 << 20
    fan: int = 256
    rounds: int = 60


_BUCKETS = 24
_GRID = 8  # cells a nat
_CELLS = 512


def _bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count)), the last open-ended."""
    return np.minimum(np.ceil(np.log2(count + 1.0)), _BUCKETS - 1).astype(np.int64)


@dataclass
class Tokens:
    """Tokens of a chunk: the words of each text and then its end."""

    first: np.ndarray
    words: np.ndarray  # distinct hashes, sorted
    word: np.ndarray  # index into words, by token
    context: np.ndarray  # index into words of the context; that of the end for a start
    pairs: np.ndarray
    pair: np.ndarray

    @staticmethod
    def of(col: pa.Array) -> Tokens:
        buf, off = tv.column_bytes(col)
        words = tv.words_of(tv.lowered(buf), off)
        h = tv.word_hashes(words)
        n = words.counts() + 1
        first = np.concatenate(([0], np.cumsum(n)))
        end = tv.mix64(np.array([0xE0D], dtype=U64))[0]
        token = np.full(int(first[-1]), end, dtype=U64)
        token[np.arange(len(h)) + words.row_of()] = h
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[first[:-1]] = end
        with np.errstate(over="ignore"):
            key = tv.mix64(token * U64(0x9E3779B97F4A7C15) + tv.mix64(before ^ U64(0xB1)))
        distinct, word = np.unique(token, return_inverse=True)
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[first[:-1]] = np.searchsorted(distinct, end)
        pairs, pair = np.unique(key >> U64(16), return_inverse=True)
        return Tokens(first, distinct, word, context, pairs, pair)

    def spread(self, per_row: np.ndarray) -> np.ndarray:
        return np.repeat(per_row, np.diff(self.first))


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def _squeeze(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T
    return _codec().compress(np.ascontiguousarray(raw).tobytes(), asbytes=True)


def _expand(body: bytes, n: int, kind) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(_codec().decompress(body, n * kind.itemsize, asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).ravel()


def _cuts(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where each hash range begins among sorted keys."""
    edges = [(k << bits) // ranges for k in range(1, ranges)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(edges, dtype=U64)), [len(keys)])).astype(np.int64)


class _Chunks:
    """Texts stored in files of the shared folder, each written by one task attempt."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, p: Params):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get()
            fs, root = pafs.FileSystem.from_uri(self.folder)
            fs.create_dir(root, recursive=True)
            held, size, count = [], 0, 0

            def flush() -> pa.RecordBatch:
                whole = pa.Table.from_batches(held).combine_chunks()
                name = f"{task.partitionId():06d}-{count:04d}-{task.taskAttemptId()}.arrow"
                options = pa.ipc.IpcWriteOptions(compression=_codec())
                with fs.open_output_stream(f"{root}/{name}") as out, pa.ipc.new_file(out, whole.schema, options=options) as writer:
                    writer.write_table(whole)
                return pa.record_batch([pa.array([(task.partitionId() << 24) + count], pa.int64()), pa.array([name])], names=["chunk", "name"])

            for batch in batches:
                for part in tv.slices_by_bytes(batch, "text", p.chunk):
                    _, off = tv.column_bytes(part.column("text"))
                    if held and size + int(off[-1]) > p.chunk:
                        yield flush()
                        held, size, count = [], 0, count + 1
                    held.append(part)
                    size += int(off[-1])
            if held:
                yield flush()

        return run

    def read(self, name: str) -> pa.RecordBatch:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        with fs.open_input_file(f"{root}/{name}") as f:
            whole = pa.ipc.open_file(f).read_all().combine_chunks()
        return whole.to_batches()[0]


def _requests(chunks: _Chunks, p: Params, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, name in zip(batch.column("chunk").to_pylist(), batch.column("name").to_pylist()):
                rows = chunks.read(name)
                got = Tokens.of(rows.column("text"))
                fold = got.spread(rows.column("fold").to_numpy())
                kept = (fold != p.held_out) & (fold != p.deleted)
                away = fold == p.deleted
                for base, keys, index, bits in ((0, got.words, got.word, 64), (ranges, got.pairs, got.pair, 48)):
                    own = [np.bincount(index[m], minlength=len(keys)).astype(np.uint32) for m in (kept, away)]
                    cut = _cuts(keys, bits, ranges)
                    out: list[list] = [[], [], [], []]
                    for k in range(ranges):
                        a, z = int(cut[k]), int(cut[k + 1])
                        if a == z:
                            continue
                        step = np.diff(keys[a:z], prepend=U64(0))
                        for col, v in zip(out, (base + k, _squeeze(step), _squeeze(own[0][a:z]), _squeeze(own[1][a:z]))):
                            col.append(v)
                    n = [int(x) for x in np.diff(cut) if x]
                    if n:
                        yield pa.record_batch(
                            [pa.array(out[0], pa.int64()), pa.array([chunk] * len(n), pa.int64()), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])],
                            names=["slice", "unit", "n", "steps", "kept", "away"],
                        )

    return run


_REQUEST = "slice long, unit long, n long, steps binary, kept binary, away binary"
_ANSWER = "slice long, unit long, n long, kept binary, full binary, sum_kept long, sum_full long, words long"


def _grouped(batches: Iterator[pa.RecordBatch], by: int, columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows as tuples, gathered while the first ``by`` columns stay the same."""
    held, now = [], None
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in columns)):
            if row[:by] != now and held:
                yield now, held
                held = []
            now = row[:by]
            held.append(row[by:])
    if held:
        yield now, held


def _joined(rows: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, order of all keys, where each distinct one begins in it, place of each
    key among the distinct ones) of rows of (n, steps)."""
    keys = np.concatenate([np.cumsum(_expand(steps, n, np.uint64), dtype=U64) for n, steps in rows])
    order = np.argsort(keys, kind="stable")
    ks = keys[order]
    new = np.concatenate(([True], ks[1:] != ks[:-1]))
    place = np.empty_like(order)
    place[order] = np.cumsum(new) - 1
    return ks[new], order, np.flatnonzero(new), place


def _summed(bodies: list[tuple[int, bytes]], order: np.ndarray, first: np.ndarray, kind) -> np.ndarray:
    own = np.concatenate([_expand(x, n, kind) for n, x in bodies]).astype(np.int64)
    return np.add.reduceat(own[order], first)


def _answers(slices: int, kind):
    """Rows come by slice.  Sums counts over all units and answers each; a row with a null
    unit carries the slice's totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (rng,), rows in _grouped(batches, 1, ("slice", "unit", "n", "steps", "kept", "away")):
            _, order, first, place = _joined([(n, s) for _, n, s, _, _ in rows])
            kept = _summed([(r[1], r[3]) for r in rows], order, first, kind)
            full = kept + _summed([(r[1], r[4]) for r in rows], order, first, kind)
            at, out = 0, []
            for unit, n, *_ in rows:
                mine = place[at : at + n]
                out.append((rng, unit, n, _squeeze(kept[mine].astype("<u8")), _squeeze(full[mine].astype("<u8")), None, None, None))
                at += n
            if rng < slices:
                out.append((rng, None, 0, b"", b"", int(kept.sum()), int(full.sum()), int((full > 0).sum())))
            yield _answer_rows(out)

    return run


def _answer_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = ["slice", "unit", "n", "kept", "full", "sum_kept", "sum_full", "words"]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _merged(slices: int, fan: int, kind):
    """Rows come by slice and group.  A group's units become one, cut into ``fan`` slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (rng, group), rows in _grouped(batches, 2, ("slice", "grp", "n", "steps", "kept", "away")):
            keys, order, first, _ = _joined([(n, s) for n, s, _, _ in rows])
            sums = [_summed([(r[0], r[k]) for r in rows], order, first, kind).astype(np.uint64) for k in (2, 3)]
            bits, own = (64, rng) if rng < slices else (48, rng - slices)
            edges = [((own * fan + k) << bits) // (slices * fan) for k in range(1, fan)]
            cut = np.concatenate(([0], np.searchsorted(keys, np.array(edges, dtype=U64)), [len(keys)])).tolist()
            out = [
                (rng * fan + k, group, z - a, _squeeze(np.diff(keys[a:z], prepend=U64(0))), _squeeze(sums[0][a:z]), _squeeze(sums[1][a:z]))
                for k, (a, z) in enumerate(zip(cut, cut[1:]))
                if z > a
            ]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["slice", "unit", "n", "steps", "kept", "away"])

    return run


def _passed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by slice and group: first the merged unit's answers in order of their
    slices, then the requests of the units it was made of, which are answered."""
    for (rng, _), rows in _grouped(batches, 2, ("slice", "grp", "late", "place", "n", "steps", "kept", "full")):
        told, asked = [r for r in rows if not r[0]], [r for r in rows if r[0]]
        kept, full = (np.concatenate([_expand(r[k], r[2], "<u8") for r in told]) for k in (4, 5))
        _, _, _, place = _joined([(r[2], r[3]) for r in asked])
        at, out = 0, []
        for _, unit, n, *_ in asked:
            mine = place[at : at + n]
            out.append((rng, unit, n, _squeeze(kept[mine]), _squeeze(full[mine]), None, None, None))
            at += n
        yield _answer_rows(out)


def _count(requests: DataFrame, units: int, slices: int, tasks: int, p: Params, scratch: Scratch, level: int = 0) -> DataFrame:
    """Answers to ``requests`` of ``units`` units in ``slices`` slices each of words and bigrams."""
    kind = np.uint64 if level else np.uint32  # a chunk's own counts are small
    if units <= p.fan:
        dealt = requests.repartition(min(2 * slices, tasks), "slice").sortWithinPartitions("slice", "unit")
        return scratch.keep(dealt.mapInArrow(_answers(slices, kind), _ANSWER), f"answers-{level}")
    groups = -(-units // p.fan)
    requests = scratch.keep(requests, f"requests-{level}").withColumn("grp", F.pmod(F.xxhash64("unit"), F.lit(groups)))
    dealt = requests.repartition(tasks, "slice", "grp").sortWithinPartitions("slice", "grp", "unit")
    deeper = _count(dealt.mapInArrow(_merged(slices, p.fan, kind), _REQUEST), groups, slices * p.fan, tasks, p, scratch, level + 1)
    none = F.lit(None).cast("binary")
    asked = requests.select("slice", "grp", F.lit(True).alias("late"), F.col("unit").alias("place"), "n", "steps", none.alias("kept"), none.alias("full"))
    told = deeper.where("unit is not null").select(
        F.expr(f"slice div {p.fan}").alias("slice"), F.col("unit").alias("grp"), F.lit(False), F.col("slice").alias("place"), "n", none, "kept", "full"
    )
    both = asked.union(told).repartition(tasks, "slice", "grp").sortWithinPartitions("slice", "grp", "late", "place")
    answers = both.mapInArrow(_passed_down, _ANSWER).union(deeper.where("unit is null"))
    answers = scratch.keep(answers, f"answers-{level}")
    scratch.drop(f"requests-{level}", f"answers-{level + 1}")
    return answers


def _by_chunk(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[str, list[np.ndarray]]]:
    """(file, counts of words, counts of pairs) of each chunk; rows come by chunk and range."""
    now, name, parts = None, None, ([], [])
    for b in batches:
        rows = zip(*(b.column(c).to_pylist() for c in ("chunk", "name", "pairs", "n", column)))
        for chunk, file, kind, n, body in rows:
            if chunk != now and now is not None:
                yield name, [np.concatenate(x) if x else np.zeros(0, np.int64) for x in parts]
                parts = ([], [])
            now, name = chunk, file
            parts[int(kind)].append(_expand(body, n, "<u8").astype(np.int64))
    if now is not None:
        yield name, [np.concatenate(x) if x else np.zeros(0, np.int64) for x in parts]


@dataclass(frozen=True)
class Totals:
    """Training tokens without and with the deleted part, and distinct words of all."""

    kept: int
    full: int
    words: int


def _histogram(chunks: _Chunks, p: Params, totals: Totals):
    """Deleted tokens by context bucket and grid cell of (bigram, unigram) estimates."""
    floor = 1.0 / (totals.words + 1)

    def cell(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)  # 0: an estimate of 0
        some = x > 0
        out[some] = np.clip(np.floor(np.log(x[some] / floor) * _GRID) + _CELLS // 2, 1, _CELLS - 1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, (words, pairs) in _by_chunk(batches, "kept"):
            rows = chunks.read(name)
            got = Tokens.of(rows.column("text"))
            m = got.spread(rows.column("fold").to_numpy()) == p.deleted
            if not m.any():
                continue
            context = words[got.context[m]]
            p2 = np.where(context > 0, pairs[got.pair[m]] / np.maximum(context, 1), 0.0)
            p1 = words[got.word[m]] / max(totals.kept, 1)
            key = (_bucket(context) * _CELLS + cell(p2)) * _CELLS + cell(p1)
            at, index = np.unique(key, return_inverse=True)
            yield pa.record_batch(
                [
                    pa.array(at),
                    pa.array(np.bincount(index).astype(np.int64)),
                    pa.array(np.bincount(index, weights=p2)),
                    pa.array(np.bincount(index, weights=p1)),
                ],
                names=["cell", "n", "p2", "p1"],
            )

    return run


def learn_weights(cells: np.ndarray, n: np.ndarray, p2: np.ndarray, p1: np.ndarray, totals: Totals, rounds: int) -> np.ndarray:
    """(a2, a1, a0) for each context bucket, by expectation-maximisation."""
    bucket = cells // (_CELLS * _CELLS)
    p0 = np.full(len(cells), 1.0 / (totals.words + 1))
    parts = np.stack([p2 / np.maximum(n, 1), p1 / np.maximum(n, 1), p0], axis=1)
    weights = np.tile([0.3, 0.5, 0.2], (_BUCKETS, 1))
    weights[0] = [0.0, 0.8, 0.2]
    # a little evidence for every part, so that none is ruled out for new texts
    prior = np.array([0.5, 0.5, 0.5]) * (np.arange(_BUCKETS) > 0)[:, None] + np.array([[0.0, 0.5, 0.5]]) * (np.arange(_BUCKETS) == 0)[:, None]
    for _ in range(rounds):
        share = weights[bucket] * parts
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        mass = prior + np.stack([np.bincount(bucket, weights=share[:, k], minlength=_BUCKETS) for k in range(3)], axis=1)
        weights = mass / mass.sum(axis=1, keepdims=True)
    return weights


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(chunks: _Chunks, p: Params, totals: Totals, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, (words, pairs) in _by_chunk(batches, "full"):
            rows = chunks.read(name)
            got = Tokens.of(rows.column("text"))
            count, context = words[got.word], words[got.context]
            base = np.log10((count + 0.5) / (totals.full + 0.5 * (totals.words + 1)))
            a = weights[_bucket(context)]
            p2 = np.where(context > 0, pairs[got.pair] / np.maximum(context, 1), 0.0)
            prob = a[:, 0] * p2 + a[:, 1] * (count / max(totals.full, 1)) + a[:, 2] / (totals.words + 1)
            at = got.first[:-1]
            per = lambda x: np.add.reduceat(x, at)  # noqa: B023, E731
            yield pa.record_batch(
                [
                    rows.column("doc_id"),
                    pa.array(rows.column("fold").to_numpy() == p.held_out),
                    pa.array(np.diff(got.first).astype(np.int64)),
                    pa.array(per((count > 0).astype(np.int64))),
                    pa.array(np.full(len(at), totals.full, dtype=np.int64)),
                    pa.array(per(base)),
                    pa.array(per(np.log10(prob))),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score(spark: SparkSession, docs: DataFrame, params: Params = Params()) -> DataFrame:
    """Base and model score of every document."""
    p = params
    scratch = Scratch(spark, "lm")
    chunks = _Chunks(f"{shared_folder(spark)}/lm-chunks-{uuid.uuid4().hex}")
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(p.folds)).cast("int")
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), fold.alias("fold")
    )
    stored = scratch.keep(docs.mapInArrow(chunks.write(p), "chunk long, name string"), "stored")
    n = stored.count()
    tasks = max(1, min(n, 4 * shuffle_tasks(spark)))
    slices = max(1, shuffle_tasks(spark) // 2, n // 3) if n <= p.fan else p.fan
    asked = stored.repartition(tasks).mapInArrow(_requests(chunks, p, slices), _REQUEST)
    answers = _count(asked, n, slices, max(2 * shuffle_tasks(spark), n), p, scratch)
    sums = answers.where("unit is null").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("sum_kept", "sum_full", "words"))).first()
    totals = Totals(*sums)

    def replies(column: str) -> DataFrame:
        rows = answers.where("unit is not null").withColumnRenamed("unit", "chunk").join(stored, "chunk")
        rows = rows.select("chunk", "slice", "name", (F.col("slice") >= slices).cast("int").alias("pairs"), "n", column)
        return rows.repartition(tasks, "chunk").sortWithinPartitions("chunk", "slice")

    cells = (
        replies("kept")
        .mapInArrow(_histogram(chunks, p, totals), "cell long, n long, p2 double, p1 double")
        .groupBy("cell")
        .agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1"))
        .orderBy("cell")
        .collect()  # bounded by the grid
    )
    grid = [np.array([r[k] for r in cells]) for k in range(4)]
    weights = learn_weights(grid[0].astype(np.int64), *grid[1:], totals, p.rounds)
    return replies("full").mapInArrow(_scores(chunks, p, totals, weights), _SCORES)
