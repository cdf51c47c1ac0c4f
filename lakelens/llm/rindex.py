"""Repeated passages by a run-length Burrows-Wheeler index.

A byte goes if a string of ``Params.length`` bytes that covers it also starts
anywhere else, in the same document or another.

Passages of ``Params.words`` words or more that occur elsewhere are often shorter than
that.  They are not removed but counted: the same steps run over texts in which a code
of ``_CODE`` bytes, cut from the word's hash, stands for each word.  Two unlike words
share a code by a chance of 1 in 2**24.

*Finding what can match.*  Every window of ``length`` bytes is keyed by its
minimizer, the least hash of the ``gram``-byte strings in it.  Equal windows
have equal minimizers, so each maximal run of windows with one minimizer is a
*segment*, and windows can only equal windows in segments of the same key.
Segments with equal bytes are one, with a count; keys with a single segment
that occurs once drop out, unless it holds its minimizer twice and so may match
itself.  Only one copy of each remaining segment is read.  Equal windows have the same
bytes at the same distance from their minimizer, too: of the windows whose minimizer
lies ``a`` to ``b`` bytes in, all bytes that they have in common are hashed, in
``_CLASSES`` such ranges, and only segments that share such a hash with another of their
key (or with themselves, elsewhere) are indexed.

*The index.*  Segments of a range of keys are sorted into a suffix array, from
which the Burrows-Wheeler transform is taken.  Only its runs are kept: where
they begin and end, and the text positions sampled at both ends.  Matching
statistics of the collection against itself follow from those samples alone: at
a run's first (last) suffix the longest common prefix with the suffix before
(after) it is computed from the text; at any other suffix it is one less than
at the text position before.  So they are streamed in text order with a running
maximum.  A window matches elsewhere exactly if its statistic reaches
``length``.

*Hot keys.*  Segments whose key has more than ``Params.most`` distinct ones go
through the same steps once more as texts of their own, keyed by three further
independent minimizers; equal windows still meet.  What is still together then
(texts around one passage nearly as long as a window) is settled window by
window, by their hashes, so no task ever holds an unbounded group.

Defined cases: a null text is an empty one; texts shorter than ``length`` keep
all bytes; rows that repeat an id are separate documents and each other's
copies; an empty table gives an empty result.  Whole segments, and the
windows of what is still hot at the last level, are told apart by 128 bits of hash;
all other windows are compared byte by byte through the index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm import textvec as tv
from lakelens.llm.common import Scratch, shuffle_tasks

U64 = tv.U64
_SLICE = 2 << 20
_SCAN = 1 << 19  # a scan takes many arrays of 8 bytes a byte: these stay in the caches
_COLLECTION = 1 << 18
_CLASSES = 8


@dataclass(frozen=True)
class Params:
    """length: bytes of a passage; gram: bytes of the strings minimizers are taken
    over; most: distinct segments of a key that one index takes; words, gram_words: the
    same in words, for passages that are only counted (words 0: none are)."""

    length: int = 400
    gram: int = 64
    most: int = 256
    words: int = 51
    gram_words: int = 8


_CODE = 3  # bytes of a word's code


#: Seeds of the minimizers that make up a key, by level.
_LEVELS = ((41,), (43, 47, 53))


def _sliding(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum of each ``width`` consecutive elements, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


def _minimizers(grams: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that are some window's minimizer, and their values, in order of value, then position."""
    around = np.concatenate([np.zeros(width - 1, U64), low, np.zeros(width - 1, U64)])
    chosen = np.flatnonzero(_sliding(np.maximum, around, width) == grams)
    order = np.argsort(grams[chosen], kind="stable")
    return chosen[order], grams[chosen][order]


def _twins(at: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
    """Minimizers whose value is some window's minimizer again within ``width``: only around
    these can a segment equal a part of itself."""
    again = (value[1:] == value[:-1]) & (at[1:] - at[:-1] <= width)
    return np.sort(at[:-1][again])


def _pivots(at: np.ndarray, value: np.ndarray, first: np.ndarray, least: np.ndarray, n: int) -> np.ndarray:
    """The first place of the minimizer ``least`` of each window that begins at ``first``."""
    new = np.ones(len(value), dtype=bool)
    new[1:] = value[1:] != value[:-1]
    place = (np.cumsum(new) - 1) * n + at
    return at[np.searchsorted(place, np.searchsorted(value[new], least) * n + first)]


def segments_of(buf: np.ndarray, off: np.ndarray, p: Params, seeds: tuple[int, ...] = _LEVELS[0]) -> dict[str, np.ndarray]:
    """Segments of a batch: row, first window's start in the row, bytes, key, content hash,
    and where the (first) minimizer lies in the segment."""
    none = {k: np.zeros(0, np.int64) for k in ("row", "start", "size", "key", "content", "twin", "pivot")}
    if len(buf) < p.length:
        return none
    prefix = tv.prefix_hash(buf)
    at = np.arange(len(buf) - p.gram + 1)
    grams = tv.span_hash(prefix, at, at + p.gram)
    width = p.length - p.gram + 1
    low = None
    for seed in seeds:
        value = tv.mix64(grams ^ U64(seed))
        least = _sliding(np.minimum, value, width)
        if low is None:
            low = lowest = least
            places, values = _minimizers(value, least, width)
            twins = _twins(places, values, width)
        else:
            low = tv.mix64(low + least)
    n = len(low)
    # windows that lie in one row
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    ok = np.arange(n) + p.length <= off[1:][row]
    new = np.empty(n, dtype=bool)
    new[0] = True
    new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new & ok)
    if not len(first):
        return none
    # a run ends where the next begins, or with the row's last window
    nxt = np.append(np.flatnonzero(new)[1:], n)
    last = nxt[np.searchsorted(np.flatnonzero(new), first)]
    last = np.minimum(last, off[1:][row[first]] - p.length + 1)
    end = last - 1 + p.length
    content = tv.span_hash(prefix, first, end)
    return {
        "row": row[first],
        "start": first - off[row[first]],
        "size": end - first,
        "key": low[first].view(np.int64),
        "content": content.view(np.int64),
        "twin": (np.searchsorted(twins, end - p.gram, side="right") > np.searchsorted(twins, first)).astype(np.int64),
        "pivot": _pivots(places, values, first, lowest[first], len(grams)) - first,
    }


def _stable_order(key: np.ndarray, bound: int) -> np.ndarray:
    """Stable argsort of keys in [0, bound): where key and place fit 63 bits, by sorting
    both as one number, which numpy does much faster."""
    place = max(1, len(key) - 1).bit_length()
    if bound.bit_length() + place > 63:
        return np.argsort(key, kind="stable")
    both = (key << place) | np.arange(len(key))
    both.sort()
    return both & ((1 << place) - 1)


def _suffix_array(text: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes in order of their bytes up to their segment's end, but at most of as many
    as the last number given, which is ``depth`` or more if segments are so long; ties by
    position.  The second array has those that are like others as far.
    ``left``: bytes from each position to its segment's end.

    Prefix doubling from a few bytes on; only positions still tied are sorted again, and
    a tied position's rank is the first row of its group."""
    n = len(text)
    seen = np.bincount(text, minlength=256) > 0
    base = int(seen.sum()) + 1
    code = np.cumsum(seen)[text]  # from 1 on; past the segment's end read as 0
    have = max(1, int((62 - max(1, n - 1).bit_length()) / np.log2(base)))
    pad = np.concatenate([code, np.zeros(have, np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for k in range(have):
        key = key * base + np.where(left > k, pad[k : n + k], 0)
    order = _stable_order(key, base**have)
    rank = np.zeros(n, dtype=np.int64)
    rows, key = np.arange(n), key[order]
    deepest = min(depth, int(left.max(initial=0)))
    while True:
        new = np.concatenate(([True], key[1:] != key[:-1]))
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        rank[order[rows]] = rows[start][group] + 1
        many = np.diff(np.append(start, len(rows))) > 1
        tied = many[group]
        rows = rows[tied]
        if not len(rows) or have >= deepest:
            return order, order[rows], have
        group = (np.cumsum(many) - 1)[group[tied]]
        at = order[rows]
        ahead = np.where(left[at] > have, rank[np.minimum(at + have, n - 1)], 0)
        key = group * (n + 1) + ahead
        again = _stable_order(key, int(many.sum()) * (n + 1))
        order[rows] = at[again]
        key = key[again]
        have *= 2


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix at a and b, at most ``most``."""
    out = np.zeros(len(a), dtype=np.int64)
    alive = np.flatnonzero(most > 0)
    wide = np.concatenate([text, np.zeros(7, np.uint8)])
    words = np.ndarray(len(text), "<u8", wide, strides=(1,)).copy()  # eight bytes from each place on
    while len(alive):
        differ = words[a[alive] + out[alive]] ^ words[b[alive] + out[alive]]
        same = np.full(len(alive), 8)
        ends = np.flatnonzero(differ)
        last = differ[ends]
        # the lowest set bit is in the first byte that differs
        same[ends] = np.log2((last & (~last + U64(1))).astype(np.float64)).astype(np.int64) >> 3
        out[alive] += same
        alive = alive[(same == 8) & (out[alive] < most[alive])]
    return np.minimum(out, most)


@dataclass
class RunIndex:
    """Run-compressed transform: rows where runs begin and end, and the text positions
    sampled there with their neighbours outside the run."""

    head: np.ndarray  # suffix at each run's first row (not row 0)
    before: np.ndarray  # suffix one row above it
    tail: np.ndarray  # suffix at each run's last row (not the last row)
    after: np.ndarray  # suffix one row below it
    runs: int
    tied: np.ndarray  # suffixes that have a match of ``depth`` bytes, or to their segment's end
    depth: int

    @staticmethod
    def build(text: np.ndarray, left: np.ndarray, depth: int) -> RunIndex:
        order, tied, depth = _suffix_array(text, left, depth)
        # the symbol before each suffix; a segment's first suffix has a symbol of its own
        begins = np.zeros(len(text), dtype=bool)
        begins[0] = True
        begins[1:] = left[1:] > left[:-1]
        bwt = text[order - 1].astype(np.int64)
        own = begins[order]
        bwt[own] = 256 + np.flatnonzero(own)
        cut = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        return RunIndex(order[cut], order[cut - 1], order[cut - 1], order[cut], len(cut) + 1, tied, depth)


def matching_statistics(text: np.ndarray, left: np.ndarray, depth: int = 1 << 62) -> np.ndarray:
    """For each position the longest match with any other position, or ``depth`` or more where
    it is as long; from the samples at run ends, streamed in text order.

    Suffixes are sorted no deeper than asked.  Those still tied then are samples too: else
    the one after a tied suffix would count from a match that was not looked for."""
    index = RunIndex.build(text, left, depth)
    at = np.arange(len(text))
    ties = np.zeros(len(text), dtype=np.int64)
    ties[index.tied] = np.minimum(left[index.tied], index.depth)
    best = np.zeros(len(text), dtype=np.int64)
    for suffix, other in ((index.head, index.before), (index.tail, index.after)):
        sampled = ties.copy()
        new = ties[suffix] == 0
        suffix, other = suffix[new], other[new]
        sampled[suffix] = _common(text, suffix, other, np.minimum(left[suffix], left[other]))
        reach = np.maximum.accumulate(np.where(sampled > 0, sampled + at, 0))
        best = np.maximum(best, reach - at)
    return np.minimum(best, left)


def _intervals(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flag.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_SEGMENTS = "row_id long, start long, size long, key long, content long, twin long, pivot long"


def _find_segments(p: Params, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices_by_bytes(batch, "text", _SCAN):
                got = segments_of(*tv.column_bytes(part.column("text")), p, _LEVELS[level])
                ids = part.column("row_id").take(pa.array(got["row"]))
                names = ("start", "size", "key", "content", "twin", "pivot")
                yield pa.record_batch([ids, *(pa.array(got[k]) for k in names)], names=["row_id", *names])

    return run


def _window_hashes(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices_by_bytes(batch, "bytes", _SLICE):
                buf, off = tv.column_bytes(part.column("bytes"))
                n = np.maximum(np.diff(off) - p.length + 1, 0)
                row = np.repeat(np.arange(len(n)), n)
                start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = off[row] + start
                # 128 bits: the same hash of two unlike images of the bytes
                values = [tv.span_hash(tv.prefix_hash(x), at, at + p.length).view(np.int64) for x in (buf, buf ^ np.uint8(0xA5))]
                cols = [part.column(c).take(pa.array(row)) for c in ("key", "content")]
                yield pa.record_batch([*cols, pa.array(start), *map(pa.array, values)], names=["key", "content", "start", "window", "image"])

    return run


_CUT = "key long, content long, kinds long, pivot long, bytes binary"


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted segments of each document."""
    for batch in batches:
        for part in tv.slices_by_bytes(batch, "text", _SLICE):
            buf, off = tv.column_bytes(part.column("text"))
            keys, contents, kinds, pivots, data = [], [], [], [], []
            for i, wanted in enumerate(part.column("wanted").to_pylist()):
                for s in wanted:
                    keys.append(s["key"])
                    contents.append(s["content"])
                    kinds.append(s["kinds"])
                    pivots.append(s["pivot"])
                    data.append(buf[off[i] + s["start"] : off[i] + s["start"] + s["size"]].tobytes())
            yield pa.record_batch(
                [*(pa.array(x, pa.int64()) for x in (keys, contents, kinds, pivots)), pa.array(data, pa.binary())],
                names=["key", "content", "kinds", "pivot", "bytes"],
            )


def may_match(text: np.ndarray, size: np.ndarray, key: np.ndarray, pivot: np.ndarray, p: Params) -> np.ndarray:
    """Whether a window of each segment can start elsewhere in its key's segments; those of
    ``text`` lie end to end, and every window holds the string at its segment's ``pivot``."""
    end = np.cumsum(size)
    begin = end - size
    prefix = tv.prefix_hash(text)
    every = np.arange(len(text) - p.gram + 1)
    grams = tv.span_hash(prefix, every, every + p.gram)
    segment = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(grams == grams[begin + pivot][segment[: len(grams)]])
    at = at[at + p.gram <= end[segment[at]]]
    segment, salt = segment[at], tv.mix64(key.view(U64))
    found = np.zeros(len(size), dtype=bool)
    reach = p.length - p.gram + 1
    step = -(-reach // _CLASSES)
    for near in range(0, reach, step):
        far = min(near + step, reach) - 1
        low, high = at - near, at + p.length - far
        ok = (low >= begin[segment]) & (high <= end[segment])
        of = segment[ok]
        value = tv.span_hash(prefix, low[ok], high[ok]) ^ salt[of]
        order = np.argsort(value)
        same = value[order[1:]] == value[order[:-1]]
        found[of[order[1:][same]]] = True
        found[of[order[:-1][same]]] = True
    return found


def _match_segments(p: Params):
    """Rows come by key; whole keys are gathered into collections of some 256 kB,
    each indexed at once.  Gives the matching windows of each segment that may match."""
    def matched(keys: list, contents: list, pivots: list, data: list) -> Iterator[pa.RecordBatch]:
        size = np.array([len(x) for x in data], dtype=np.int64)
        text = np.frombuffer(b"".join(data), dtype=np.uint8)
        some = np.flatnonzero(may_match(text, size, np.array(keys, dtype=np.int64), np.array(pivots, dtype=np.int64), p)).tolist()
        if not some:
            return
        keys, contents, data = ([x[i] for i in some] for x in (keys, contents, data))
        size = size[some]
        text = np.frombuffer(b"".join(data), dtype=np.uint8)
        end = np.cumsum(size)
        left = np.repeat(end, size) - np.arange(len(text))
        hit = matching_statistics(text, left, p.length) >= p.length
        starts, ends = [], []
        for a, z in zip((end - size).tolist(), end.tolist()):
            s, e = _intervals(hit[a:z])
            starts.append(s)
            ends.append(e)
        yield pa.record_batch(
            [
                pa.array(keys, pa.int64()),
                pa.array(contents, pa.int64()),
                pa.array(starts, pa.list_(pa.int64())),
                pa.array(ends, pa.list_(pa.int64())),
            ],
            names=["key", "content", "lows", "highs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, contents, pivots, data, total = [], [], [], [], 0
        for b in batches:
            for k, c, at, x in zip(*(b.column(n).to_pylist() for n in ("key", "content", "pivot", "bytes"))):
                if total >= _COLLECTION and k != keys[-1]:
                    yield from matched(keys, contents, pivots, data)
                    keys, contents, pivots, data, total = [], [], [], [], 0
                keys.append(k)
                contents.append(c)
                pivots.append(at)
                data.append(x)
                total += len(x)
        if keys:
            yield from matched(keys, contents, pivots, data)

    return run


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text with a code for each of its words."""
    for batch in batches:
        for part in tv.slices_by_bytes(batch, "text", _SLICE):
            words = tv.words_of(*tv.column_bytes(part.column("text")))
            codes = tv.word_hashes(words).astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - _CODE :]
            offsets = (words.first * _CODE).astype(np.int32)
            text = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(codes))])
            yield pa.record_batch([part.column("row_id"), text], names=["row_id", "text"])


def _covered(marks: list, length: int, unit: int) -> np.ndarray:
    """Starts and ends of what the windows of ``marks`` cover, in units; windows start at
    whole units."""
    lows = np.concatenate([np.array(m["lows"], dtype=np.int64) + m["start"] for m in marks])
    highs = np.concatenate([np.array(m["highs"], dtype=np.int64) + m["start"] for m in marks])
    first, last = -(-lows // unit), (highs - 1) // unit
    some = first <= last
    first, end = first[some], last[some] + length // unit
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    new = np.ones(len(first), dtype=bool)
    new[1:] = first[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return np.stack([first[at], reach[np.append(at[1:], len(first)) - 1]], axis=1) if len(at) else np.zeros((0, 2), np.int64)


_REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed binary, n_passage_words long"


def _apply(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices_by_bytes(batch, "text", _SLICE):
                buf, off = tv.column_bytes(part.column("text"))
                out: list[list] = [[], [], [], [], [], []]
                passages = part.column("word_marks").to_pylist()
                for i, marks in enumerate(part.column("marks").to_pylist()):
                    body = buf[off[i] : off[i + 1]]
                    gone = _covered(marks, p.length, 1) if marks else np.zeros((0, 2), np.int64)
                    keep = np.ones(len(body), dtype=bool)
                    for s, e in gone.tolist():
                        keep[s:e] = False
                    words = _covered(passages[i], p.words * _CODE, _CODE) if passages[i] else np.zeros((0, 2), np.int64)
                    left = hashlib.sha256(body[keep].tobytes()).hexdigest()
                    row = (len(body), int((~keep).sum()), len(gone), left, gone.tobytes(), int(np.diff(words, axis=1).sum()))
                    for k, v in enumerate(row):
                        out[k].append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64())
                yield pa.record_batch(
                    [part.column("doc_id"), *(pa.array(v, t) for v, t in zip(out, kinds))],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "n_passage_words"],
                )

    return run


def _hits(spark: SparkSession, texts: DataFrame, p: Params, scratch: Scratch, level: int = 0) -> tuple[DataFrame, DataFrame]:
    """(segments, hits) of ``texts`` (row_id, text): the segments whose key has several
    occurrences, and of each distinct one the runs of windows that start elsewhere too."""
    t = f"l{level}"
    found = scratch.keep(
        texts.where(F.octet_length("text") >= p.length).mapInArrow(_find_segments(p, level), _SEGMENTS), f"{t}-found"
    )
    keys = found.groupBy("key").agg(F.count("*").alias("n"), F.max("twin").alias("twin")).where("n > 1 or twin > 0")
    keys = scratch.keep(keys.select("key"), f"{t}-keys")
    live = scratch.keep(found.join(keys, "key"), f"{t}-live")
    scratch.drop(f"{t}-found", f"{t}-keys")
    kinds = scratch.keep(
        live.groupBy("key", "content").agg(
            F.count("*").alias("copies"), F.max("twin").alias("twin"), F.min(F.struct("row_id", "start", "size", "pivot")).alias("at")
        ),
        f"{t}-kinds",
    )
    many = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.max("twin").alias("twin"))
    many = scratch.keep(many.where("kinds > 1 or twin > 0").select("key", "kinds"), f"{t}-many")
    wanted = (
        kinds.join(many, "key")
        .select(
            F.col("at.row_id").alias("row_id"),
            F.struct("key", "content", "kinds", *(F.col(f"at.{c}").alias(c) for c in ("start", "size", "pivot"))).alias("s"),
        )
        .groupBy("row_id")
        .agg(F.collect_list("s").alias("wanted"))
    )
    cut = texts.join(wanted, "row_id").select("text", "wanted").mapInArrow(_cut_segments, _CUT)
    cut = scratch.keep(cut, f"{t}-cut")
    part = "key long, content long, lows array<long>, highs array<long>"
    matched = (
        cut.where(F.col("kinds") <= p.most)
        .select("key", "content", "pivot", "bytes")
        .repartition(shuffle_tasks(spark), "key")
        .sortWithinPartitions("key", "content")
        .mapInArrow(_match_segments(p), part)
        .where(F.size("lows") > 0)
    )
    hot = cut.where(F.col("kinds") > p.most).select("key", "content", "bytes")
    if many.where(F.col("kinds") > p.most).limit(1).count():
        if level + 1 < len(_LEVELS):
            named = hot.withColumn("row_id", F.xxhash64("key", "content"))
            inner, deeper = _hits(spark, named.select("row_id", F.col("bytes").alias("text")), p, scratch, level + 1)
            # an inner hit's windows, counted from its segment's start
            found = inner.join(deeper, ["key", "content"]).groupBy("row_id").agg(F.collect_list(F.struct("start", "lows", "highs")).alias("w"))
            moved = "transform(w, x -> zip_with(x.lows, x.highs, (l, h) -> struct(l + x.start as low, h + x.start as high)))"
            merged = found.select("row_id", F.expr(f"array_sort(array_distinct(flatten({moved})))").alias("w"))
            extra = named.select("row_id", "key", "content").join(merged, "row_id").select(
                "key", "content", F.expr("w.low").alias("lows"), F.expr("w.high").alias("highs")
            )
        else:
            windows = scratch.keep(
                hot.mapInArrow(_window_hashes(p), "key long, content long, start long, window long, image long"), f"{t}-windows"
            )
            twice = scratch.keep(windows.groupBy("window", "image").count().where("count > 1").select("window", "image"), f"{t}-twice")
            extra = (
                windows.join(twice, ["window", "image"])
                .groupBy("key", "content")
                .agg(F.sort_array(F.collect_list("start")).alias("lows"))
                .select("key", "content", "lows", F.expr("transform(lows, x -> x + 1)").alias("highs"))
            )
        matched = matched.union(extra)
    # a segment that occurs twice matches throughout
    whole = kinds.where("copies > 1").select(
        "key", "content", F.expr("array(0L)").alias("lows"), F.expr(f"array(at.size - {p.length} + 1)").alias("highs")
    )
    single = kinds.where("copies = 1").select("key", "content")
    hits = scratch.keep(whole.union(matched.join(single, ["key", "content"])), f"{t}-hits")
    scratch.drop(f"{t}-cut", f"{t}-kinds", f"{t}-many")
    return live, hits


def _marks(live: DataFrame, hits: DataFrame, name: str) -> DataFrame:
    """The windows of each row that match, as ``name``."""
    found = live.join(hits, ["key", "content"]).select("row_id", F.struct("start", "lows", "highs").alias("mark"))
    return found.groupBy("row_id").agg(F.collect_set("mark").alias(name))


def remove_repeats(spark: SparkSession, docs: DataFrame, params: Params = Params()) -> DataFrame:
    """Per document: bytes, removed bytes and spans, hash of the rest, the removed ranges
    (pairs of little-endian longs), and the words in passages that occur elsewhere."""
    p = params
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Rows equal in id and text are copies of each other and get equal results.
    docs = docs.withColumn("row_id", F.xxhash64("doc_id", "text"))
    texts = docs.select("row_id", "text")
    scratch = Scratch(spark, "rindex")
    marks = scratch.keep(_marks(*_hits(spark, texts, p, scratch), "marks"), "marks")
    scratch.drop("l0-live", "l0-hits")
    if p.words:
        inner = Params(length=p.words * _CODE, gram=p.gram_words * _CODE, most=p.most, words=0)
        coded = texts.where(F.octet_length("text") >= 2 * p.words - 1).mapInArrow(_coded, "row_id long, text binary")
        coded = scratch.keep(coded.where(F.octet_length("text") >= inner.length), "coded")
        words = Scratch(spark, "rindex-words")
        passages = scratch.keep(_marks(*_hits(spark, coded, inner, words), "word_marks"), "word-marks")
        words.drop("l0-live", "l0-hits")
        scratch.drop("coded")
        marks = marks.join(passages, "row_id", "full")
    else:
        marks = marks.withColumn("word_marks", F.expr("cast(null as array<struct<start: bigint, lows: array<bigint>, highs: array<bigint>>>)"))
    marked = docs.join(marks, "row_id", "left").select("doc_id", "text", "marks", "word_marks")
    return marked.mapInArrow(_apply(p), _REMOVED)
