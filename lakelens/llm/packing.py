"""Packing token sequences: Martello-Toth dominance reduction, then best fit.

Documents become pieces of at most ``capacity`` ids.  Lengths are integers, so
the instance is a histogram of piece lengths, however many documents there are.
The plan is made on it:

1. *Reduction.*  Taking each length from the longest on, a set of at most three
   pieces with it is fixed for good where it provably dominates every other (nothing
   fits beside it; one partner fills it up or is the best of the at most one
   that fits; a pair is the best of the at most two that fit).  Equal choices
   are fixed in bulk.  Passes are made until no rule applies to any length.
2. *Best fit.*  What remains goes, longest first, to the fullest sequence that
   takes it; sequences with equal fill are handled together.

The plan is a list of patterns with multiplicities.  Pieces of each length are
numbered, in salted groups so that a hot length is no hot task, and the number
alone decides a piece's sequence and offset.

Defined cases: a null text is an empty one, which is a piece of one id; only
longer documents are cut, with the shorter piece first; rows that repeat are
packed each; an empty table gives an empty result.  Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.llm import textvec as tv
from lakelens.llm import tokens
from lakelens.llm.common import Scratch

_SLICE = 2 << 20


@dataclass(frozen=True)
class Params:
    """capacity: ids a sequence holds; end: id put after each document; group_rows: pieces
    that a salted group numbers when all have one length; path: the tokenizer file."""

    capacity: int = 1024
    end: int = 2
    group_rows: int = 500_000
    path: str = field(default_factory=tokens.default_path)


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences that hold pieces of these lengths, in this order."""

    lengths: tuple[int, ...]
    times: int


class _Counts:
    """Multiset of lengths with nearest-length lookups."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 2, dtype=np.int64)
        for length, times in counts.items():
            self.n[length] += times

    def at_most(self, length: int) -> int:
        """Longest length present that is no more than ``length``; 0 if none."""
        have = np.flatnonzero(self.n[1 : length + 1]) if length > 0 else ()
        return int(have[-1]) + 1 if len(have) else 0

    def shortest(self, k: int, above: int = 0) -> list[int]:
        """The k shortest pieces longer than ``above`` (fewer if there are not as many)."""
        out: list[int] = []
        for length in (np.flatnonzero(self.n[above + 1 :]) + above + 1).tolist():
            out += [length] * int(min(self.n[length], k - len(out)))
            if len(out) == k:
                break
        return out


def _best_pair(c: _Counts, room: int) -> tuple[int, int]:
    """Two pieces with the largest sum within ``room``; (0, 0) if no two fit."""
    best = (0, 0)
    for a in np.flatnonzero(c.n[: room + 1]).tolist()[::-1]:
        if 2 * a <= sum(best):
            break
        b = c.at_most(min(a, room - a))
        if b == a and c.n[a] < 2:
            b = c.at_most(a - 1)
        if b and a + b > sum(best):
            best = (a, b)
    return best


def _dominating(c: _Counts, length: int, capacity: int) -> tuple[int, ...] | None:
    """Partners of a piece of this length in a set that dominates all others, if one is proven."""
    c.n[length] -= 1
    try:
        room = capacity - length
        partner = c.at_most(room)
        if not partner:
            return ()
        if partner == room:
            return (partner,)
        small = c.shortest(3)
        if len(small) < 2 or sum(small[:2]) > room:
            return (partner,)
        if len(small) < 3 or sum(small) > room:  # at most two fit beside it
            a, b = _best_pair(c, room)
            if partner >= a + b:
                return (partner,)
            # every feasible pair has a piece no longer than b if no two longer ones fit
            longer = c.shortest(2, above=b)
            if b and a == partner and (len(longer) < 2 or sum(longer) > room):
                return (a, b)
        return None
    finally:
        c.n[length] += 1


def reduce_and_fit(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], int]:
    """Patterns that hold all pieces, and how many of their sequences the reduction fixed."""
    c = _Counts(counts, capacity)
    plan: list[Pattern] = []
    fixed = 0
    more = True
    while more:  # a piece that is fixed may let a rule apply to longer ones
        more, length = False, c.at_most(capacity)
        while length:
            partners = _dominating(c, length, capacity)
            if partners is None:
                length = c.at_most(length - 1)
                continue
            chosen = (length, *partners)
            need = {x: chosen.count(x) for x in chosen}
            times = int(min(c.n[x] // k for x, k in need.items()))
            # the tests only grow truer as pieces go, and the chosen ones last: fix in bulk
            plan.append(Pattern(chosen, times))
            fixed += times
            for x, k in need.items():
                c.n[x] -= k * times
            more, length = True, c.at_most(length)
    # best fit, longest first: open sequences by room left, equal ones together
    rooms: dict[int, list[list]] = {}
    for length in range(capacity, 0, -1):
        left = int(c.n[length])
        while left:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                each = capacity // length
                if left >= each:
                    new = [(length,) * each, left // each]
                else:
                    new = [(length,) * left, 1]
                left -= len(new[0]) * new[1]
                rooms.setdefault(capacity - length * len(new[0]), []).append(new)
                continue
            group = rooms[room][-1]
            times = min(left, group[1])
            left -= times
            group[1] -= times
            if not group[1]:
                rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
            rooms.setdefault(room - length, []).append([(*group[0], length), times])
    plan += [Pattern(lengths, times) for groups in rooms.values() for lengths, times in groups]
    return plan, fixed


@dataclass
class Lookup:
    """Plan as ranges: pieces ``low`` up to the next entry's low of a length go to
    consecutive sequences from ``base`` at ``offset``."""

    length: np.ndarray
    low: np.ndarray
    base: np.ndarray
    offset: np.ndarray

    @staticmethod
    def of(plan: list[Pattern]) -> Lookup:
        used: dict[int, int] = {}
        rows, base = [], 0
        for pattern in plan:
            offset = 0
            for length in pattern.lengths:
                low = used.get(length, 0)
                rows.append((length, low, base, offset))
                used[length] = low + pattern.times
                offset += length
            base += pattern.times
        rows.sort()
        got = np.array(rows, dtype=np.int64).reshape(-1, 4)
        return Lookup(*got.T)

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces given their length and number within it."""
        out = np.zeros((2, len(length)), dtype=np.int64)
        first = np.searchsorted(self.length, length, side="left")
        last = np.searchsorted(self.length, length, side="right")
        for k in np.unique(length).tolist():
            at = np.flatnonzero(length == k)
            a, z = int(first[at[0]]), int(last[at[0]])
            i = a + np.searchsorted(self.low[a:z], number[at], side="right") - 1
            out[0, at] = self.base[i] + number[at] - self.low[i]
            out[1, at] = self.offset[i]
        return out[0], out[1]


def _cut(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices_by_bytes(batch, "text", _SLICE):
                ids, off = tokens.encode(part.column("text"), p.path, p.end)
                size = np.diff(off)
                first = (size - 1) % p.capacity + 1  # the first piece may be shorter
                n = (size - 1) // p.capacity + 1
                row = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * p.capacity)
                length = np.where(piece == 0, first[row], p.capacity)
                raw = ids.astype("<u4").tobytes()
                at = (off[row] + start) * 4
                crc = [zlib.crc32(raw[a:z]) for a, z in zip(at.tolist(), (at + length * 4).tolist())]
                yield pa.record_batch(
                    [part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack(spark: SparkSession, docs: DataFrame, params: Params | None = None) -> DataFrame:
    """A row per piece with its sequence and the offset there."""
    p = params or Params()
    scratch = Scratch(spark, "packing")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.keep(docs.mapInArrow(_cut(p), _PIECES), "pieces")
    # a row a length
    total = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").collect()}
    plan, _ = reduce_and_fit(total, p.capacity)
    lookup = Lookup.of(plan)
    groups = 64 * -(-max(1, sum(total.values())) // (64 * p.group_rows))
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(groups)).cast("int"))
    counts = pieces.groupBy("length", "grp").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("length").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    before = scratch.keep(counts.select("length", "grp", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before")), "before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy()
            number = b.column("number").to_numpy()
            seq, offset = lookup.place(length, number)
            yield pa.record_batch(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    order = Window.partitionBy("length", "grp").orderBy("doc_id", "piece", "ids_crc32")
    numbered = pieces.withColumn("rank", F.row_number().over(order)).join(before, ["length", "grp"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank") - 1).alias("number"))
    return numbered.mapInArrow(place, f"{_PIECES}, sequence_id long, offset long")
