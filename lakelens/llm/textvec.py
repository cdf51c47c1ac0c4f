"""Vectorised byte-level text primitives shared by the operators.

Everything here works on the UTF-8 buffer of an Arrow string column, so whole
batches are tokenised and hashed by numpy without a Python loop per word.
White space is the fixed set 0x20, 0x09-0x0D; none of these bytes occurs inside
a multi-byte UTF-8 sequence, so byte positions are always character-safe.

Defined cases: a null text behaves like an empty one; an empty text has no
words; very long texts are handled whole (batches are cut between rows only).
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix style), vectorised."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


# One random 64-bit value a byte and an odd base: a polynomial hash mod 2**64.
_BYTE_CODE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` mod 2**64, kept for the process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        have = np.ones(size, dtype=U64)
        done = 1
        with np.errstate(over="ignore"):
            while done < size:
                step = U64(pow(base, done, 1 << 64))
                take = min(done, size - done)
                have[done : done + take] = have[:take] * step
                done += take
        _powers[base] = have
    return have[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums S of code(b_i) * base**i; ``span_hash`` reads ranges off it."""
    out = np.zeros(len(buf) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE_CODE[buf] * powers(len(buf)), dtype=U64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes give equal hashes anywhere."""
    inv = powers(len(prefix), _BASE_INV)
    with np.errstate(over="ignore"):
        raw = (prefix[end] - prefix[start]) * inv[start]
        return mix64(raw + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(buffer, offsets): the UTF-8 bytes of a string or binary column; null = empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    if col.null_count:
        empty = pa.scalar("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"", col.type)
        col = col.fill_null(empty)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices_by_bytes(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch between rows into parts of about ``limit`` text bytes (at least a row)."""
    _, off = column_bytes(batch.column(batch.schema.get_field_index(column)))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(off, off[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end
    _give_back()


def _give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and what their
    allocators keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


@dataclass
class Words:
    """Words of a batch of texts: byte starts and ends, and where each row's words lie."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # index of each row's first word; one more than rows

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts())


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; other bytes as they are."""
    return _LOWER[buf]


def words_of(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """All maximal runs of non-white bytes, never across rows."""
    inside = np.empty(len(buf) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[buf], out=inside[1:-1])
    start_flag = inside[1:] & ~inside[:-1]
    end_flag = inside[:-1] & ~inside[1:]
    # a row's edge ends and begins a word even without white space there
    edge = offsets[1:-1]
    edge = np.unique(edge[(edge > 0) & (edge < len(buf))])
    both = edge[inside[edge] & inside[edge + 1]]
    start_flag[both] = True
    end_flag[both] = True
    start = np.flatnonzero(start_flag[:-1])
    end = np.flatnonzero(end_flag)
    first = np.searchsorted(start, offsets, side="left")
    return Words(buf, offsets, start, end, first)


def word_hashes(words: Words) -> np.ndarray:
    return span_hash(prefix_hash(words.buf), words.start, words.end)


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()
