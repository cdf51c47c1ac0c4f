"""Fast exact encoding of whole texts with a byte-level BPE tokenizer file.

The tokenizers' pre-tokens never run from a visible character into a following
space, so a text may be cut there and its pieces encoded apart, or joined with
others.  Natural text repeats its pieces, so distinct pieces are encoded once a
process, many in one joined text, and the ids gathered by numpy; a joined
text's ids fall back into pieces by the bytes each id stands for.  Cuts are made
only before a space whose preceding character is visible ASCII or a two-byte
letter (lead bytes C3-DF), where every definition of white space agrees, and
between an ASCII letter and ASCII punctuation, which no pre-token spans; texts
with a special token's marker are encoded in one piece.
"""

from __future__ import annotations

import os
from itertools import compress

import numpy as np
import pyarrow as pa

from lakelens.llm import textvec as tv

_tokenizers: dict[str, object] = {}
_memories: dict[str, _Memory] = {}
#: Distinct pieces a worker process remembers; past it the memory starts anew.
_REMEMBER = 600_000
_JOINED = 1000  # pieces to a joined text


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer(path: str):
    """The tokenizer, loaded once a process and kept to one thread."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


class _Memory:
    """Ids of pieces seen before: rows of one growing pool, about 40 bytes a piece.

    A piece is known by its 64-bit hash, its length and its first eight bytes; one that
    shares only the hash with another is encoded anew each time.
    """

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():  # byte-level tokens have a character a byte
            self.width[i] = len(token)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)  # sorted
        self.row = np.zeros(0, dtype=np.int64)  # of each key
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.cols = {k: np.zeros(1 << 16, dtype=t) for k, t in _COLUMNS.items()}
        self.n = self.used = 0

    def _add(self, ids: np.ndarray, sizes: np.ndarray, length: np.ndarray, head: np.ndarray) -> np.ndarray:
        n, used = self.n + len(sizes), self.used + len(ids)
        while used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n > len(self.cols["start"]):
            self.cols = {k: np.concatenate([v, np.zeros_like(v)]) for k, v in self.cols.items()}
        self.pool[self.used : used] = ids
        new = {"start": self.used + np.cumsum(sizes) - sizes, "size": sizes, "length": length, "head": head}
        for k, v in new.items():
            self.cols[k][self.n : n] = v
        rows = np.arange(self.n, n)
        self.n, self.used = n, used
        return rows

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece)."""
        sizes = np.zeros(len(pieces), dtype=np.int64)
        free = np.fromiter(map(_joinable, pieces), bool, len(pieces))
        parts: dict[bool, np.ndarray] = {}
        some = list(compress(pieces, free))
        chunks, counts = [], []
        for at in range(0, len(some), 64 * _JOINED):
            part = some[at : at + 64 * _JOINED]
            texts = [b"".join(part[i : i + _JOINED]).decode() for i in range(0, len(part), _JOINED)]
            ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
            last = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1  # ids up to each piece's end
            chunks.append(ids)
            counts.append(np.diff(last, prepend=0))
        if chunks:
            parts[True] = np.concatenate(chunks)
            sizes[free] = np.concatenate(counts)
        rest = [e.ids for e in self.tok.encode_batch_fast([x.decode() for x in compress(pieces, ~free)], add_special_tokens=False)] if not free.all() else []
        if rest:
            parts[False] = np.array([i for e in rest for i in e], dtype=np.uint32)
            sizes[~free] = [len(e) for e in rest]
        if len(parts) == 1:
            return next(iter(parts.values())), sizes
        out = np.zeros(int(sizes.sum()), dtype=np.uint32)
        kind = np.repeat(free, sizes)
        for k, ids in parts.items():
            out[kind == k] = ids
        return out, sizes

    def find(self, pieces: pa.Array) -> np.ndarray:
        """Pool row of each of the distinct pieces, encoding what is new."""
        if self.n > _REMEMBER:
            self.clear()
        buf, off = tv.column_bytes(pieces)
        begin, end = off[:-1], off[1:]
        length = end - begin
        key = tv.span_hash(tv.prefix_hash(buf), begin, end)
        head = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(8, np.uint8)]), 8)[begin].copy()
        head = head.view("<u8").ravel() & _HEADS[np.minimum(length, 8)]
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        rows = np.full(len(key), -1, dtype=np.int64)
        if len(self.keys):
            same = self.keys[at] == key
            rows[same] = self.row[at[same]]
            rows[same & ((self.cols["length"][rows] != length) | (self.cols["head"][rows] != head))] = -1
        new = np.flatnonzero(rows < 0)
        if len(new):
            raw = buf.tobytes()
            ids, sizes = self._encode([raw[a:z] for a, z in zip(begin[new].tolist(), end[new].tolist())])
            rows[new] = self._add(ids, sizes, length[new], head[new])
            # the first of each hash is remembered, unless the hash is taken already
            fresh, first = np.unique(key[new], return_index=True)
            if len(self.keys):
                free = self.keys[np.minimum(np.searchsorted(self.keys, fresh), len(self.keys) - 1)] != fresh
                fresh, first = fresh[free], first[free]
            both = np.concatenate([self.keys, fresh])
            order = np.argsort(both, kind="stable")
            self.keys, self.row = both[order], np.concatenate([self.row, rows[new][first]])[order]
        return rows


#: Masks of the first 0 to 8 bytes of a little-endian word.
_HEADS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_COLUMNS = {"start": np.int64, "size": np.int32, "length": np.int32, "head": np.uint64}


def _joinable(x: bytes) -> bool:
    """Whether a piece starts at a safe cut and leaves one at its end."""
    tail = x[-1]
    safe = 0x21 <= tail < 0x7F or (0x80 <= tail < 0xC0 and 0xC3 <= x[-2] < 0xE0)
    return x[0] == 0x20 and len(x) > 2 and safe and b"<|" not in x


def vocabulary_size(path: str) -> int:
    return tokenizer(path).get_vocab_size(with_added_tokens=True)


_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[0x21:0x7F] = True
_LEAD = np.zeros(256, dtype=bool)
_LEAD[0xC3:0xE0] = True


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PUNCT = _VISIBLE & ~_LETTER
_PUNCT[0x30:0x3A] = False


def _cuts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces begin: each row's start and every safe place inside."""
    flag = np.zeros(len(buf) + 1, dtype=bool)
    if len(buf) > 2:
        before = _VISIBLE[buf[:-1]]
        before[1:] |= (buf[1:-1] >= 0x80) & (buf[1:-1] < 0xC0) & _LEAD[buf[:-2]]
        flag[1:-1] = ((buf[1:] == 0x20) & before) | (_PUNCT[buf[1:]] & _LETTER[buf[:-1]])
    flag[off[:-1]] = True
    flag[len(buf)] = False
    return np.flatnonzero(flag)


def encode(col: pa.Array, path: str, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): each row's ids with ``last`` appended; a null row has only that."""
    buf, off = tv.column_bytes(col)
    rows = len(off) - 1
    marked = np.zeros(rows, dtype=bool)
    bars = np.flatnonzero((buf[:-1] == 0x3C) & (buf[1:] == 0x7C)) if len(buf) > 1 else np.zeros(0, np.int64)
    if len(bars):
        marked[np.searchsorted(off, bars, side="right") - 1] = True
    begin = _cuts(buf, off)
    if marked.any():
        row = np.searchsorted(off, begin, side="right") - 1
        begin = begin[~marked[row] | np.isin(begin, off[:-1])]
    bounds = np.append(begin, len(buf))
    pieces = pa.Array.from_buffers(
        pa.large_binary(),
        len(begin),
        [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))],
    ).dictionary_encode()
    if not len(begin):
        return np.full(rows, last, dtype=np.uint32), np.arange(rows + 1)
    if path not in _memories:
        _memories[path] = _Memory(path)
    memory = _memories[path]
    use = memory.find(pieces.dictionary)[pieces.indices.to_numpy()]
    n = memory.cols["size"][use].astype(np.int64)
    # piece and end-token lengths interleaved per row
    row_first = np.searchsorted(begin, off)
    per_row = np.concatenate(([0], np.cumsum(n)))[row_first]
    lengths = np.diff(per_row) + 1
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    ids = np.full(int(offsets[-1]), last, dtype=np.uint32)
    total = int(n.sum())
    source = np.repeat(memory.cols["start"][use] - (np.cumsum(n) - n), n) + np.arange(total)
    target = np.arange(total) + np.repeat(np.arange(rows), np.diff(per_row))
    ids[target] = memory.pool[source]
    return ids, offsets
