"""Secret scanning through nested encodings.

A document is a worklist of *layers*.  The text itself is the first; every
layer is scanned with the rules and then unwrapped: percent-encoding and
Unicode escapes are decoded in place, base64 runs (and what they hold when it
is gzip, zlib, bzip2 or xz data) become layers of their own.  Each new layer
goes back on the list until nothing new appears.  A layer already seen at the
same place is not entered again, so cycles end.  Layers are bytes, whether or not
they are text (all rules are ASCII).  A base64 run is decoded at all four
alignments, whole, between its '/', '-' and '_', and joined with the lines before
and after it that hold nothing else (indented or not; some line or, if none is
indented, all together of 20 characters).  Compressed data is looked for at every
offset of decoded layers, so also in percent-encoding and escapes.  Every layer
maps each of its bytes to the range of the original text that it came from; a secret
found in a layer is reported as the range of original code points that encode it.

Defined cases: a null text is an empty one; texts are scanned whole; repeated
rows get equal results; undecodable runs are left alone; compressed data is decoded
in full, all members of it, at any depth; a layer of over ``Params.max_layer`` bytes
is a mapped file, so that decompression bombs cost disk and time but not memory; of
broken compressed data what comes ahead of the fault is read.  Redaction returns its
input's own columns, whatever their names.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import mmap
import re
import tempfile
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.llm import textvec as tv
from lakelens.llm.common import bounded_batches

_SLICE = 2 << 20

KINDS = ("assign", "access", "hex")
_RANK = {k: i for i, k in enumerate(KINDS)}
# Letters of the first rule match in either case, ASCII only.
_ASSIGN = re.compile(
    rb"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")  # a maximal run, so as good as any run of 16 or more
_MIN_VALUE, _MIN_ACCESS = 12, 18
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

_PERCENT = re.compile(rb"(?:%[0-9A-Fa-f]{2})+")
_NUMBERED = rb"\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"
_ESCAPE = re.compile(_NUMBERED)
_LITERAL = re.compile(_NUMBERED + rb"|\\[abfnrtv0\\'\"]")  # as in a literal of bytes
_SHORT = dict(zip(b"abfnrtv0\\'\"", b"\a\b\f\n\r\t\v\0\\'\"", strict=True))
_CODE = re.compile(rb"[0-9A-Fa-f]+")
_BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{20,}")  # of either alphabet
_PARTS = tuple(re.compile(c + rb"{20,}") for c in (rb"[A-Za-z0-9+/]", rb"[A-Za-z0-9+_-]", rb"[A-Za-z0-9+]"))  # between '-' and '_', '/', or all three
# Lines of nothing else, after the end of one and before the start of another; breaks may be escaped ones.
_LINE = re.compile(rb"[A-Za-z0-9+/_-]++(?P<break>[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t]*+(?=[A-Za-z0-9+/_-]|\Z))?")
_BLOCK = re.compile(rb"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]++[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t]*+(?=[A-Za-z0-9+/_-]))++(?P<last>[A-Za-z0-9+/_-]++)")
_LINE_END = re.compile(rb"=|[ \t]*(?:\r?\n|(?:\\r)?\\n|\Z)")
_ZLIB = b"|".join(
    re.escape(bytes([first, second]))
    for first in range(0x08, 0x80, 0x10)
    for second in range(256)
    if (first * 256 + second) % 31 == 0 and not second & 0x20  # a preset dictionary is not at hand
)
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?=1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|" + _ZLIB)


@dataclass(frozen=True)
class Params:
    """max_layer: bytes of a layer that are held in memory; a longer one is a file."""

    max_layer: int = 64 << 20


class _Spool:
    """Collects bytes, in a file of the task's temp folder once they are many."""

    def __init__(self, most: int):
        self.most, self.size, self.memory, self.file = most, 0, bytearray(), None

    def write(self, data: bytes) -> None:
        self.size += len(data)
        if self.file is None and self.size > self.most:
            self.file = tempfile.TemporaryFile()
            self.file.write(self.memory)
            self.memory = bytearray()
        if self.file is None:
            self.memory += data
        else:
            self.file.write(data)

    def done(self) -> bytes | mmap.mmap:
        if self.file is None:
            return bytes(self.memory)
        self.file.flush()
        with self.file:
            return mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)


def _slices(data: bytes | mmap.mmap, start: int, end: int) -> Iterator[bytes]:
    for at in range(start, end, _SLICE):
        yield data[at : min(at + _SLICE, end)]


@dataclass
class Layer:
    """Bytes, and how a range of them maps to a range of the layer they came from."""

    data: bytes | mmap.mmap
    parent: Layer | None = None  # None: the original text, a byte a character
    origin: Callable[[int, int], tuple[int, int]] | None = None  # None: any range of the parent's, all being the same
    flat: bool = False  # all bytes came from the same range

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The range of the original text that bytes [start, end) came from."""
        layer = self
        while layer.parent is not None:
            if layer.origin is not None:
                start, end = layer.origin(start, end)
            layer = layer.parent
        return start, end


def _as_bytes(text: str) -> bytes:
    """A byte a code point; those that no byte stands for are in no rule or encoding."""
    return text.encode("latin-1", "replace")


def _scan(data: bytes | mmap.mmap) -> Iterator[tuple[str, int, int]]:
    if not isinstance(data, bytes) or any(k.encode() in folded for folded in [data.lower()] for k in _KEYWORDS):
        yield from (("assign", *m.span()) for m in _ASSIGN.finditer(data) if m.end(2) - m.start(2) >= _MIN_VALUE)
    if data.find(b"AKIA") >= 0:
        yield from (("access", *m.span()) for m in _ACCESS.finditer(data) if m.end() - m.start() >= _MIN_ACCESS)
    yield from (("hex", *m.span()) for m in _HEX.finditer(data))


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret in plain sight."""
    return list(_scan(_as_bytes(text)))


def _percent(run: bytes) -> tuple[bytes, int]:
    return bytes.fromhex(run.replace(b"%", b"").decode()), 3


def _escape(one: bytes) -> tuple[bytes, int]:
    if one[1] in _SHORT and len(one) == 2:
        return bytes([_SHORT[one[1]]]), 2
    code = int(_CODE.search(one, 2)[0], 10 if one[:1] == b"&" and one[2] not in b"xX" else 16)
    return (bytes([code]) if code < 256 else b"?"), len(one)


def _decoded_in_place(layer: Layer, pattern: re.Pattern, decode, most: int, spaces: bool = False) -> Layer | None:
    """A layer with every match of ``pattern`` replaced by what ``decode`` gives for it:
    bytes, and how many bytes of the match stand for each.  ``spaces``: '+' is one."""
    data, at, size, out = layer.data, 0, 0, _Spool(most)
    outs, sources, steps = [0], [0], [1]  # stretches of one step each

    def gap(start: int, end: int) -> None:
        for piece in _slices(data, start, end):
            out.write(piece.replace(b"+", b" ") if spaces else piece)

    for m in pattern.finditer(data):
        found, step = decode(m[0])
        if not layer.flat:
            if m.start() > at and steps[-1] != 1:
                outs.append(size), sources.append(at), steps.append(1)
            size += m.start() - at
            if m.start() > at or steps[-1] != step:
                outs.append(size), sources.append(m.start()), steps.append(step)
            size += len(found)
        gap(at, m.start())
        out.write(found)
        at = m.end()
    if not at:
        return None
    gap(at, len(data))
    outs.append(size), sources.append(at), steps.append(1)

    def origin(start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(outs, start) - 1, bisect_right(outs, end - 1) - 1
        return sources[i] + (start - outs[i]) * steps[i], sources[j] + (end - outs[j]) * steps[j]

    return Layer(out.done(), layer, None if layer.flat else origin, layer.flat)


def _decompressor(head: bytes):
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return zlib.decompressobj()


_BROKEN = (zlib.error, OSError, EOFError, lzma.LZMAError)
_FEED = 1 << 14
_CHANCE = 64  # bytes that look like zlib data by chance break earlier


def _member(view: memoryview, start: int, out: _Spool) -> tuple[int, bool]:
    """Unpacks the member at ``start`` as far as it is sound; where it ends; whether
    it was whole."""
    at = start
    engine = _decompressor(bytes(view[start : start + 6]))
    inflate = hasattr(engine, "unconsumed_tail")
    while at < len(view) and not engine.eof:
        piece = view[at : at + _FEED]
        before, had = engine.copy() if inflate else None, 0
        try:
            rest = piece
            while True:
                got = engine.decompress(rest, _SLICE)
                out.write(got)
                had += len(got)
                rest = engine.unconsumed_tail if inflate else b""
                if engine.eof or (not rest if inflate else engine.needs_input):
                    break
        except _BROKEN:
            if before is not None:  # what comes ahead of the fault
                try:
                    for i in range(len(piece)):
                        at += 1
                        rest = piece[i : i + 1]
                        while rest:
                            got = before.decompress(rest, _SLICE)
                            out.write(got[had:])
                            had = max(0, had - len(got))
                            rest = before.unconsumed_tail
                except _BROKEN:
                    pass
            return at, False
        at += len(piece)
    return at - len(engine.unused_data), engine.eof


def _unpacked(view: memoryview, start: int, most: int) -> tuple[bytes | mmap.mmap | None, int, int]:
    """What the compressed data at ``start`` holds, one member after the other; where
    it ends; where to look for more."""
    out, end, at = _Spool(most), start, start
    while m := _MAGIC.match(view, at):
        weak = len(m[0]) == 2
        got = _Spool(most) if weak else out
        z, sound = _member(view, at, got)
        if weak and not sound and at > 0 and z - at < _CHANCE:
            return out.done(), end, at + 1
        if weak and got.size:
            data = got.done()
            for piece in _slices(data, 0, len(data)):
                out.write(piece)
        end = z
        if not sound:
            return out.done(), end, at + 1
        at = end
        while at < len(view) and not view[at]:  # padding
            at += 1
    return out.done(), end, end


def _compressed_layers(layer: Layer, most: int) -> Iterator[Layer]:
    view, at = memoryview(layer.data), 0
    while m := _MAGIC.search(layer.data, at):
        start = m.start()
        out, end, at = _unpacked(view, start, most)
        if out:
            yield Layer(out, layer, None if layer.flat else lambda a, z, whole=(start, end): whole, True)


def _decoded_base64(layer: Layer, start: int, end: int, most: int) -> Iterator[Layer]:
    """The four alignments of the run that the lines in [start, end) make."""
    def lines() -> Iterator[tuple[int, int]]:
        return ((p.start(), p.start("break") if p["break"] else p.end()) for p in _LINE.finditer(layer.data, start, end))

    spans = [] if layer.flat else list(lines())
    begins = [0, *accumulate(z - a for a, z in spans)]

    def source(i: int) -> int:
        k = bisect_right(begins, i) - 1
        return spans[k][0] + i - begins[k]

    def pieces() -> Iterator[bytes]:
        have = bytearray()
        for a, z in spans or lines():
            for piece in _slices(layer.data, a, z):
                have += piece
                if len(have) >= _SLICE:
                    yield bytes(have)
                    have.clear()
        yield bytes(have)

    for at in range(4):
        out, rest, skip = _Spool(most), b"", at
        for piece in pieces():
            rest += piece[skip:]
            skip = 0
            n = len(rest) & -4
            out.write(base64.b64decode(rest[:n].translate(_URL_SAFE)))
            rest = rest[n:]
        if len(rest) > 1:
            out.write(base64.b64decode(rest.translate(_URL_SAFE) + b"=" * (4 - len(rest))))

        def origin(a: int, z: int, at: int = at) -> tuple[int, int]:
            return source(at + a * 8 // 6), source(at + (z * 8 - 1) // 6) + 1

        yield Layer(out.done(), layer, None if layer.flat else origin, layer.flat)


def _base64_layers(layer: Layer, most: int) -> Iterator[Layer]:
    """Every run at each of its four alignments, since it may be glued to what is
    before it; then the parts of it that a separator cuts off; then the blocks of lines."""
    data = layer.data
    for m in _BASE64.finditer(data):
        yield from _decoded_base64(layer, *m.span(), most)
        seen = {m.span()}
        for part in _PARTS:
            for p in part.finditer(data, *m.span()):
                if p.span() not in seen:
                    if part is not _PARTS[-1]:
                        seen.add(p.span())
                    yield from _decoded_base64(layer, *p.span(), most)
    if data.find(b"\n") < 0 and data.find(b"\\n") < 0:
        return
    for m in _BLOCK.finditer(data):
        if m.end() - m.start() < 20:
            continue
        yield from _decoded_base64(layer, *m.span(), most)
        if not _LINE_END.match(data, m.end()):  # a last line of other text
            yield from _decoded_base64(layer, m.start(), m.start("last"), most)


_URL_SAFE = bytes.maketrans(b"-_", b"+/")


def _inner(layer: Layer, most: int) -> Iterator[Layer]:
    """The layers found in a layer."""
    data = layer.data
    if data.find(b"%") >= 0 and (new := _decoded_in_place(layer, _PERCENT, _percent, most)):
        yield new
        if data.find(b"+") >= 0:  # forms write a space so
            yield from _compressed_layers(_decoded_in_place(layer, _PERCENT, _percent, most, True), most)
    if (data.find(b"\\") >= 0 or data.find(b"&#") >= 0) and (new := _decoded_in_place(layer, _ESCAPE, _escape, most)):
        yield new
        if data.find(b"\\x") >= 0:
            yield from _compressed_layers(_decoded_in_place(layer, _LITERAL, _escape, most), most)
    yield from _base64_layers(layer, most)
    if layer.parent is not None:
        yield from _compressed_layers(layer, most)


def find_secrets(text: str, hidden: bool, params: Params = Params()) -> tuple[list, list]:
    """(base spans, all spans), each sorted by start, then kind; ``hidden``: whether
    the text may hold encoded layers."""
    root = Layer(_as_bytes(text))
    base = list(_scan(root.data))
    every = set(base)
    if hidden:
        work = [_inner(root, params.max_layer)]
        seen = set()
        while work:
            new = next(work[-1], None)
            if new is None:
                work.pop()
                continue
            if not len(new.data):
                continue
            key = (hashlib.blake2b(new.data).digest(), *new.span(0, len(new.data)))
            if key in seen:
                continue
            seen.add(key)
            every.update((kind, *new.span(a, z)) for kind, a, z in _scan(new.data))
            work.append(_inner(new, params.max_layer))
    order = lambda s: (s[1], _RANK[s[0]], s[2])
    return sorted(base, key=order), sorted(every, key=order)


_IS_64 = np.zeros(256, dtype=bool)
_IS_64[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
_IS_64[list(b"\r\n")] = True  # lines are joined
_IS_HEX = np.zeros(256, dtype=bool)
_IS_HEX[list(b"0123456789abcdef")] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"%\\&")] = True


def _rows_with_runs(buf: np.ndarray, off: np.ndarray, member: np.ndarray, least: int) -> np.ndarray:
    """Which rows may hold a run of ``least`` members: such a run covers every fourth
    byte of its stretch, so only those are looked at.  Never misses one."""
    step = 4
    need = least // step
    flag = member[buf[::step]]
    if len(flag) < need:
        return np.diff(off) >= least
    run = flag[: len(flag) - need + 1].copy()
    for k in range(1, need):
        run &= flag[k : len(flag) - need + 1 + k]
    at = np.flatnonzero(run) * step
    rows = np.zeros(len(off) - 1, dtype=bool)
    rows[np.searchsorted(off, at, side="right") - 1] = True
    return rows


def _rows_with(buf: np.ndarray, off: np.ndarray, member: np.ndarray) -> np.ndarray:
    rows = np.zeros(len(off) - 1, dtype=bool)
    rows[np.searchsorted(off, np.flatnonzero(member[buf]), side="right") - 1] = True
    return rows


def _suspects(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(rows with anything to scan, rows that may hold encoded layers); both only ever
    err towards True."""
    import pyarrow.compute as pc

    col = part.column(part.schema.get_field_index("text"))
    buf, off = tv.column_bytes(col)
    hidden = _rows_with_runs(buf, off, _IS_64, 20) | _rows_with(buf, off, _MARK)
    plain = hidden | _rows_with_runs(buf, off, _IS_HEX, 16)
    low = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(np.ascontiguousarray(off)), pa.py_buffer(tv.lowered(buf))])
    for word in (*_KEYWORDS, "akia"):
        plain |= pc.match_substring(low, word).to_numpy(zero_copy_only=False)
    return plain, hidden


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


_NOTHING = hashlib.sha256(b"").hexdigest()


def report(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """Counts and spans of the secrets of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices_by_bytes(batch, "text", _SLICE):
                plain, hidden = _suspects(part)
                n = np.zeros((3, part.num_rows), dtype=np.int64)
                digest, spans = [_NOTHING] * part.num_rows, [""] * part.num_rows
                text = part.column(1)
                for i in np.flatnonzero(plain).tolist():
                    base, every = find_secrets(text[i].as_py() or "", bool(hidden[i]), params)
                    for kind, _, _ in base:
                        n[_RANK[kind], i] += 1
                    if base:
                        digest[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                    spans[i] = _joined(every)
                yield pa.record_batch(
                    [part.column(0), *(pa.array(x) for x in n), pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each stretch that spans cover replaced by a tag of the kinds in it."""
    parts, at = [], 0
    merged: list[list] = []
    for kind, a, z in sorted(spans, key=lambda s: s[1:]):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], z)
            merged[-1][0] |= {kind}
        else:
            merged.append([{kind}, a, z])
    for kinds, a, z in merged:
        parts += [text[at:a], "[" + "+".join(sorted(kinds)) + " removed]"]
        at = z
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """``docs`` in their own columns, secrets in ``text`` replaced by a tag; an
    ``n_chars`` column keeps to the new length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices_by_bytes(batch, "text", _SLICE):
                plain, hidden = _suspects(part)
                at = part.schema.get_field_index("text")
                texts = {}
                for i in np.flatnonzero(plain).tolist():
                    text = part.column(at)[i].as_py() or ""
                    if every := find_secrets(text, bool(hidden[i]), params)[1]:
                        texts[i] = redacted(text, every)
                if texts:
                    whole = part.column(at).to_pylist()
                    for i, t in texts.items():
                        whole[i] = t
                    part = part.set_column(at, part.schema.field(at), pa.array(whole, part.schema.field(at).type))
                    if (c := part.schema.get_field_index("n_chars")) >= 0:
                        sizes = part.column(c).to_pylist()
                        for i, t in texts.items():
                            sizes[i] = sizes[i] if sizes[i] is None else len(t)
                        part = part.set_column(c, part.schema.field(c), pa.array(sizes, part.schema.field(c).type))
                yield part

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
