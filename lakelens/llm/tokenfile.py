"""Token ids in binary shards with a minimal perfect hash index.

A shard holds the ids of a range of documents, in ascending doc_id order, and an
index from document key to position.  The file is written front to back:

    ids       of all documents, 2 bytes each where the vocabulary allows, else 4
    ends      for each document, ids up to its end (8 bytes); a leading 0
    keys      doc_id of each document (8 bytes)
    slots     for each distinct key in hash order: fingerprint (4 bytes),
              documents with that key (4), first of them (8)
    words     the hash's bit vectors, all levels (8 bytes a word)
    footer    JSON with the counts and sizes of the above, then its length (4) and
              the mark ``TOKSHRD1``

All integers are little-endian.  The hash is built level by level: at each, keys
set the bit they hash to; keys that met no other are done, the rest go on to the
next, smaller level.  A key's slot is the rank of its bit.  A lookup costs a few
bit probes whatever the shard's size, and a fingerprint rejects foreign keys.

Shards are written by their tasks straight to the shared folder, under a name of
the attempt's own; ``manifest.json`` beside them, written last, lists the finished
ones in order with their keys' range and the ids before each, so a folder can be
read by any process (``Manifest.load``).  ``Shard.get`` reads a document with the
hash's bits, of which there are a few a key, and a fixed number of small reads.

Defined cases: a null text is an empty one (an end id alone); null doc_ids come
first, are read in order and have no key; documents that repeat a doc_id follow
each other and share its key's slot; an empty table gives an empty manifest and
result.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm import textvec as tv
from lakelens.llm import tokens
from lakelens.llm.common import shared_folder, shuffle_tasks

U64 = tv.U64
_SLICE = 2 << 20
_MARK = b"TOKSHRD1"
_SLOT = np.dtype([("print", "<u4"), ("run", "<u4"), ("first", "<u8")])


@dataclass(frozen=True)
class Params:
    """end: id after each document; gamma: bits a key at each level of the hash; levels:
    at most; path: the tokenizer file; shards: how many, default the session's shuffle
    partitions or a shard for each ``shard_bytes`` of text if those are more; read_ids:
    ids read at once."""

    end: int = 0
    gamma: float = 1.7
    levels: int = 64
    path: str = field(default_factory=tokens.default_path)
    shards: int | None = None
    shard_bytes: int = 256 << 20
    read_ids: int = 4 << 20


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (tv.mix64(keys.view(U64) ^ U64(0xA5A5A5A5A5A5A5A5)) >> U64(32)).astype("<u4")


def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (tv.mix64(keys.view(U64) + U64(level + 1) * U64(0x9E3779B97F4A7C15)) % U64(bits)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys by cascading bit vectors."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(counts)))

    @staticmethod
    def build(keys: np.ndarray, gamma: float, levels: int) -> PerfectHash:
        sizes, parts, rest = [], [], keys
        while len(rest):
            if len(sizes) == levels:
                raise ValueError("keys are not distinct")
            bits = max(64, -(-int(len(rest) * gamma) // 64) * 64)
            at = _place(rest, len(sizes), bits)
            alone = np.bincount(at, minlength=bits) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(bits)
            rest = rest[~alone[at]]
        return PerfectHash(sizes, np.concatenate(parts) if parts else np.zeros(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level has it."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        base = 0
        for level, bits in enumerate(self.sizes):
            if not len(left):
                break
            at = _place(keys[left], level, bits) + base
            word, bit = self.words[at >> 6], (at & 63).astype(U64)
            hit = (word >> bit) & U64(1) == 1
            low = word & ((U64(1) << bit) - U64(1))
            out[left[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(low[hit])
            left = left[~hit]
            base += bits
        return out


class ShardWriter:
    """Writes one shard front to back."""

    def __init__(self, stream, wide: bool):
        self.stream, self.kind = stream, np.dtype("<u4" if wide else "<u2")
        self.ends, self.keys, self.keyed = [np.zeros(1, "<u8")], [], []
        self.n_ids = 0
        self.low = self.high = None  # keys

    def add(self, keys: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.stream.write(ids.astype(self.kind).tobytes())
        self.ends.append((offsets[1:] + self.n_ids).astype("<u8"))
        self.keys.append(keys.fill_null(0).to_numpy().astype("<i8"))
        self.keyed.append(keys.is_valid().to_numpy(zero_copy_only=False))
        self.n_ids += int(offsets[-1])

    def close(self, p: Params) -> int:
        keys = np.concatenate(self.keys) if self.keys else np.zeros(0, "<i8")
        keyed = np.concatenate(self.keyed) if self.keyed else np.zeros(0, bool)
        nulls = int((~keyed).sum())  # they come first
        distinct, first, run = np.unique(keys[nulls:], return_index=True, return_counts=True)
        if len(distinct):
            self.low, self.high = int(distinct[0]), int(distinct[-1])
        index = PerfectHash.build(distinct, p.gamma, p.levels)
        slots = np.zeros(len(distinct), dtype=_SLOT)
        at = index.slots(distinct)
        slots["print"][at], slots["run"][at], slots["first"][at] = _fingerprint(distinct), run, first + nulls
        for part in (*self.ends, keys, slots, index.words):
            self.stream.write(np.ascontiguousarray(part).tobytes())
        footer = json.dumps(
            {"width": self.kind.itemsize, "docs": len(keys), "null_keys": nulls, "ids": self.n_ids, "keys": len(distinct), "levels": index.sizes, "words": len(index.words)}
        ).encode()
        self.stream.write(footer + len(footer).to_bytes(4, "little") + _MARK)
        return len(keys)


class Shard:
    """Keyed and ordered access to a shard file."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        tail = self._at(size - 12, 12)
        if tail[4:] != _MARK:
            raise ValueError("not a token shard")
        length = int.from_bytes(tail[:4], "little")
        self.about = about = json.loads(self._at(size - 12 - length, length))
        self.kind = np.dtype(f"<u{about['width']}")
        self.ends_at = about["ids"] * about["width"]
        self.keys_at = self.ends_at + 8 * (about["docs"] + 1)
        self.slots_at = self.keys_at + 8 * about["docs"]
        at = self.slots_at + _SLOT.itemsize * about["keys"]
        self.index = PerfectHash(about["levels"], self._array(at, about["words"], "<u8"))

    @cached_property
    def ends(self) -> np.ndarray:
        return self._array(self.ends_at, self.about["docs"] + 1, "<u8").astype(np.int64)

    @cached_property
    def keys(self) -> np.ndarray:
        return self._array(self.keys_at, self.about["docs"], "<i8")

    @cached_property
    def slots(self) -> np.ndarray:
        return self._array(self.slots_at, self.about["keys"], _SLOT)

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of each document with this key, without reading the tables whole."""
        one = np.array([key], dtype=np.int64)
        at = int(self.index.slots(one)[0])
        if at < 0:
            return []
        slot = self._array(self.slots_at + _SLOT.itemsize * at, 1, _SLOT)[0]
        if slot["print"] != _fingerprint(one)[0]:
            return []
        first, run = int(slot["first"]), int(slot["run"])
        if int(self._array(self.keys_at + 8 * first, 1, "<i8")[0]) != key:
            return []
        ends = self._array(self.ends_at + 8 * first, run + 1, "<u8").astype(np.int64).tolist()
        return [self._array(a * self.kind.itemsize, z - a, self.kind) for a, z in zip(ends, ends[1:])]

    def _at(self, offset: int, length: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(length)

    def _array(self, offset: int, count: int, kind) -> np.ndarray:
        kind = np.dtype(kind)
        return np.frombuffer(self._at(offset, count * kind.itemsize), dtype=kind)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first document, number of documents) of each key; (-1, 0) if absent."""
        keys = np.ascontiguousarray(keys, dtype=np.int64)
        slot = self.index.slots(keys)
        ok = slot >= 0
        ok[ok] = self.slots["print"][slot[ok]] == _fingerprint(keys[ok])
        first, run = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        first[ok], run[ok] = self.slots["first"][slot[ok]], self.slots["run"][slot[ok]]
        return first, run

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids of documents first to last (exclusive), joined."""
        a, z = int(self.ends[first]), int(self.ends[last])
        return self._array(a * self.kind.itemsize, z - a, self.kind)


@dataclass(frozen=True)
class Manifest:
    """Where the shards lie, in document order, the ids before each, and the least and
    greatest key in each (None where it has none)."""

    folder: str
    names: list[str]
    starts: list[int]
    ranges: list[tuple[int | None, int | None]]

    def save(self) -> None:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/manifest.json.new") as out:
            out.write(json.dumps({"names": self.names, "starts": self.starts, "ranges": self.ranges}).encode())
        fs.move(f"{root}/manifest.json.new", f"{root}/manifest.json")

    @staticmethod
    def load(folder: str) -> Manifest:
        fs, root = pafs.FileSystem.from_uri(folder)
        with fs.open_input_file(f"{root}/manifest.json") as f:
            got = json.loads(f.read())
        return Manifest(folder, got["names"], got["starts"], [tuple(x) for x in got["ranges"]])

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of every document with this key."""
        fs, root = pafs.FileSystem.from_uri(self.folder)
        out = []
        for name, (low, high) in zip(self.names, self.ranges):
            if low is not None and low <= key <= high:
                with fs.open_input_file(f"{root}/{name}") as stream:
                    out += Shard(stream).get(key)
        return out


def write(spark: SparkSession, docs: DataFrame, params: Params | None = None, folder: str | None = None) -> Manifest:
    """Encode ``docs`` into shards below ``folder`` (default: in the shared folder)."""
    p = params or Params()
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wide = tokens.vocabulary_size(p.path) > 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.tok"
        with fs.open_output_stream(f"{root}/{name}") as stream:
            writer = ShardWriter(stream, wide)
            for batch in batches:
                for part in tv.slices_by_bytes(batch, "text", _SLICE):
                    writer.add(part.column("doc_id"), *tokens.encode(part.column("text"), p.path, p.end))
            n = writer.close(p)
        if n:
            yield pa.record_batch(
                [pa.array([task.partitionId()], pa.int32()), pa.array([name]), *(pa.array([x], pa.int64()) for x in (writer.n_ids, writer.low, writer.high))],
                names=["shard", "name", "n_ids", "low", "high"],
            )
        else:
            fs.delete_file(f"{root}/{name}")

    shards = p.shards
    if not shards:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        shards = max(shuffle_tasks(spark), -(-size // p.shard_bytes))
    ordered = docs.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    # a row per shard
    done = sorted(ordered.mapInArrow(run, "shard int, name string, n_ids long, low long, high long").collect(), key=lambda r: r.shard)
    starts = np.cumsum([0, *(r.n_ids for r in done)])[:-1].tolist()
    manifest = Manifest(folder, [r.name for r in done], starts, [(r.low, r.high) for r in done])
    manifest.save()
    return manifest


_DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_digests(spark: SparkSession, manifest: Manifest, params: Params | None = None) -> DataFrame:
    """Start, length and checksum of every document, read back from the shards: keyed
    documents through the index, the few without a key in order."""
    p = params or Params()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(manifest.folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{manifest.names[k]}") as stream:
                    yield from _digest(Shard(stream), manifest.starts[k], p)

    n = max(1, len(manifest.names))
    return spark.range(0, len(manifest.names), 1, n).mapInArrow(run, _DIGEST)


def _digest(shard: Shard, base: int, p: Params) -> Iterator[pa.RecordBatch]:
    docs, nulls = shard.about["docs"], shard.about["null_keys"]
    distinct = np.unique(shard.keys[nulls:])
    first, run = shard.find(distinct)
    if (first < 0).any():
        raise ValueError("the index lacks a key of its shard")
    # documents in the order the index gives them
    order = np.concatenate([np.arange(nulls), np.repeat(first - np.cumsum(run) + run, run) + np.arange(int(run.sum()))]).astype(np.int64)
    at = 0
    while at < docs:
        stop = int(np.searchsorted(shard.ends, shard.ends[at] + p.read_ids, side="right")) - 1
        stop = min(max(stop, at + 1), docs)
        raw = memoryview(shard.ids(at, stop).astype("<u4").tobytes())
        some = order[at:stop]
        a, z = shard.ends[some], shard.ends[some + 1]
        lo = (a - shard.ends[at]) * 4
        hi = (z - shard.ends[at]) * 4
        crc = [zlib.crc32(raw[i:j]) for i, j in zip(lo.tolist(), hi.tolist())]
        keys = pa.array(shard.keys[some], pa.int64(), mask=some < nulls)
        yield pa.record_batch(
            [keys, pa.array(a + base), pa.array(z - a), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
        )
        at = stop
