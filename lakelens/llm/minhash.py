"""MinHash near-duplicate detection with tensored banding.

Rather than 100 independent tables of four minhashes, two collections of
``collection`` small bundles are computed (``width`` minhashes each); table
(i, j) is keyed by bundle i of the first and bundle j of the second.  So
``collection**2`` tables cost ``2 * collection * width`` minhashes, about the
square root.  At a similarity s a link is missed with probability about
2 * (1 - s**width)**collection: 5e-6 at 0.85 for the defaults, and less above.

Candidates are confirmed on full shingle sets.  No bucket is ever expanded into
all its pairs:

1. documents with equal shingle sets are one *node*;
2. bundles that no other node shares drop out before tables are formed;
3. in each table bucket every member is compared with the smallest one; the
   confirmed links give first components;
4. buckets that still hold several components are compared member by member in
   blocks of bounded size, across components only, with an exact upper bound (a
   parity sketch of the sets) in front of the full check;
5. components are recomputed over all confirmed links.

Step 4 leaves no candidate pair unchecked, so components are those of all
candidate links.

Defined cases: null or blank texts have no shingles and link with nothing; rows
that repeat a doc_id are one document as far as their texts are equal; a null
doc_id links with nothing and keeps a null component; an empty table gives an
empty result.  Only ``doc_id`` and ``text`` are read, so other columns never
clash.  Nodes are 64-bit set hashes: two different sets share one with a
probability of n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm import textvec as tv
from lakelens.llm.common import Scratch, fresh

U64 = tv.U64
_SLICE = 2 << 20
_SKETCH_BITS = 1024


@dataclass(frozen=True)
class Params:
    """shingle: words a shingle; percent: least 100 * intersection / union;
    collection, width: bundles a collection and minhashes a bundle; block:
    members compared at once in mixed buckets; seed: of the hash functions."""

    shingle: int = 5
    percent: int = 85
    collection: int = 10
    width: int = 2
    block: int = 1024
    seed: int = 20240229


def _functions(p: Params) -> tuple[np.ndarray, np.ndarray]:
    n = 2 * p.collection * p.width
    seeds = tv.mix64(np.arange(1, 2 * n + 1, dtype=U64) + U64(p.seed))
    return seeds[:n], seeds[n:] | U64(1)


def shingle_sets(batch: pa.RecordBatch, text: str, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each row's text."""
    buf, off = tv.column_bytes(batch.column(batch.schema.get_field_index(text)))
    words = tv.words_of(tv.lowered(buf), off)
    h = tv.word_hashes(words)
    odd = [U64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(width)]
    none = np.zeros(0, U64)
    with np.errstate(over="ignore"):
        rolled = none
        if len(h) >= width:
            rolled = tv.mix64(sum(h[k : len(h) - width + 1 + k] * odd[k] for k in range(width)))
        out = []
        for a, z in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if z - a >= width:
                out.append(np.unique(rolled[a : z - width + 1]))
            elif z > a:
                whole = sum(int(x) * int(c) for x, c in zip(h[a:z], odd)) + (z - a)
                out.append(tv.mix64(np.array([whole & (2**64 - 1)], dtype=U64)))
            else:
                out.append(none)
    return out


def _node(s: np.ndarray) -> int:
    """One 64-bit value for a set, whatever the order of its elements."""
    with np.errstate(over="ignore"):
        both = np.array([tv.mix64(s).sum(dtype=U64) ^ U64(len(s))], dtype=U64)
    return int(tv.mix64(both).view(np.int64)[0])


def _sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the number of elements in each of the sketch's cells."""
    cells = np.bincount((s >> U64(64 - _SKETCH_BITS.bit_length() + 1)).astype(np.int64), minlength=_SKETCH_BITS)
    return np.packbits((cells & 1).astype(np.uint8))


def _signatures(p: Params):
    xor, mul = _functions(p)
    per = p.collection

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices_by_bytes(batch, "text", _SLICE):
                sets = shingle_sets(part, "text", p.shingle)
                size = np.array([len(s) for s in sets], dtype=np.int64)
                full = [s for s in sets if len(s)]
                keys = np.zeros((len(full), 2 * per), dtype=U64)
                if full:
                    flat = np.concatenate(full)
                    at = np.concatenate(([0], np.cumsum([len(s) for s in full])[:-1]))
                    with np.errstate(over="ignore"):
                        for bundle in range(2 * per):
                            key = np.full(len(full), bundle + 1, dtype=U64)
                            for w in range(bundle * p.width, (bundle + 1) * p.width):
                                low = np.minimum.reduceat((flat ^ xor[w]) * mul[w], at)
                                key = tv.mix64(key * U64(0x9E3779B97F4A7C15) + low)
                            keys[:, bundle] = key
                rows = iter(keys.view(np.int64))
                lists = [next(rows) if n else None for n in size]
                yield pa.record_batch(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array([k if k is None else k[:per] for k in lists], pa.list_(pa.int64())),
                        pa.array([k if k is None else k[per:] for k in lists], pa.list_(pa.int64())),
                        pa.array([_sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "row_hash", "node", "n_shingles", "left_keys", "right_keys", "sketch"],
                )

    return run


_SIGNATURE = "doc_id long, row_hash long, node long, n_shingles long, left_keys array<long>, right_keys array<long>, sketch binary"


def _close(n_a: np.ndarray, n_b: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (n_a + n_b - common)


def _may_link(n_a: np.ndarray, n_b: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """False only where the sets can't reach the similarity: ``differ`` cells of the
    parity sketches differ, so at least as many elements lie in one set only."""
    return _close(n_a, n_b, (n_a + n_b - np.minimum(differ, n_a + n_b)) // 2, percent) & (
        100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    )


def _bits(col: pa.Array) -> np.ndarray:
    buf, _ = tv.column_bytes(col)
    return buf.view(U64).reshape(-1, _SKETCH_BITS // 64)


def _prune(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            differ = np.bitwise_count(_bits(b.column("sk_a")) ^ _bits(b.column("sk_b"))).sum(axis=1, dtype=np.int64)
            ok = _may_link(b.column("n_a").to_numpy(), b.column("n_b").to_numpy(), differ, percent)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def _cross_blocks(percent: int):
    """Pairs across components within each (x, y, lo, hi) block, past the sketch bound.
    Rows come sorted by that key; a block's rows are bounded by twice the block size."""

    def block(rows: dict[str, np.ndarray]) -> np.ndarray:
        side, comp, node, n, bits = (rows[k] for k in ("side", "comp", "node", "n", "bits"))
        lefts, rights, x, y = rows["lefts"], rows["rights"], rows["x"][0], rows["y"][0]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(right):
            left, right = np.arange(len(side)), np.arange(len(side))
        found = []
        for i in left:
            js = right[(comp[right] != comp[i]) & (node[right] != node[i])]
            # of the tables a pair shares, the first is where it is compared
            for keys, own in ((lefts, x), (rights, y)):
                if len(js):
                    same = keys[js] == keys[i]
                    js = js[keys[i][same.argmax(axis=1)] == own]
            if not len(js):
                continue
            differ = np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1, dtype=np.int64)
            js = js[_may_link(n[js], n[i], differ, percent)]
            if len(js):
                a = np.minimum(node[js], node[i])
                found.append(np.stack([a, np.maximum(node[js], node[i])], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None

        def done(rows: dict[str, np.ndarray], last: bool):
            key = np.stack([rows["x"], rows["y"], rows["lo"], rows["hi"]], axis=1)
            cut = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            edges = [0, *cut.tolist(), len(key)]
            stop = len(edges) - 1 if last else len(edges) - 2
            found = [block({k: v[a:z] for k, v in rows.items()}) for a, z in zip(edges[:stop], edges[1 : stop + 1])]
            rest = {k: v[edges[stop] :] for k, v in rows.items()}
            return (np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)), rest

        def give(pairs: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            now = {k: b.column(k).to_numpy() for k in ("x", "y", "lo", "hi", "side", "comp", "node", "n")}
            now["bits"] = _bits(b.column("sketch"))
            for k in ("lefts", "rights"):
                now[k] = b.column(k).flatten().to_numpy().reshape(b.num_rows, -1)
            held = now if held is None else {k: np.concatenate([held[k], now[k]]) for k in now}
            pairs, held = done(held, False)
            yield give(pairs)
        if held is not None:
            yield give(done(held, True)[0])

    return run


def _exact_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices_by_bytes(batch, "text", _SLICE):
                sets = shingle_sets(part, "text", width)
                wanted = part.column("node").to_pylist()
                keep = [i for i, s in enumerate(sets) if len(s) and _node(s) == wanted[i]]
                yield pa.record_batch(
                    [pa.array([wanted[i] for i in keep], pa.int64()), pa.array([sets[i].tobytes() for i in keep], pa.binary())],
                    names=["node", "members"],
                )

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("set_a"), b.column("set_b")):
                s, t = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                common = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(bool(100 * common >= percent * (len(s) + len(t) - common)))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, p: Params, scratch: Scratch, tag: str) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough."""
    slim = nodes.select("node", "n_shingles", "sketch")
    near = (
        pairs.join(slim.toDF("a", "n_a", "sk_a"), "a")
        .join(slim.toDF("b", "n_b", "sk_b"), "b")
        .mapInArrow(_prune(p.percent), "a long, b long")
    )
    near = scratch.keep(near, f"near-{tag}")
    need = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    # a node's text is that of its smallest document
    whose = need.join(nodes.select("node", F.col("rep").alias("doc_id")), "node")
    sets = docs.join(whose, "doc_id").select("node", "text").mapInArrow(_exact_sets(p.shingle), "node long, members binary")
    # rows that repeat a document give its set more than once
    sets = scratch.keep(sets.groupBy("node").agg(F.first("members").alias("members")), f"sets-{tag}")
    both = (
        near.join(sets.toDF("a", "set_a"), "a")
        .join(sets.toDF("b", "set_b"), "b")
        .mapInArrow(_confirm(p.percent), "a long, b long")
    )
    links = scratch.keep(both, f"links-{tag}")
    scratch.drop(f"near-{tag}", f"sets-{tag}")
    return links


def components(links: DataFrame, scratch: Scratch, tag: str, most_rounds: int = 60) -> DataFrame:
    """(node, comp): the smallest node reachable, for every node with a link.

    Minimum labels spread along the links and then jump to their own label, so
    rounds grow with the logarithm of a component's width.  Each round's labels
    are a written table; joins on hub nodes meet written tables on both sides,
    which lets adaptive execution split them.
    """
    both = scratch.keep(links.union(links.select("b", "a")).toDF("u", "v").distinct(), f"cc-{tag}-edges")
    labels = scratch.keep(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("comp")), f"cc-{tag}-0")
    for k in range(1, most_rounds):
        heard = both.join(labels.toDF("v", "comp"), "v").select(F.col("u").alias("node"), "comp")
        low = heard.union(labels).groupBy("node").agg(F.min("comp").alias("comp"))
        low = scratch.keep(low, f"cc-{tag}-{k}-low")
        jumped = low.select("node", F.col("comp").alias("via")).join(
            low.select(F.col("node").alias("via"), F.col("comp").alias("next")), "via", "left"
        )
        new = scratch.keep(jumped.select("node", F.coalesce("next", "via").alias("comp")), f"cc-{tag}-{k}")
        moved = new.join(labels.toDF("node", "old"), "node").where(F.col("old") != F.col("comp")).limit(1).count()
        scratch.drop(f"cc-{tag}-{k}-low", f"cc-{tag}-{k - 1}")
        labels = new
        if not moved:
            scratch.drop(f"cc-{tag}-edges")
            return labels
    raise RuntimeError("components did not settle")


def _keys(left, right):
    """All (left bundle, right bundle) table keys of a node."""
    return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def _row_hash() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def near_duplicates(spark: SparkSession, docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, row_hash, node, n_shingles, component_id, kept) for every row of ``docs``;
    ``row_hash`` is ``_row_hash`` of the row."""
    p = params
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = scratch.keep(docs.withColumn("row_hash", _row_hash()).mapInArrow(_signatures(p), _SIGNATURE), "signatures")
    linked = sig.where("doc_id is not null and node is not null")
    nodes = scratch.keep(
        linked.groupBy("node").agg(
            F.min("doc_id").alias("rep"),
            *(F.first(c).alias(c) for c in ("n_shingles", "left_keys", "right_keys", "sketch")),
        ),
        "nodes",
    )
    # bundles at least two nodes share
    bundles = nodes.select("node", F.explode(F.concat("left_keys", "right_keys")).alias("bundle"))
    shared = scratch.keep(bundles.groupBy("bundle").count().where("count > 1").select("bundle"), "shared")
    own = scratch.keep(
        bundles.join(shared, "bundle").groupBy("node").agg(F.collect_set("bundle").alias("shared")), "own"
    )
    tables = (
        nodes.select("node", "left_keys", "right_keys")
        .join(own, "node")
        .select(
            "node",
            F.explode(
                _keys(F.array_intersect("left_keys", "shared"), F.array_intersect("right_keys", "shared"))
            ).alias("key"),
        )
        .select("node", "key.x", "key.y")
    )
    tables = scratch.keep(tables, "tables")
    buckets = scratch.keep(
        tables.groupBy("x", "y").agg(F.min("node").alias("head"), F.count("*").alias("members")).where("members > 1"),
        "buckets",
    )
    # two small aggregates on both sides of the join would hide its skew: they are written above
    stars = (
        tables.join(buckets.select("x", "y", "head"), ["x", "y"])
        .where("node <> head")
        .select(F.col("head").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    links = _verified(docs, nodes, stars, p, scratch, "star")
    scratch.release()
    first = components(links, scratch, "star")
    # buckets that still hold several components
    labelled = scratch.keep(
        tables.join(buckets.select("x", "y"), ["x", "y"])
        .join(first, "node", "left")
        .select("x", "y", "node", F.coalesce("comp", "node").alias("comp")),
        "labelled",
    )
    mixed = scratch.keep(
        labelled.groupBy("x", "y")
        .agg(F.count("*").alias("members"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        .where("low < high")
        .select("x", "y", F.ceil(F.col("members") / p.block).cast("int").alias("blocks")),
        "mixed",
    )
    spread = (
        labelled.join(mixed, ["x", "y"])
        .withColumn("blk", F.pmod(F.xxhash64("node", F.lit(p.seed)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select(
            "x",
            "y",
            F.least("blk", "other").alias("lo"),
            F.greatest("blk", "other").alias("hi"),
            (F.col("blk") > F.col("other")).cast("int").alias("side"),
            "node",
            "comp",
        )
        .join(
            nodes.select(
                "node",
                F.col("n_shingles").alias("n"),
                "sketch",
                F.col("left_keys").alias("lefts"),
                F.col("right_keys").alias("rights"),
            ),
            "node",
        )
        .select("x", "y", "lo", "hi", "side", "node", "comp", "n", "sketch", "lefts", "rights")
    )
    crossing = (
        spread.repartition("x", "y", "lo", "hi")
        .sortWithinPartitions("x", "y", "lo", "hi")
        .mapInArrow(_cross_blocks(p.percent), "a long, b long")
        .distinct()
    )
    more = _verified(docs, nodes, scratch.keep(crossing, "crossing"), p, scratch, "cross")
    scratch.release()
    final = components(links.union(more), scratch, "all")
    named = nodes.select("node", "rep").join(final, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    named = scratch.keep(named, "named")
    smallest = scratch.keep(named.groupBy("comp").agg(F.min("rep").alias("component_id")), "smallest")
    resolved = scratch.keep(named.join(smallest, "comp").select("node", "component_id"), "resolved")
    out = (
        sig.select("doc_id", "row_hash", "node", "n_shingles")
        .join(resolved, "node", "left")
        .select(
            "doc_id",
            "row_hash",
            "node",
            "n_shingles",
            F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
    scratch.drop("tables", "labelled", "mixed", "buckets", "own", "shared", "crossing")
    return out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, params: Params = Params()) -> DataFrame:
    """``docs`` with one document of each group left, in its own columns, whatever their
    names.

    Rows that repeat a kept document with the same text are one, unlike texts under one
    doc_id are judged each by itself; rows with a null doc_id and rows without words stay.
    """
    (own,) = fresh(docs, "_row_hash")
    keep = near_duplicates(spark, docs, params).where("kept and doc_id is not null")
    keep = Scratch(spark, "minhash-keep").keep(keep.select(F.col("row_hash").alias(own)).distinct(), "keep")
    stay = docs.withColumn(own, _row_hash()).join(keep, own, "left_semi").drop(own)
    lost = docs.where(F.col("doc_id").isNull())
    return stay.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"]).union(lost)
