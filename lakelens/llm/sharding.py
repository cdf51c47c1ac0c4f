"""Byte-balanced sharding by Karmarkar-Karp differencing.

Rows with equal texts form an indivisible group.  Differencing keeps partial
partitions, each a load for every shard, and again and again joins the two with
the largest spread, the heaviest shard of one onto the lightest of the other.

It runs in steps, so that no task or driver ever holds all groups:

1. *In buckets.*  Groups are hashed to buckets of about ``bucket_groups`` and each
   bucket is divided into bundles by differencing, one bucket after another in a
   task.  While there are more than ``most_buckets`` buckets, their bundles are the
   groups of a further level, so a bucket is bounded at any size of the table.
2. *Overall.*  The driver differences the bundles together with the groups that
   are large against a shard and a fixed number of small ones held out for the
   finish.  Their number is bounded by the parameters: ``shards * buckets``
   bundles, at most ``shards * large_share`` large groups and ``finish`` small
   ones.

A row's slot is its place within its shard, numbered in salted groups of rows.

Defined cases: a null text has no bytes and counts as an empty text; sizes are
bytes plus 1; rows that repeat get slots of their own; null doc_ids are numbered
first within their salt; an empty table gives an empty result.  A group larger
than an even shard stays whole: nothing can balance it.  Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.llm.common import Scratch, shuffle_tasks


@dataclass(frozen=True)
class Params:
    """shards: how many; bucket_groups: groups a bucket should hold; most_buckets: of the
    last level, whose bundles the driver places; large_share: a group of more than total / (shards *
    large_share) is placed by itself; finish: small groups held out; salts: numbering
    groups of a shard."""

    shards: int = 16
    bucket_groups: int = 4000
    most_buckets: int = 1024
    large_share: int = 64
    finish: int = 4096
    salts: int = 64


def differencing(sizes: list[int], shards: int) -> tuple[list[int], list[int]]:
    """(shard of each item, load of each shard) by largest differencing."""
    if not sizes:
        return [], [0] * shards
    # a node: loads in ascending order, with the node parts each slot is made of
    heap: list[tuple] = []
    made: list[tuple] = []  # (left node, right node, slot of left, slot of right) by new slot
    for i, size in enumerate(sizes):
        heap.append((-size, i, [0] * (shards - 1) + [size]))
    heapq.heapify(heap)
    n = len(sizes)
    flip = shards - 1
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heap[0]
        joined = [p + q for p, q in zip(x, reversed(y))]
        order = sorted(range(shards), key=joined.__getitem__)
        loads = [joined[k] for k in order]
        made.append((a, b, order))
        heapq.heapreplace(heap, (loads[0] - loads[-1], n + len(made) - 1, loads))
    _, top, loads = heap[0]
    slots: dict[int, list[int]] = {top: list(range(shards))}
    out = [0] * n
    for k in range(len(made) - 1, -1, -1):
        where = slots.pop(n + k)
        a, b, order = made[k]
        left, right = [0] * shards, [0] * shards
        for new, old in enumerate(order):
            left[old] = where[new]
            right[flip - old] = where[new]
        slots[a], slots[b] = left, right
    for i in range(n):
        out[i] = slots[i][flip]
    return out, loads


def _bundles(shards: int):
    """Rows come by bucket; each bucket's items are divided into ``shards`` bundles."""

    def divided(bucket: int, rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (-r[1], r[0]))
        bundle, _ = differencing([r[1] for r in rows], shards)
        items, loads = zip(*rows)
        return pa.record_batch(
            [pa.array(items, pa.int64()), pa.array([bucket * shards + b for b in bundle], pa.int64()), pa.array(loads, pa.int64())],
            names=["part", "item", "load"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for b in batches:
            for k, *row in zip(*(b.column(c).to_pylist() for c in ("bucket", "item", "load"))):
                if k != bucket and rows:
                    yield divided(bucket, rows)
                    rows = []
                bucket = k
                rows.append(row)
        if rows:
            yield divided(bucket, rows)

    return run


def _level(items: DataFrame, n: int, tasks: int, p: Params) -> tuple[DataFrame, int]:
    """(part, item, load) of one level: each of ``n`` items (item, load) and the bundle it
    is part of; and the number of buckets."""
    # a level has at most a quarter of the items of the one before
    buckets = max(1, -(-n // max(p.bucket_groups, 4 * p.shards)))
    placed = items.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)))
    tasks = max(1, min(buckets, tasks))
    placed = placed.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(_bundles(p.shards), "part long, item long, load long"), buckets


_GROUP = ["hash", "text_crc32", "size"]


def shard(spark: SparkSession, docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row."""
    p = params
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
    )
    rows = scratch.keep(rows, "rows")
    groups = scratch.keep(rows.groupBy(*_GROUP).agg(F.sum("size").alias("load")), "groups")
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("load"), F.lit(0))).first()
    large = F.col("load") * (p.shards * p.large_share) > total
    # the held-out small groups are those that hash lowest
    finish = groups.where(~large).orderBy(F.xxhash64("hash"), *_GROUP).limit(p.finish)
    single = scratch.keep(groups.where(large).union(finish).withColumn("item", F.lit(None).cast("long")), "single")
    alone = single.orderBy(*_GROUP).collect()
    # unlike groups may share an item: they go together
    rest = groups.join(single.select(*_GROUP), _GROUP, "left_anti").withColumn("item", F.xxhash64(*_GROUP))
    rest = scratch.keep(rest, "rest")
    level, buckets = _level(rest.groupBy("item").agg(F.sum("load").alias("load")), n, 4 * shuffle_tasks(spark), p)
    level = scratch.keep(level, "level-0")
    rest = rest.drop("load").join(level.select(F.col("part").alias("item"), F.col("item").alias("bundle")), "item")
    rest = rest.drop("item").withColumnRenamed("bundle", "item")
    k = 0
    while buckets > p.most_buckets:
        k += 1
        below = level.groupBy("item").agg(F.sum("load").alias("load"))
        level, buckets = _level(below, buckets * p.shards, 4 * shuffle_tasks(spark), p)
        level = scratch.keep(level, f"level-{k}")
        rest = rest.join(level.select(F.col("part").alias("item"), F.col("item").alias("bundle")), "item")
        rest = rest.drop("item").withColumnRenamed("bundle", "item")
    rest = scratch.keep(rest, "bundles")
    bundles = sorted(level.groupBy("item").agg(F.sum("load").alias("load")).collect())
    placed, _ = differencing([r.load for r in alone] + [r.load for r in bundles], p.shards)
    first = max((r.item for r in bundles), default=-1) + 1
    # bounded: a row for each bundle and each group placed by itself
    names = [(first + i, s) for i, s in enumerate(placed[: len(alone)])]
    names += [(r.item, s) for r, s in zip(bundles, placed[len(alone) :])]
    where = spark.createDataFrame(names, "item long, shard int")
    own = spark.createDataFrame(
        [(r.hash, r.text_crc32, r.size, first + i) for i, r in enumerate(alone)], "hash long, text_crc32 long, size long, item long"
    )
    assigned = scratch.keep(rest.select(*_GROUP, "item").union(own).join(F.broadcast(where), "item").drop("item"), "assigned")
    sharded = rows.join(assigned, _GROUP).select(
        "doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(p.salts)).cast("int").alias("salt")
    )
    sharded = scratch.keep(sharded, "sharded")
    # shards * salts rows
    counts = sharded.groupBy("shard", "salt").count()
    before = counts.withColumn(
        "before", F.sum("count").over(Window.partitionBy("shard").orderBy("salt")) - F.col("count")
    ).select("shard", "salt", "before")
    order = Window.partitionBy("shard", "salt").orderBy("doc_id", "text_crc32", "size")
    return (
        sharded.withColumn("rank", F.row_number().over(order))
        .join(F.broadcast(before), ["shard", "salt"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).alias("slot"))
    )
