"""Exact top-k search by distributed histogram selection.

Every query is scored against every vector, in blocks, but scores are never
collected.  Each pass counts them in ``bins`` equal intervals of a score range
per query, summed over all partitions, and narrows the range to the interval
that holds the kth highest score, until it is a single score.  A last pass keeps
the scores above it and, of those equal to it, as many as are still needed, with
the smallest ids; ties are so broken the same way at every partitioning.

Queries are taken ``query_block`` at a time; each block is sent to the tasks and
its ranges and counts are what the driver holds.  All scores are integers.

Defined cases: vectors that are null, or hold a null or non-finite component,
take no part, nor do rows with a null id; vectors of another length than the
query's are not its candidates; rows that share the query's id are its own and
not candidates; an id that occurs more than once as a query is one query, that
of its first vector in component order; with fewer candidates than k all are
returned; an empty table gives an empty result.  Only ``vec_id`` and
``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.llm.common import Scratch


@dataclass(frozen=True)
class Params:
    """k: results a query; every: queries are ids divisible by it; scale: of components
    before the floor; bins: of a histogram; query_block: queries at a time."""

    k: int = 5
    every: int = 50
    scale: int = 256
    bins: int = 256
    query_block: int = 2048


_ROWS = 4096  # vectors scored at once
_FAN = 64  # rows of counts that a task sums


def _matrix(col: pa.Array, scale: int) -> np.ndarray:
    """Integer components of equally long vectors, as float64 where products stay exact."""
    flat = np.floor(col.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    return flat.reshape(len(col), -1)


def _scores(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    most = (np.abs(queries).max(initial=0)) * (np.abs(block).max(initial=0)) * queries.shape[1]
    if most < 2**53:
        return (queries @ block.T).astype(np.int64)
    return queries.astype(np.int64) @ block.T.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], p: Params, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            size = part.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            part = part.filter(pa.array(size == width))
            if part.num_rows:
                yield part.column("vec_id").to_numpy(), _matrix(part.column("embedding"), p.scale)


def _histograms(ids: np.ndarray, queries: np.ndarray, low: np.ndarray, step: np.ndarray, p: Params):
    """Counts of scores per query in ``bins`` intervals from ``low``; two more for the
    scores below and above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(ids), p.bins + 2), dtype=np.int64)
        shift = (np.arange(len(ids)) * (p.bins + 2))[:, None]
        for vec, block in _blocks(batches, p, queries.shape[1]):
            at = np.clip((_scores(queries, block) - low[:, None]) // step[:, None] + 1, 0, p.bins + 1)
            flat = np.bincount((at + shift).ravel(), minlength=counts.size)
            own_q, own_v = np.nonzero(ids[:, None] == vec)
            flat -= np.bincount((at + shift)[own_q, own_v], minlength=counts.size)
            counts += flat.reshape(counts.shape)
        if counts.any():
            # a row for each slice of queries, so that sums are spread
            for a in range(0, len(ids), 64):
                yield pa.record_batch(
                    [pa.array([a], pa.int32()), pa.array([counts[a : a + 64].tobytes()], pa.binary())], names=["part", "counts"]
                )

    return run


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the rows of a task by part: a row a part goes on."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for part, counts in zip(b.column("part").to_pylist(), b.column("counts")):
            got = np.frombuffer(counts.as_buffer(), np.int64)
            sums[part] = sums[part] + got if part in sums else got
    if sums:
        yield pa.record_batch(
            [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"]
        )


def _summed(rows: DataFrame, tasks: int) -> DataFrame:
    """One row a part, summed in a tree: no task reads more than ``_FAN`` rows of a part,
    however many tasks counted."""
    while tasks > 1:
        tasks = -(-tasks // _FAN)
        rows = rows.repartition(tasks).mapInArrow(_sum_counts, "part int, counts binary")
    return rows


def _bounds(queries: np.ndarray, p: Params):
    """The largest absolute component of the candidates, by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for _, block in _blocks(batches, p, queries.shape[1]):
            most = max(most, float(np.abs(block).max(initial=0)))
        yield pa.record_batch([pa.array([most])], names=["most"])

    return run


def _winners(ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, ties: np.ndarray):
    """Scores above each query's kth, and its ties with the smallest ids, of a partition."""

    def run(p: Params):
        def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [np.zeros(0, np.int64) for _ in ids]
            for vec, block in _blocks(batches, p, queries.shape[1]):
                got = _scores(queries, block)
                ok = (got >= kth[:, None]) & (ids[:, None] != vec)
                q, v = np.nonzero(ok)
                score = got[q, v]
                above = score > kth[q]
                if above.any():
                    yield _rows(ids[q[above]], vec[v[above]], score[above])
                even_q, even_v = q[~above], vec[v[~above]]
                for k in np.unique(even_q).tolist():
                    new = np.concatenate([held[k], even_v[even_q == k]])
                    held[k] = np.sort(new)[: ties[k]]
            for k, vecs in enumerate(held):
                if len(vecs):
                    yield _rows(np.full(len(vecs), ids[k]), vecs, np.full(len(vecs), kth[k]))

        return inner

    return run


def _rows(query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(query), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])


def _select(spark: SparkSession, vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, p: Params) -> DataFrame:
    """Candidates for the top k of a block of queries of one length."""
    most = max(r.most for r in vectors.mapInArrow(_bounds(queries, p), "most double").collect())
    reach = np.abs(queries).sum(axis=1) * most
    low, high = -np.ceil(reach).astype(np.int64), np.ceil(reach).astype(np.int64) + 1
    above = np.zeros(len(ids), dtype=np.int64)  # scores known to lie above the range
    tasks = vectors.rdd.getNumPartitions()
    while True:
        step = np.maximum(1, -(-(high - low) // p.bins))
        counted = vectors.mapInArrow(_histograms(ids, queries, low, step, p), "part int, counts binary")
        parts = _summed(counted, tasks).collect()
        counts = np.zeros((len(ids), p.bins + 2), dtype=np.int64)
        for r in parts:
            got = np.frombuffer(r.counts, np.int64).reshape(-1, p.bins + 2)
            counts[r.part : r.part + len(got)] = got
        upward = np.cumsum(counts[:, 1:-1][:, ::-1], axis=1)[:, ::-1]  # at or above each interval's start
        need = p.k - counts[:, -1]
        # the highest interval at whose start k scores are reached; the lowest if there aren't k
        enough = upward >= need[:, None]
        at = np.where(enough.any(axis=1), p.bins - 1 - enough[:, ::-1].argmax(axis=1), 0)
        rows = np.arange(len(ids))
        above = counts[:, -1] + np.where(at + 1 < p.bins, upward[rows, np.minimum(at + 1, p.bins - 1)], 0)
        few = ~enough.any(axis=1)
        low = np.where(few, low, low + at * step)
        high = np.where(few, low + 1, np.minimum(low + step, high))
        if (high - low <= 1).all():
            break
    # with fewer than k candidates the bound is the lowest score possible
    kth = np.where(few, -np.ceil(reach).astype(np.int64) - 1, low)
    ties = np.maximum(p.k - above, 0)
    return vectors.mapInArrow(_winners(ids, queries, kth, ties)(p), "query_id long, vec_id long, score long")


def search(spark: SparkSession, vectors: DataFrame, params: Params = Params()) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores."""
    p = params
    scratch = Scratch(spark, "topk")
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    vectors = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    ).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable)
    vectors = scratch.keep(vectors, "vectors")
    asked = vectors.where(F.col("vec_id") % p.every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = scratch.keep(asked.withColumn("width", F.size("embedding")), "asked")
    found = None
    widths = [r.width for r in asked.select("width").distinct().orderBy("width").collect()]
    for width in widths:
        after = None
        while True:
            block = asked.where(F.col("width") == width)
            if after is not None:
                block = block.where(F.col("vec_id") > after)
            rows = block.orderBy("vec_id").limit(p.query_block).collect()
            if not rows:
                break
            after = rows[-1].vec_id
            ids = np.array([r.vec_id for r in rows], dtype=np.int64)
            queries = np.floor(np.array([r.embedding for r in rows], dtype=np.float64).reshape(len(rows), width) * p.scale)
            part = _select(spark, vectors, ids, queries, p)
            # every block's winners go to one table, so that the plan stays as it is
            part.write.mode("append").parquet(f"{scratch.path}/won")
            found = spark.read.schema(part.schema).parquet(f"{scratch.path}/won")
            if len(rows) < p.query_block:
                break
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
