"""The event ledger: JSON events in files, Parquet bundles, streams over both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id string, event_type string, event_version int, idempotency_key string, occurred_at string, source string, trace_id string, sequence_position long, payload string"
BUNDLE_KEY = ("tenant_id", "workspace_id", "run_id", "task_key", "attempt_id", "producer_id")


def read_events(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """All events with the file each came from; absent fields are null."""
    return spark.read.schema(schema).json(path).withColumn("path", F.input_file_name())


def stream_events(spark: SparkSession, path: str, schema: str = EVENT, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def append_events(events: DataFrame, path: str) -> int:
    """Append events that aren't there yet; an id whose bytes differ fails the whole batch.
    Returns how many were new."""
    from lakelens.operators.merge import append_once

    spark = events.sparkSession
    try:
        ledger = spark.read.schema(EVENT).json(path)
        ledger.limit(1).count()
    except Exception as e:  # noqa: BLE001  the first append finds no folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
        ledger = spark.createDataFrame([], EVENT)
    fresh, conflicts = append_once(ledger, events)
    bad = conflicts.select("event_id").limit(5).collect()
    if bad:
        raise ValueError(f"event ids with different content: {[r.event_id for r in bad]}")
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").json(path)
    fresh.unpersist()
    return n


def bundle_problems(bundle: DataFrame) -> DataFrame:
    """(bundle_id, problem) of L0 bundles: events of one producer and attempt, ids and
    producer sequences once each, counts and bounds as stated."""
    # once per bundle and set of keys, then per bundle: the least and greatest of a key tell
    # whether it has several values, without a row for each value
    parts = bundle.groupBy("bundle_id", *BUNDLE_KEY).agg(
        F.count("*").alias("n"),
        F.min("producer_seq").alias("low"),
        F.max("producer_seq").alias("high"),
        F.max("bundle_event_count").alias("said_n"),
        F.max("bundle_min_producer_seq").alias("said_low"),
        F.max("bundle_max_producer_seq").alias("said_high"),
    )
    agg = parts.groupBy("bundle_id").agg(
        *(F.min(c).alias(f"{c}_a") for c in BUNDLE_KEY),
        *(F.max(c).alias(f"{c}_z") for c in BUNDLE_KEY),
        F.sum("n").alias("n"),
        F.min("low").alias("low"),
        *(F.max(c).alias(c) for c in ("high", "said_n", "said_low", "said_high")),
    )
    tests = [(F.col(f"{c}_a") != F.col(f"{c}_z"), f"several values of {c}") for c in BUNDLE_KEY] + [
        (F.col("said_n") != F.col("n"), "wrong event count"),
        ((F.col("said_low") != F.col("low")) | (F.col("said_high") != F.col("high")), "wrong sequence bounds"),
    ]
    found = F.array_compact(F.array(*(F.when(t, F.lit(p)) for t, p in tests)))
    out = agg.select("bundle_id", F.explode(found).alias("problem"))
    for c in ("event_id", "producer_seq"):
        # rows are dealt by bundle and value as they are: nearly all differ, so nothing is
        # gained by counting before; only repeated or missing values go on
        each = bundle.select("bundle_id", c).repartition("bundle_id", c).groupBy("bundle_id", c).agg(F.count("*").alias("n"))
        again = each.where((F.col("n") > 1) | F.col(c).isNull()).select("bundle_id").distinct()
        out = out.union(again.select("bundle_id", F.lit(f"repeated {c}").alias("problem")))
    return out


def write_bundle(bundle: DataFrame, path: str) -> None:
    bad = bundle_problems(bundle).limit(5).collect()
    if bad:
        raise ValueError(f"invalid bundle: {[(r.bundle_id, r.problem) for r in bad]}")
    bundle.write.mode("append").parquet(path)
