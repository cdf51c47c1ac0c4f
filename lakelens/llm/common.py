"""Shared folder handling and table reading for the operators.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
driver and executors share, so a lost executor costs a re-read, not a re-run of
the whole lineage.  Only in local mode (tests) may that setting be absent; a
temporary folder then takes its place.  What a lazy result still reads can't be
deleted here: like checkpoint files it stays until the folder is cleared.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of at most about ``most`` bytes in this session: texts may be long, and
    both sides of the pipe to Python hold whole batches."""
    now = int("".join(c for c in spark.conf.get(_BATCH_BYTES) if c.isdigit()) or 0)
    if not 0 < now <= most:
        spark.conf.set(_BATCH_BYTES, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The shared folder's path; set for this session only where it is unset."""
    bounded_batches(spark)
    place = spark.conf.get(_SETTING, None)
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{_SETTING} must name a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set(_SETTING, place)
    return place.rstrip("/")


class Scratch:
    """A folder of intermediate tables below the shared folder."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back: later uses don't recompute it."""
        at = f"{self.path}/{name}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def release(self) -> None:
        """Let go of shuffle files of finished steps: Spark deletes them once nothing refers
        to them, which otherwise waits for the driver's next collections."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Delete tables nothing will read again."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_tasks(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    tail = ""
    while any(f"{n}{tail}".lower() in taken for n in names):
        tail += "_"
    return [f"{n}{tail}" for n in names]
