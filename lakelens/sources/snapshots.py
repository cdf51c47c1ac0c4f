"""Versioned tables in folders: snapshots, deltas, manifests, pinned reads.

A table's folder holds ``v<n>/`` data folders and ``manifests/<n>.json``; the highest
manifest is in force.  Data is written before its manifest, and creating the manifest
is the commit: it fails if that number is taken, so one of two writers wins, and there
is no moment at which a reader finds none.  ``current.json`` only tells where to start
looking.  What no manifest selects is not read, however much of it lies there.  Rows
are written in key order under names that versions alone decide.  All access goes
through the Hadoop file system of the path, so any store with a rename that doesn't
overwrite will do; local files are linked into place instead.
"""

from __future__ import annotations

import itertools
import json
import time
import uuid
from contextlib import suppress
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.operators.merge import merge_layers


_RETRY_S = (0, 0, 0.005, 0.025)


class Conflict(RuntimeError):
    """Someone else published first."""


class Files:
    """Small-file access through Hadoop."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)
        self.root = self.fs.makeQualified(self._path("")).toString()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def hint(self, name: str) -> str | None:
        """A file that may be missing or just be replaced by others."""
        try:
            return self.read(name)
        except Py4JJavaError:
            return None

    def _temp(self, name: str, text: str):
        temp = self._path(f".{name.replace('/', '_')}.{uuid.uuid4().hex}")
        stream = self.fs.create(temp, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(self._path(name).getParent())
        return temp

    def create(self, name: str, text: str) -> bool:
        """Put a file in place whole, unless there is one: then False."""
        path, temp = self._path(name), self._temp(name, text)
        try:
            if self.fs.getUri().getScheme() == "file":  # a rename would overwrite; a link doesn't
                nio = self.jvm.java.nio.file
                at = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
                try:
                    nio.Files.createLink(at(path), at(temp))
                    return True
                except Py4JJavaError as e:
                    if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                        return False
                    raise
            return not self.fs.exists(path) and self.fs.rename(temp, path)
        finally:
            self.fs.delete(temp, False)

    def replace(self, name: str, text: str) -> None:
        """Put a file in place of the one that may be there, in one step."""
        path, temp = self._path(name), self._temp(name, text)
        rename = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        how = self.jvm.java.lang.reflect.Array.newInstance(rename, 1)
        how[0] = rename.getEnumConstants()[1]  # OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(temp, path, how)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        if not self.fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path))

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength()

    def delete(self, name: str) -> bool:
        return self.fs.delete(self._path(name), True)


class VersionedTable:
    """Base snapshots and deltas of a table with a primary key."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: tuple[str, ...], table: str = ""):
        self.spark, self.folder, self.schema, self.key, self.table = spark, folder.rstrip("/"), schema, key, table
        self.files = Files(spark, folder)

    # -- reading

    def version(self) -> int:
        """The number of the highest manifest; 0 if there is none."""
        n = json.loads(self.files.hint("current.json") or '{"version": 0}')["version"]
        while self.files.exists(f"manifests/{n + 1}.json"):
            n += 1
        return n

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        """The manifest in force, or a pinned one; an empty one if nothing was published."""
        if not version:
            version = self.version()
            if not version:
                return {"version": 0, "schema_version": 1, "base": None, "deltas": [], "watermarks": {}, "row_counts": {}}
        found = json.loads(self.files.read(f"manifests/{version}.json"))
        if found["schema_version"] > 1:
            raise ValueError(f"manifest has schema version {found['schema_version']}, 1 is understood")
        return found

    def read(self, version: int | None = None) -> DataFrame:
        """Rows as of a version: the base with its deltas merged in order."""
        m = self.manifest(version)
        layers = ([(0, m["base"])] if m["base"] else []) + [(i, d["upserts"]) for i, d in enumerate(m["deltas"], 1) if d["upserts"]]
        rows = self._stack(layers, self.schema)
        gone = [(i, d["deletes"]) for i, d in enumerate(m["deltas"], 1) if d["deletes"]]
        keys = T.StructType([f for f in self.schema if f.name in self.key])
        tombstones = self._stack(gone, keys) if gone else None
        if not m["deltas"]:
            return rows.drop("delta_ordinal")
        return merge_layers(rows, self.key, self.table, tombstones)

    def _stack(self, layers: list[tuple[int, str]], schema: T.StructType) -> DataFrame:
        out = self.spark.createDataFrame([], schema).withColumn("delta_ordinal", F.lit(0))
        for ordinal, path in layers:
            df = self.spark.read.schema(schema).parquet(f"{self.folder}/{path}").withColumn("delta_ordinal", F.lit(ordinal))
            out = out.unionByName(df)
        return out

    # -- writing

    def publish_base(self, rows: DataFrame, watermarks: dict[str, Any] | None = None) -> int:
        """A new base in place of all there is; a conflict if someone publishes meanwhile."""
        before = self.version()
        return self._publish(self._write(rows, before + 1, "base"), None, before, watermarks)

    def publish_delta(self, upserts: DataFrame | None, deletes: DataFrame | None = None, watermarks: dict[str, Any] | None = None) -> int:
        """A delta on top of whatever is in force when it is published."""
        version = self.version() + 1
        delta = {
            "upserts": self._write(upserts, version, "upserts") if upserts is not None else None,
            "deletes": self._write(deletes.select(*self.key), version, "deletes") if deletes is not None else None,
            "created_at": int(time.time() * 1000),
        }
        return self._publish(None, delta, None, watermarks)

    def compact(self) -> int:
        """Deltas merged into a new base; readers pinned to older versions keep them."""
        before = self.version()
        return self._publish(self._write(self.read(before), before + 1, "base"), None, before, None)

    def _write(self, rows: DataFrame, version: int, what: str) -> str:
        # the first number no other writer has claimed
        k = next(k for k in itertools.count() if self.files.create(f"v{version:08d}/.{what}-{k}", ""))
        name = f"v{version:08d}/{what}-{k}"
        rows.orderBy(*self.key).write.parquet(f"{self.folder}/{name}")
        return name

    def _rows(self, path: str) -> int:
        """Rows of a data folder, by its files' footers."""
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{path}").count()

    def _publish(self, base: str | None, delta: dict | None, expected: int | None, watermarks: dict[str, Any] | None) -> int:
        """Publish a new base on the expected version or a delta on any; a delta that comes
        second goes on top of what came first."""
        counts = {path: self._rows(path) for path in (base, *(delta[k] for k in ("upserts", "deletes") if delta)) if path} if delta or base else {}
        for wait in _RETRY_S:
            time.sleep(wait)
            before = self.manifest()
            if expected is not None and before["version"] != expected:
                break
            version = before["version"] + 1
            kept = [] if delta is None else [before["base"], *(d[k] for d in before["deltas"] for k in ("upserts", "deletes"))]
            body = {
                "version": version, "schema_version": 1, "base": before["base"] if delta else base, "deltas": [*before["deltas"], delta] if delta else [],
                "row_counts": {p: n for p, n in before["row_counts"].items() if p in kept} | counts,
            }
            marks = dict(before["watermarks"])
            for k, v in (watermarks or {}).items():  # watermarks only move forward
                marks[k] = v if marks.get(k) is None else max(marks[k], v)
            if self.files.create(f"manifests/{version}.json", json.dumps(body | {"watermarks": marks}, sort_keys=True)):
                with suppress(Py4JJavaError):  # a hint: the version is published
                    self.files.replace("current.json", json.dumps({"version": version}))
                return version
        raise Conflict(f"{self.folder} was published by someone else")

    def inventory(self) -> dict[str, int]:
        """Rows of each data folder in force, as its manifest tells."""
        return dict(self.manifest()["row_counts"])

    def row_count(self) -> int:
        """Current rows: the manifest's count of the base, or a merge where there are deltas."""
        m = self.manifest()
        return self.read().count() if m["deltas"] else m["row_counts"].get(m["base"], 0)

    def unreferenced(self) -> list[str]:
        """Data folders no manifest selects."""
        used = set()
        for name in self.files.names("manifests"):
            m = json.loads(self.files.read(f"manifests/{name}"))
            used |= {p for p in [m["base"], *(x for d in m["deltas"] for x in (d["upserts"], d["deletes"]))] if p}
        have = {f"{v}/{d}" for v in self.files.names("") if v.startswith("v") for d in self.files.names(v) if d[0] != "."}
        return sorted(have - used)


def write_by_tenant(rows: DataFrame, path: str) -> None:
    """A folder per tenant, sorted within, so that a tenant's reads prune to it.  Ranges of
    (tenant, workspace, run) are dealt out, so a large tenant is written by several tasks."""
    ordered = rows.repartitionByRange("org_id", "workspace_id", "run_id").sortWithinPartitions("org_id", "workspace_id", "run_id", "task_key")
    ordered.write.partitionBy("org_id").parquet(path)
