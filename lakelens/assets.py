"""Assets in Python: declare functions that make tables, plan and run them.

    daily = TimePartition("date", "day")

    @asset("sales.orders")
    def orders(ctx):
        return ctx.spark.read.parquet(...)

    @asset("sales.totals", partitions=daily, checks=[RowCount("some", minimum=1)])
    def totals(ctx, orders: AssetIn["sales.orders"]):
        return orders.groupBy("day").count()

A parameter annotated ``AssetIn["ns.name"]`` is a dependency and is given that
asset's DataFrame.
"""

from __future__ import annotations

import inspect
import re
import textwrap
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakelens.functions.encoded import json_fingerprint, transform_fingerprint
from lakelens.operators.checks import Check, run_checks
from lakelens.operators.graph import topological_order

_KEY = re.compile(r"^[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)+$")


def canonical_key(key: str) -> str:
    k = re.sub(r"^([^/.]*)/", r"\1.", key)
    if not _KEY.match(k):
        raise ValueError(f"bad asset key {key!r}")
    return k


class _In(type):
    def __getitem__(cls, key: str) -> AssetRef:
        return AssetRef(canonical_key(key))


class AssetIn(metaclass=_In):
    """Annotation of a parameter that takes another asset's DataFrame."""


@dataclass(frozen=True)
class AssetRef:
    key: str


@dataclass(frozen=True)
class TimePartition:
    dimension: str
    granularity: str = "day"


@dataclass(frozen=True)
class StaticPartition:
    dimension: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Mapping:
    """How a dependency's partitions map: identity, all, latest or window."""

    kind: str = "identity"
    start: int = 0
    end: int = 0


@dataclass
class AssetDef:
    key: str
    make: Callable[..., DataFrame]
    inputs: dict[str, str]
    partitions: Any = None
    checks: tuple[Check, ...] = ()
    retries: int = 0
    description: str | None = None
    mappings: dict[str, Mapping] = field(default_factory=dict)

    @property
    def code_version(self) -> str:
        try:
            return transform_fingerprint(textwrap.dedent(inspect.getsource(self.make)))
        except OSError:
            return transform_fingerprint(self.make.__qualname__)


class Registry:
    def __init__(self) -> None:
        self.assets: dict[str, AssetDef] = {}

    def add(self, a: AssetDef) -> AssetDef:
        if a.key in self.assets:
            raise ValueError(f"asset {a.key} is declared twice")
        self.assets[a.key] = a
        return a

    def order(self, roots: Iterable[str] | None = None) -> list[str]:
        """Assets to make for ``roots`` (all by default), upstreams first."""
        graph = {k: list(a.inputs.values()) for k, a in self.assets.items()}
        unknown = {u for ups in graph.values() for u in ups} - set(graph)
        if unknown:
            raise ValueError(f"unknown assets: {sorted(unknown)}")
        wanted, queue = set(), [canonical_key(r) for r in roots] if roots is not None else list(graph)
        while queue:
            k = queue.pop()
            if k not in graph:
                raise ValueError(f"unknown asset {k}")
            if k not in wanted:
                wanted.add(k)
                queue += graph[k]
        return topological_order({k: [u for u in graph[k] if u in wanted] for k in wanted})

    def plan(self, selection: Sequence[str], partition_keys: Sequence[str] = ()) -> dict[str, Any]:
        """Task definitions of a selection.  Dependencies outside it are left out; a single
        partition key is passed on; an empty selection gives one ``materialize`` task."""
        chosen = {canonical_key(s) for s in selection}
        order = [k for k in self.order(chosen) if k in chosen] if chosen else []
        key = partition_keys[0] if len(partition_keys) == 1 else None
        tasks = [{"key": k, "asset_key": k, "partition_key": key, "depends_on": sorted(set(self.assets[k].inputs.values()) & chosen), "max_attempts": 1 + self.assets[k].retries} for k in order]
        tasks = tasks or [{"key": "materialize", "asset_key": None, "partition_key": key, "depends_on": [], "max_attempts": 1}]
        return {"tasks": tasks, "fingerprint": json_fingerprint(tasks)}

    def manifest(self) -> dict[str, Any]:
        return {
            k: {"inputs": dict(sorted(a.inputs.items())), "code_version": a.code_version, "checks": [c.name for c in a.checks], "retries": a.retries}
            for k, a in sorted(self.assets.items())
        }

    def run(self, spark: SparkSession, roots: Iterable[str] | None = None, partition: dict[str, str] | None = None, now: str | None = None) -> dict[str, Result]:
        """Make assets in order; what depends on a failed one is skipped."""
        done: dict[str, Result] = {}
        for k in self.order(roots):
            a = self.assets[k]
            if any(done[u].state != "SUCCEEDED" for u in a.inputs.values()):
                done[k] = Result(k, "SKIPPED")
                continue
            for attempt in range(1, a.retries + 2):
                ctx = Context(spark, k, dict(partition or {}), attempt)
                try:
                    df = a.make(ctx, **{name: done[u].df for name, u in a.inputs.items()})
                    failed = []
                    if a.checks:
                        rows = run_checks(df, a.checks, now=now).collect()
                        failed = [r.name for r in rows if not r.passed and r.severity in ("error", "critical")]
                    done[k] = Result(k, "FAILED" if failed else "SUCCEEDED", df, failed, attempt, ctx.metrics)
                except Exception as e:  # noqa: BLE001  a task's failure is its result
                    done[k] = Result(k, "FAILED", None, [f"{type(e).__name__}: {e}"], attempt, ctx.metrics)
                if done[k].state == "SUCCEEDED":
                    break
        return done


@dataclass
class Context:
    """What an asset function sees."""

    spark: SparkSession
    asset_key: str
    partition: dict[str, str]
    attempt: int = 1
    metrics: dict[str, Any] = field(default_factory=dict)

    def metric(self, name: str, value: Any) -> None:
        self.metrics[name] = value

    def progress(self, share: float) -> None:
        self.metrics["progress"] = max(0.0, min(1.0, share))

    def output(self, df: DataFrame) -> DataFrame:
        """``df`` observed as it is written: its rows count without another pass."""
        seen = Observation(f"{self.asset_key}-{self.attempt}")
        self.metrics["output"] = seen
        self.metrics["schema"] = df.schema.simpleString()
        return df.observe(seen, F.count(F.lit(1)).alias("row_count"))


@dataclass
class Result:
    key: str
    state: str
    df: DataFrame | None = None
    problems: list[str] = field(default_factory=list)
    attempt: int = 1
    metrics: dict[str, Any] = field(default_factory=dict)


REGISTRY = Registry()


def asset(key: str, partitions: Any = None, checks: Sequence[Check] = (), retries: int = 0, mappings: dict[str, Mapping] | None = None, registry: Registry | None = None) -> Callable:
    """Declare an asset; its inputs are the parameters annotated with ``AssetIn``."""

    def declare(f: Callable[..., DataFrame]) -> AssetDef:
        hints = inspect.get_annotations(f, eval_str=True, globals=f.__globals__ | {"AssetIn": AssetIn})
        inputs = {n: h.key for n, h in hints.items() if isinstance(h, AssetRef)}
        made = AssetDef(canonical_key(key), f, inputs, partitions, tuple(checks), retries, inspect.getdoc(f), dict(mappings or {}))
        return (registry or REGISTRY).add(made)

    return declare


def sensor_poll(evaluate: Callable[[str | None], tuple[list[dict], str | None]], state: dict[str, Any]) -> dict[str, Any]:
    """One evaluation of a user's sensor: its run requests and new cursor, with the state
    version it saw, so that the fold can tell whether it came too late."""
    try:
        requests, cursor = evaluate(state.get("cursor"))
        status = "TRIGGERED" if requests else "NO_NEW_DATA"
    except Exception as e:  # noqa: BLE001  a sensor's failure is an evaluation
        requests, cursor, status = [], state.get("cursor"), f"ERROR: {e}"
    return {"cursor_before": state.get("cursor"), "cursor_after": cursor, "expected_state_version": state.get("state_version", 0), "run_requests": requests, "status": status}
