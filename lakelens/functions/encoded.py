"""The few functions Spark lacks, plain and as Arrow-batched column functions."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from typing import Any

import pandas as pd
from pyspark.sql.functions import pandas_udf

from lakelens.functions.scalars import CROCKFORD


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode().rstrip("=").lower()[:26]


def task_name(prefix: str, internal: str) -> str:
    """``prefix_`` and 26 base-32 characters of the id's SHA-256."""
    return f"{prefix}_{_base32(hashlib.sha256(internal.encode()).digest())}"


def run_id(tenant: str, workspace: str, run_key: str, secret: bytes) -> str:
    """A run's id follows from its key, under the tenant's secret."""
    text = f"{tenant}:{workspace}:{run_key}".encode()
    return f"run_{_base32(hmac.new(secret, text, hashlib.sha256).digest())}"


def full_jitter(run: str, task: str, attempt: int, base_s: float = 5, cap_s: float = 300) -> int:
    """Milliseconds to wait: a hash picks evenly from zero to the doubled, capped base."""
    most = int(min(cap_s, base_s * 2 ** max(attempt - 1, 0)) * 1000)
    digest = hashlib.sha256(run.encode() + task.encode() + attempt.to_bytes(4, "little")).digest()
    return int.from_bytes(digest[:8], "little") % (most + 1)


def canonical_json(value: Any) -> str:
    """Sorted keys, no spaces, no floats."""

    def check(x: Any) -> None:
        if isinstance(x, float):
            raise ValueError("floats have no canonical form")
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            check(y)

    check(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def json_fingerprint(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def transform_fingerprint(source: str) -> str:
    return hashlib.sha256(source.encode()).hexdigest()[:16]


def millis_of_ulid(x: str) -> int | None:
    if len(x) != 26 or any(c not in CROCKFORD for c in x.upper()) or x[0] > "7":
        return None
    value = 0
    for c in x[:10].upper():
        value = value * 32 + CROCKFORD.index(c)
    return value


#: Timer kinds in ids and in rows.
TIMER_TYPES = {"retry": "RETRY", "heartbeat": "HEARTBEAT_CHECK", "sla": "SLA_CHECK", "cron": "CRON"}


def parse_timer(x: str) -> dict[str, Any] | None:
    """What a timer id says: type, run, task, attempt and time (epoch milliseconds)."""
    head, _, rest = x.partition(":")
    kind, _, rest = rest.partition(":")
    if head != "timer" or kind not in TIMER_TYPES:
        return None
    rest, _, at = rest.rpartition(":")
    out = {"timer_type": TIMER_TYPES[kind], "run_id": None, "task_key": None, "attempt": None}
    try:
        out["fire_at"] = int(at) * 1000
        if kind != "cron":
            run, _, task = rest.partition(":")
            task, _, attempt = task.rpartition(":")
            out |= {"run_id": run, "task_key": task, "attempt": int(attempt)}
    except ValueError:
        return None
    return out


def task_name_udf(prefix: str):
    @pandas_udf("string")
    def f(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else task_name(prefix, v))

    return f


def run_id_udf(tenant: str, workspace: str, secret: bytes):
    @pandas_udf("string")
    def f(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else run_id(tenant, workspace, v, secret))

    return f


def full_jitter_udf(base_s: float = 5, cap_s: float = 300):
    """Milliseconds to wait of (run, task, attempt)."""

    @pandas_udf("long")
    def f(run: pd.Series, task: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([full_jitter(r, t, int(a), base_s, cap_s) for r, t, a in zip(run, task, attempt)])

    return f


def canonical_json_udf():
    """Canonical form of a JSON column; null where it is malformed or holds a float."""

    def one(v: str | None) -> str | None:
        try:
            return None if v is None else canonical_json(json.loads(v))
        except ValueError:
            return None

    @pandas_udf("string")
    def f(x: pd.Series) -> pd.Series:
        return x.map(one)

    return f
