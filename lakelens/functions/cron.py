"""Cron schedules: fields, next times in a time zone, due ticks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
# Days of the week count from Sunday = 1.
_DAYS = {d: i for i, d in enumerate("sun mon tue wed thu fri sat".split(), 1)}
_RANGES = ((0, 59), (0, 59), (0, 23), (1, 31), (1, 12), (1, 7))


class CronError(ValueError):
    pass


def _field(text: str, low: int, high: int, names: dict[str, int]) -> frozenset[int]:
    def value(x: str) -> int:
        x = x.lower()
        v = names[x] if x in names else int(x) if x.isdigit() else None
        if v is None or not low <= v <= high:
            raise CronError(f"bad value {x}")
        return v

    out: set[int] = set()
    for part in text.split(","):
        body, _, step = part.partition("/")
        every = int(step) if step.isdigit() and int(step) > 0 else 1 if not step else None
        if every is None:
            raise CronError(f"bad step {step}")
        if body in ("*", "?"):
            a, z = low, high
        elif "-" in body:
            a, z = (value(x) for x in body.split("-", 1))
        else:
            a = value(body)
            z = high if step else a
        if a > z:
            raise CronError(f"bad range {body}")
        out.update(range(a, z + 1, every))
    return frozenset(out)


class Cron:
    """A schedule of five fields (minutes first) or six (seconds first)."""

    def __init__(self, expression: str):
        fields = expression.split()
        if len(fields) == 5:
            fields = ["0", *fields]
        if len(fields) != 6:
            raise CronError(f"expected 5 or 6 fields: {expression}")
        names = [{}, {}, {}, {}, _MONTHS, _DAYS]
        sets = [_field(f, *r, n) for f, r, n in zip(fields, _RANGES, names)]
        self.second, self.minute, self.hour = (sorted(s) for s in sets[:3])
        self.day, self.month, self.weekday = sets[3:]

    def times(self, after: dt.datetime, until: dt.datetime, zone: ZoneInfo) -> Iterator[dt.datetime]:
        """UTC times in (after, until], by the zone's wall clock.  Times a change of the
        clock skips don't fire; those it repeats fire once, at the first."""
        day = after.astimezone(zone).date()
        last = until.astimezone(zone).date()
        while day <= last:
            if day.day in self.day and day.month in self.month and day.isoweekday() % 7 + 1 in self.weekday:
                for h in self.hour:
                    for m in self.minute:
                        for s in self.second:
                            local = dt.datetime(day.year, day.month, day.day, h, m, s, tzinfo=zone)
                            at = local.astimezone(dt.UTC)
                            if at.astimezone(zone).replace(tzinfo=None) != local.replace(tzinfo=None):
                                continue
                            if after < at <= until:
                                yield at
            day += dt.timedelta(days=1)


def due_ticks(
    expression: str, timezone: str, last: dt.datetime | None, now: dt.datetime, window_minutes: int, most: int, default_window: int = 1440
) -> tuple[list[dt.datetime], str | None]:
    """(ticks, error): due times after the last one, no further back than the window, the
    earliest ``most``."""
    try:
        cron = Cron(expression)
        zone = ZoneInfo(timezone)
    except (CronError, ZoneInfoNotFoundError, ValueError, OSError) as e:
        return [], f"{type(e).__name__}: {e}"
    floor = now - dt.timedelta(minutes=window_minutes or default_window)
    after = floor if last is None else max(floor, last + dt.timedelta(seconds=1))
    out = []
    for t in cron.times(after, now, zone):
        if len(out) >= most:
            break
        out.append(t)
    return out, None


_TICKS = "schedule_id string, scheduled_for long, status string, tick_id string, run_key string, error string"


def schedule_ticks(definitions: DataFrame, state: DataFrame, now_ms: int) -> DataFrame:
    """Ticks that are due: TRIGGERED, or PAUSED where the schedule is disabled; a bad
    expression or zone gives an ERROR tick.  A schedule's definition is a row, so this is
    one pass of Arrow batches."""
    now = dt.datetime.fromtimestamp(now_ms / 1000, dt.UTC)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                last = None if pd.isna(r.last_scheduled_for) else dt.datetime.fromtimestamp(r.last_scheduled_for / 1000, dt.UTC)
                ticks, error = due_ticks(r.cron_expression, r.timezone, last, now, int(r.catchup_window_minutes), int(r.max_catchup_ticks))
                if error:
                    out.append((r.schedule_id, now_ms, "ERROR", f"{r.schedule_id}:{now_ms // 1000}", None, error))
                for t in ticks:
                    at = int(t.timestamp())
                    key = f"sched:{r.schedule_id}:{at}" if r.enabled else None
                    out.append((r.schedule_id, at * 1000, "TRIGGERED" if r.enabled else "PAUSED", f"{r.schedule_id}:{at}", key, None))
            yield pd.DataFrame(out, columns=["schedule_id", "scheduled_for", "status", "tick_id", "run_key", "error"])

    wide = definitions.join(state.select("schedule_id", "last_scheduled_for"), "schedule_id", "left")
    return wide.mapInPandas(run, _TICKS)


def sensor_requests(evals: DataFrame) -> DataFrame:
    """(sensor_id, eval_id, run_key, request_fingerprint) of evaluations that weren't stale."""
    kind = "array<struct<run_key:string,request_fingerprint:string>>"
    live = evals.where(F.col("status") != "SKIPPED_STALE_CURSOR")
    each = live.select("sensor_id", "eval_id", F.explode(F.from_json("run_requests", kind)).alias("r"))
    return each.select("sensor_id", "eval_id", "r.run_key", "r.request_fingerprint")
