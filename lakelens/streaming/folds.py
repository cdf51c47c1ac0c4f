"""Streams of orchestration events into state.

``fold_stream`` keeps each key's machine in the state store and emits the rows a
micro-batch changed.  ``publish_stream`` turns micro-batches into deltas of a
versioned table, exactly once: the batch id travels in the manifest's watermarks,
so a batch that is run again after a failure finds itself published.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakelens.operators.fold import FOLDED, MACHINES, _rows_of
from lakelens.sources.snapshots import VersionedTable


def fold_stream(events: DataFrame, by: str) -> DataFrame:
    """The rows of each key's machine that a micro-batch changed; one that went has a null
    state.  Events of a batch are folded in order of their ids; a lower id that comes in a
    later batch is folded when it comes.  Idempotency keys count once a machine: a stream
    has no order over machines."""
    make = MACHINES[by]

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = make(key[0])
        if state.exists:
            m.load(state.get[0])
        shown = lambda: {(e, k): (x.get("row_version"), json.dumps(x, sort_keys=True)) for e, k, x in _rows_of(m, key[0])}
        before = shown() if state.exists else {}
        pdf = pd.concat(list(pdfs)).sort_values("event_id", kind="stable").drop_duplicates("event_id")
        for r in pdf.itertuples(index=False):
            m.feed(r.event_id, r.event_type, r.idempotency_key, r.ts, r.payload)
        state.update((m.dump(),))
        after = shown()
        rows = [(key[0], *name, *row) for name, row in after.items() if before.get(name) != row]
        rows += [(key[0], *name, None, None) for name in before if name not in after]
        yield pd.DataFrame(rows, columns=["fold_key", "entity", "entity_key", "row_version", "state"])

    slim = events.where(F.col(by).isNotNull() & F.col("event_type").isin(*make.on)).select(by, "event_id", "event_type", "idempotency_key", "ts", "payload")
    return slim.groupBy(by).applyInPandasWithState(step, FOLDED, "machine string", "update", GroupStateTimeout.NoTimeout)


def publish_stream(
    events: DataFrame, table: VersionedTable, shape: Callable[[DataFrame], DataFrame], checkpoint: str, query: str, compact_at: int = 10
) -> DataStreamWriter:
    """Each micro-batch, shaped into the table's rows, becomes a delta; with ``compact_at``
    deltas they are merged into a new base."""

    def batch(df: DataFrame, batch_id: int) -> None:
        seen = table.manifest()["watermarks"].get(f"batch:{query}", -1)
        if batch_id <= seen:
            return
        table.publish_delta(shape(df), watermarks={f"batch:{query}": batch_id})
        if len(table.manifest()["deltas"]) >= compact_at:
            table.compact()

    return events.writeStream.queryName(query).option("checkpointLocation", checkpoint).foreachBatch(batch)


def notify_stream(
    events: DataFrame, domains: list[str], consume: Callable[[str, DataFrame], None], checkpoint: str, seconds: float = 5, most: int = 100
) -> DataStreamWriter:
    """Notifications handed over domain by domain; others are ignored.  A domain's are held
    in the state store until there are ``most`` of them or the first has waited ``seconds``."""
    schema = events.schema

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, since = state.get if state.exists else ("[]", state.getCurrentProcessingTimeMs())
        new = [json.loads(x) for pdf in pdfs for x in pdf["_event"]] if not state.hasTimedOut else []
        rows = json.loads(held) + new
        while len(rows) >= most:
            yield pd.DataFrame({"domain": [key[0]] * most, "_event": [json.dumps(x) for x in rows[:most]]})
            rows, since = rows[most:], state.getCurrentProcessingTimeMs()
        if rows and (state.hasTimedOut or state.getCurrentProcessingTimeMs() - since >= 1000 * seconds):
            yield pd.DataFrame({"domain": [key[0]] * len(rows), "_event": [json.dumps(x) for x in rows]})
            rows = []
        if rows:
            state.update((json.dumps(rows), since))
            state.setTimeoutDuration(max(1, since + int(1000 * seconds) - state.getCurrentProcessingTimeMs()))
        elif state.exists:
            state.remove()

    def batch(df: DataFrame, _: int) -> None:
        df = df.persist()
        try:
            for d in domains:
                own = df.where(F.col("domain") == d).select(F.from_json("_event", schema).alias("e")).select("e.*")
                if not own.isEmpty():
                    consume(d, own)
        finally:
            df.unpersist()

    told = events.where(F.col("domain").isin(*domains)).select("domain", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("_event"))
    flushed = told.groupBy("domain").applyInPandasWithState(
        step, "domain string, _event string", "held string, since long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
    tick = f"{max(1, int(1000 * min(1.0, seconds)))} milliseconds"
    return flushed.writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=tick).foreachBatch(batch)
