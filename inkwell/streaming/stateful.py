"""Streaming folds over one state per key: generating flags, one-shot staging with a time to live, snapshots of health.

A step gets the state so far (None at first) and a row, and returns the state after it (None drops it) and the row to put out, or
None. Rows of a micro-batch are taken in order of time and id; a source's maxFilesPerTrigger bounds how many there are.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[tuple | None, Any], tuple[tuple | None, tuple | None]]
MINUTE = 60_000_000


def keyed(stream: DataFrame, key: str, step: Step, state: str, out: str, expiry: Callable[[tuple], int] | None = None) -> DataFrame:
    """The fold. ``stream`` has key, id and us (microseconds); with ``expiry`` it also has a watermark, and a state is swept once the
    watermark passes the microsecond that expiry(state) names."""
    names = [part.split()[0] for part in out.split(", ")]

    def run(_: tuple, frames, held: GroupState):
        if held.hasTimedOut:
            held.remove()
            return
        now, found = (held.get if held.exists else None), []
        for row in pd.concat(list(frames)).sort_values(["us", "id"]).itertuples(index=False):
            now, put = step(now, row)
            if put is not None:
                found.append(put)
        if now is not None:
            held.update(now)
            if expiry:
                held.setTimeoutTimestamp(max(expiry(now) // 1000, held.getCurrentWatermarkMs()) + 1)
        elif held.exists:
            held.remove()
        yield pd.DataFrame(found, columns=names).astype(object)

    timeout = GroupStateTimeout.EventTimeTimeout if expiry else GroupStateTimeout.NoTimeout
    return stream.groupBy(key).applyInPandasWithState(run, out, state, "append", timeout)


def timed(rows: DataFrame, time: str) -> DataFrame:
    return rows.withColumn("us", F.unix_micros(F.col(time).cast("timestamp")))


def flags(rows: DataFrame) -> DataFrame:
    """Changes of a message's flag: key, id, generating. rows: key, id, at, generating; a message starts as not generating."""

    def step(now, row):
        was, on = bool(now and now[0]), bool(row.generating)
        return (on,), (row.key, row.id, on) if on != was else None

    return keyed(timed(rows, "at").select("key", "id", "us", "generating"), "key", step, "generating boolean", "key long, id long, generating boolean")


def staging(rows: DataFrame, minutes: int = 30, late: str = "1 day") -> DataFrame:
    """What each take returns: key, id, payload. rows: key, id, at, payload (null for a take).

    Staging replaces what is there. A take returns the payload if it is at most ``minutes`` old, else null, and removes it in either
    case. What nobody takes is swept after its time."""

    def step(now, row):
        if pd.notna(row.payload):
            return (int(row.payload), int(row.us) + minutes * MINUTE), None
        return None, (row.key, row.id, now[0] if now and row.us <= now[1] else None)

    marked = timed(rows.withColumn("at", F.col("at").cast("timestamp")), "at").withWatermark("at", late)
    return keyed(marked, "key", step, "payload long, expires long", "key long, id long, payload long", expiry=lambda state: state[1])


def regressions(rows: DataFrame, least: int = 5) -> DataFrame:
    """Visits without a message on a host whose last visit with messages had ``least`` or more: key, id, before. rows: key, id, at,
    messages. Only visits with messages become the snapshot."""

    def step(now, row):
        if row.messages > 0:
            return (int(row.messages),), None
        return now, (row.key, row.id, now[0]) if now and now[0] >= least else None

    return keyed(timed(rows, "at").select("key", "id", "us", "messages"), "key", step, "messages long", "key long, id long, before long")
