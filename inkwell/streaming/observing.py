"""Debounced observation: what a key shows is put out once it has been quiet for a while.

A processor keeps what a key showed last and, with event-time timers, puts it out when nothing newer came for ``gap`` milliseconds. What was
put out last is kept too: messages come once, drafts not twice in a row. A second timer drops it after ``keep`` milliseconds, so the
state of a key that fell silent goes, and the watermark bounds the whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# How long a message and a draft must be quiet.
MESSAGE_GAP, DRAFT_GAP = 400, 1500
DAY = 86_400_000
#: What the states of transformWithState need.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The session with the state store that such streams need, while they are started and run."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Quiet(StatefulProcessor):
    """Rows (key, id, value) of what was quiet for ``gap``; with ``once`` only the first of a key, else what differs from the one before."""

    def __init__(self, gap: int, once: bool, keep: int):
        self.gap, self.once, self.keep = gap, once, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shown = handle.getValueState("shown", "id long, value string, ms long")
        self.told = handle.getValueState("told", "value string, ms long")

    def tell(self, shown: tuple, told: tuple | None, out: list) -> tuple:
        """Puts ``shown`` out unless ``told`` forbids it; what was told after that."""
        if told is None or not (self.once or told[0] == shown[1]):
            out.append((shown[0], shown[1]))
        return shown[1], shown[2]

    def timers(self, shown: tuple | None, told: tuple | None) -> None:
        """One timer for what is shown, one for what was told; earlier ones go."""
        wanted = {state[-1] + after for state, after in ((shown, self.gap), (told, self.keep)) if state}
        there = {t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()}
        for at in there - wanted:
            self.handle.deleteTimer(at)
        for at in wanted - there:
            self.handle.registerTimer(at)

    def frame(self, key: tuple, out: list) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]] * len(out), "id": [i for i, _ in out], "value": [v for _, v in out]}, dtype=object)

    # every call to a state is a round trip to the JVM: a key's states are read once and written once, whatever its rows

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        shown, told, out = self.shown.get(), self.told.get(), []
        shown, before = tuple(shown) if shown else None, told
        found = [r for part in rows for r in zip(part["ms"].tolist(), part["id"].tolist(), part["value"].tolist(), strict=True)]
        for ms, number, value in sorted(found, key=lambda r: r[:2]):
            if shown and ms < shown[2]:
                continue  # older than what is shown
            if shown and ms >= shown[2] + self.gap:
                told = self.tell(shown, told, out)
            shown = (int(number), None if pd.isna(value) else value, int(ms))
        self.shown.update(shown)
        if told is not before:
            self.told.update(told)
        self.timers(shown, told)
        if out:
            yield self.frame(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at, out = expiredTimerInfo.getExpiryTimeInMs(), []
        shown, told = self.shown.get(), self.told.get()
        if shown and at >= shown[2] + self.gap:
            told = self.tell(tuple(shown), told, out)
            shown = None
            self.shown.clear()
            self.told.update(told)
        if told and at >= told[1] + self.keep:
            told = None
            self.told.clear()
        self.timers(shown, told)
        if out:
            yield self.frame(key, out)

    def close(self) -> None:
        pass


def quiet(rows: DataFrame, gap: int, once: bool, late: str, keep: int = 30 * DAY) -> DataFrame:
    """The stream of what is put out: key, id, value. rows: key (string), id (long), at (timestamp), value (string)."""
    timed = rows.withWatermark("at", late).select("key", "id", "value", F.unix_millis("at").alias("ms"), "at")
    return timed.groupBy("key").transformWithStateInPandas(Quiet(gap, once, keep), "key string, id long, value string", "append", "eventtime")


def messages(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """New messages, each once, as it stands after it hasn't changed for MESSAGE_GAP. rows: key, id, at, value."""
    return quiet(rows, MESSAGE_GAP, True, late)


def drafts(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """Drafts to save: what an account wrote, once it paused for DRAFT_GAP, unless that is what was saved last. rows: key, id, at, value."""
    return quiet(rows, DRAFT_GAP, False, late)
